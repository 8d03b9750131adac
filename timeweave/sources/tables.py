"""The library's annotation tables: their schemas, and reading them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

INTERVAL = "video_id long, start_ms long, end_ms long"
SCHEMAS: dict[str, str] = {
    "videos": "video_id long, content_hash string, size long, length_ms long, fps_num long, fps_den long, vfr boolean, has_audio boolean, vcodec string, category string, category_confidence double, category_source string",
    "video_files": "file_id long, video_id long, folder_id long, path string, size long, mtime long, last_seen long",
    "project_folders": "project_id long, folder_id long",
    "project_exclusions": "project_id long, video_id long, role string",
    "segments": f"{INTERVAL}, segment_id long, text string, speaker long, off_mic boolean",
    "sentences": f"{INTERVAL}, segment_id long, text string, words array<struct<start_ms:long,end_ms:long>>",
    "speech_regions": f"{INTERVAL}, quiet_ms long",
    "speaker_turns": f"{INTERVAL}, person_id long",
    "chapters": f"{INTERVAL}, chapter long, title string, titled boolean",
    "motion_windows": f"{INTERVAL}, jerk double, motion double, sway double",
    "frames": "video_id long, frame_id long, at_ms long, description string",
    "face_boxes": "video_id long, track_id long, person_id long, at_ms long, cx double, cy double, w double, h double, sharpness double, cut_off boolean",
    "face_tracks": f"{INTERVAL}, track_id long, n_faces long, box_h double, embedding array<float>",
    "chunks": f"{INTERVAL}, chunk_id long, kind string, text string",
    "jobs": "video_id long, stage string, state string, attempts long, last_error string, seq long",
    "scripts": "script_id long, project_id long, title string, version long, beats string",
}


def load_tables(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The named tables below ``path`` (all without names) as DataFrames of their fixed schema, nothing read yet."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path.rstrip('/')}/{n}") for n in (names or SCHEMAS)}
