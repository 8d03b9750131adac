"""Catalogue maintenance: listings, ledgers, scopes and reports, as set-based plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify_listing(listing: DataFrame, files: DataFrame, now: int, settle: int) -> DataFrame:
    """Each listed file as unchanged, unsettled, reuse (an identical row elsewhere has its hash) or hash; others gone.

    listing(folder_id, path, size, mtime); files adds content_hash.
    """
    key = ["folder_id", "path"]
    known = files.select(*key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("content_hash").alias("_hash"))
    elsewhere = files.where("content_hash IS NOT NULL").groupBy("path", "size", "mtime").agg(F.min("content_hash").alias("_other"))
    both = listing.withColumn("_listed", F.lit(True)).join(known, key, "full").join(elsewhere, ["path", "size", "mtime"], "left")
    state = (
        F.when(F.col("_listed").isNull(), "gone")
        .when((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), "unchanged")
        .when(F.col("mtime") > now - settle, "unsettled")
        .when(F.col("_other").isNotNull(), "reuse")
        .otherwise("hash")
    )
    kept = F.when(F.col("_size").eqNullSafe(F.col("size")) & F.col("_mtime").eqNullSafe(F.col("mtime")), F.col("_hash")).otherwise(F.col("_other"))
    return both.select(*key, state.alias("state"), F.when(state.isin("unchanged", "reuse"), kept).alias("content_hash"))


def content_identity(df: DataFrame, content: str = "content", size: str = "length", edge: int = 4 << 20) -> DataFrame:
    """``identity``: a hash of the size and the first and last ``edge`` bytes, of all where there are no more."""
    c, n = F.col(content), F.col(size)
    whole = F.when(n <= 2 * edge, c).otherwise(F.concat(F.substring(c, F.lit(1), F.lit(edge)), F.substring(c, (n - edge + 1).cast("int"), F.lit(edge))))
    return df.withColumn("identity", F.sha2(F.concat(n.cast("string").cast("binary"), whole), 256))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The newest row of every key, by ``seq``; of equal ones the new table's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc(), F.col("_new").desc())
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def ensure_jobs(videos: DataFrame, stages: Sequence[str], jobs: DataFrame) -> DataFrame:
    """A pending job for every video and stage that has none."""
    wanted = videos.select("video_id").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return wanted.join(jobs.select("video_id", "stage"), ["video_id", "stage"], "left_anti").withColumn("state", F.lit("pending"))


def expire_unseen(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Files seen in their folder's last successful scan; all files of a folder that had none."""
    last = scans.where("ok").groupBy("folder_id").agg(F.max("seq").alias("_seq"))
    return files.join(last, "folder_id", "left").where("_seq IS NULL OR last_seen >= _seq").drop("_seq")


def drop_own_outputs(files: DataFrame, rendered: DataFrame, exports: DataFrame) -> DataFrame:
    return files.join(rendered.select("content_hash"), "content_hash", "left_anti").join(exports.select("path"), "path", "left_anti")


def scope(files: DataFrame, projects: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(project_id, video_id) of a project's folders without its exclusions: smallest path, copies and folders.

    files(video_id, folder_id, path), projects(project_id, folder_id), exclusions(project_id, video_id).
    """
    seen = files.join(projects, "folder_id").join(exclusions.select("project_id", "video_id").distinct(), ["project_id", "video_id"], "left_anti")
    return seen.groupBy("project_id", "video_id").agg(F.min("path").alias("path"), F.countDistinct("folder_id", "path").alias("copies"), F.countDistinct("folder_id").alias("folders"))


def exclusive_videos(scoped: DataFrame) -> DataFrame:
    """Videos that exactly one project sees, with that project."""
    per = scoped.groupBy("video_id").agg(F.countDistinct("project_id").alias("_n"), F.min("project_id").alias("project_id"))
    return per.where("_n = 1").drop("_n")


def current_jobs(events: DataFrame) -> DataFrame:
    """(video_id, stage): the state of the last event, failures since the last ``done``, and the last time."""
    w = Window.partitionBy("video_id", "stage")
    last_done = F.max(F.when(F.col("state") == "done", F.col("seq"))).over(w)
    marked = events.withColumn("_done", F.coalesce(last_done, F.lit(-1)))
    return marked.groupBy("video_id", "stage").agg(
        F.max_by("state", "seq").alias("state"),
        F.sum(F.when((F.col("state") == "failed") & (F.col("seq") > F.col("_done")), 1).otherwise(0)).alias("attempts"),
        F.max("seq").alias("seq"),
        F.max("ts").alias("updated_at"),
    )


def claimable(jobs: DataFrame, prereqs: dict[str, str], max_attempts: int = 3, files: DataFrame | None = None) -> DataFrame:
    """Jobs that may start: pending, or failed fewer than ``max_attempts`` times, whose prerequisite stage is done.

    With files(file_id, video_id, path) of a scope only its videos' jobs, with ``path``, that of the smallest file id.
    """
    if files is not None:
        jobs = jobs.join(files.groupBy("video_id").agg(F.min_by("path", "file_id").alias("path")), "video_id")
    ready = jobs.where((F.col("state") == "pending") | ((F.col("state") == "failed") & (F.col("attempts") < max_attempts)))
    needs = F.create_map(*[F.lit(x) for kv in prereqs.items() for x in kv])
    ready = ready.withColumn("_need", needs[F.col("stage")] if prereqs else F.lit(None).cast("string"))
    done = jobs.where("state = 'done'").select("video_id", F.col("stage").alias("_need"))
    free = ready.where("_need IS NULL")
    return free.unionByName(ready.where("_need IS NOT NULL").join(done, ["video_id", "_need"], "left_semi")).drop("_need")


def needs_analysis(videos: DataFrame, out: DataFrame, jobs: DataFrame, stage: str, max_attempts: int = 3) -> DataFrame:
    """Videos without output rows whose job of the stage neither finished nor gave up."""
    settled = jobs.where((F.col("stage") == stage) & ((F.col("state") == "done") | ((F.col("state") == "failed") & (F.col("attempts") >= max_attempts))))
    return videos.join(out.select("video_id"), "video_id", "left_anti").join(settled.select("video_id"), "video_id", "left_anti")


def stage_counts(jobs: DataFrame, states: Sequence[str]) -> DataFrame:
    out = jobs.groupBy("stage").pivot("state", list(states)).agg(F.count(F.lit(1)))
    return out.select("stage", *[F.coalesce(s, F.lit(0)).alias(s) for s in states])


def stage_statuses(jobs: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Per stage totals and one status; failed only where what gave up is at least what remains."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    gave_up = (F.col("state") == "failed") & (F.col("attempts") >= max_attempts)
    out = jobs.groupBy("stage").agg(
        F.count(F.lit(1)).alias("total"),
        count(F.col("state") == "done").alias("done"),
        count(gave_up).alias("gave_up"),
        count(F.col("state").isin("pending", "running") | ((F.col("state") == "failed") & ~gave_up)).alias("remaining"),
        F.max(F.when(F.col("state") == "failed", F.col("seq"))).alias("last_failure"),
    )
    status = F.when(F.col("total") == F.col("done"), "done").when((F.col("gave_up") > 0) & (F.col("gave_up") >= F.col("remaining")), "failed").when(F.col("remaining") > 0, "pending").otherwise("off")
    return out.withColumn("status", status)


def owners(items: DataFrame, *links: DataFrame) -> DataFrame:
    """(item_id, project_id) by any link table; null where no project owns an item."""
    found = None
    for link in links:
        one = items.join(link, "item_id").select("item_id", "project_id")
        found = one if found is None else found.unionByName(one)
    return items.select("item_id").join(found.distinct(), "item_id", "left")


def fingerprints(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A hash of each key's row count, largest first column and order-free row hashes: it changes when the rows do."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("decimal(38,0)")
    told = F.concat_ws("|", F.count(F.lit(1)), F.max(columns[0]), F.sum(row))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sha2(told, 256).alias("fingerprint"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= n)


def spread(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows taking every key once before any twice, keys in first-seen order.

    Ranks within keys are windows; the n rows come from a distributed top-n, in which only n rows of a task count.
    """
    per = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("round", F.row_number().over(per).cast("long")).withColumn("_first", F.first(F.struct(*order)).over(per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return marked.orderBy("round", "_first").limit(n).drop("_first")


def replace_partitions(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Replace the derived rows of the keys' buckets in one commit; other buckets stay."""
    out = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def merge_glossaries(terms: DataFrame) -> DataFrame:
    """(project_id, term): case-insensitive groups, variants in first-seen order without the term, first note.

    terms(project_id, pos, term, variants, note)
    """
    low = terms.withColumn("_k", F.lower("term"))
    heads = low.groupBy("project_id", "_k").agg(F.min_by("term", "pos").alias("term"), F.min_by("note", F.when(F.coalesce("note", F.lit("")) != "", F.col("pos"))).alias("note"))
    one = low.select("project_id", "_k", "pos", F.posexplode("variants").alias("_p", "v")).where("lower(v) <> _k")
    first = one.groupBy("project_id", "_k", F.lower("v").alias("_v")).agg(F.min(F.struct("pos", "_p", "v")).alias("x"))
    lists = first.groupBy("project_id", "_k").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("variants"))
    return heads.join(lists, ["project_id", "_k"], "left").select("project_id", "term", F.coalesce("variants", F.array().cast("array<string>")).alias("variants"), "note")


def video_glossaries(terms: DataFrame, scoped: DataFrame) -> DataFrame:
    """(video_id, term, variants, note): the terms of all projects that a video is in, merged, in order of projects."""
    here = scoped.select("project_id", "video_id").distinct()
    # a project's place comes before a term's place in it
    w = Window.partitionBy("video_id").orderBy("project_id", "pos")
    met = terms.join(here, "project_id").withColumn("pos", F.row_number().over(w))
    one = met.select(F.col("video_id").alias("project_id"), "pos", "term", "variants", "note")
    return merge_glossaries(one).withColumnRenamed("project_id", "video_id")
