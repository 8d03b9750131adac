"""WARC archives with a two-level capture index.

Archives: one gzip member per record, written by Spark's text sink, so the sink's commit protocol covers lost
executors and any Hadoop file system will do. What the sink puts after each row is an empty gzip member, which
readers of concatenated members pass over.

Index: captures sorted by reversed-host URL key, in compressed blocks; a sparse directory holds each block's first
key. A lookup finds its shard among the shards' first keys, its block in the shard's directory and its captures in
the block, each by binary search; shards that no key falls into are not read. A fetch then opens the archive, goes to
the record's offset and reads its length.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.sources.scratch import materialize

EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_LINES = 3000
LEVEL = 4
#: Bytes of an archive, but for its last record; stretches of an archive that different tasks read from.
ARCHIVE_BYTES, STRETCH_BYTES = 64 << 20, 16 << 20


def base32_digest(sha1_hex: Column) -> Column:
    """Bare upper-case base32 of a 160-bit digest in hex: 20 bits are 5 hex digits and 4 letters."""

    def letter(j: Column) -> Column:
        group = F.conv(F.substring(sha1_hex, F.floor(j / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        at = F.floor(group / F.pow(F.lit(2), (15 - 5 * (j % 4)))).cast("int") % 32
        return F.substring(F.lit(BASE32), at + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to): the page of largest id with the same payload, null for that page itself.

    Only ids and digests are shuffled. Digests of more than one in a thousand pages are at most a thousand, so
    these are broadcast; the others are joined by digest. Rows repeating the page of largest id are responses too.
    """
    small = materialize(
        pages.select(F.col(page_id).alias("page_id"), F.sha1(F.coalesce(html, F.lit(""))).alias("sha1"), F.octet_length(F.coalesce(html, F.lit(""))).alias("n")).distinct(),
        "digests",
    )
    groups = materialize(small.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("c")).where("c > 1"), "groups")
    limit = max(1000, small.count() // 1000)
    heavy = F.broadcast(groups.where(F.col("c") > limit).select("sha1", "winner"))
    tried = small.join(heavy, "sha1", "left")
    light = tried.where("winner IS NULL").drop("winner").join(groups.where(F.col("c") <= limit).select("sha1", "winner"), "sha1", "left")
    both = tried.where("winner IS NOT NULL").unionByName(light)
    return both.select("page_id", "sha1", F.when(~F.col("winner").eqNullSafe(F.col("page_id")), F.col("winner")).alias("refers_to"))


def clean(c: Column) -> Column:
    """A URL as a record holds it: null empty, line ends percent-encoded."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "%0D"), "\n", "%0A")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: str = "2024-01-01T00:00:00Z",
               min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A response or revisit record for every row, in gzip members below ``path``.

    A task begins a new archive once one has ``archive_bytes``. Null html is an empty payload, null URLs are empty;
    line ends inside URLs are percent-encoded. Payloads of fewer than ``min_bytes`` bytes are always responses.
    Repeated rows are one capture written again: their records share an id, and those of the page that others revisit
    are all responses. Other columns are not read; an empty table writes no record.
    """
    types = revisits(pages, page_id, html, min_bytes)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), clean(F.col(url)).alias("url"), body.alias("body"), F.sha1(body).alias("sha1"))
    same = rows["page_id"].eqNullSafe(types["page_id"]) & (rows["sha1"] == types["sha1"])
    typed = rows.join(types, same).select(rows["page_id"], "url", "body", rows["sha1"], "refers_to")
    again = F.col("refers_to").isNotNull()
    n = F.octet_length("body").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(captured)),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_digest(F.col("sha1")))),
        line("WARC-X-Payload-Length", n),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    record = typed.withColumn("_block", block).select(F.concat(head, F.col("_block"), F.lit("\r\n\r\n")).cast("binary").alias("record"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for b in batches:
            out, archive = [], []
            for x in b.column(0):
                z = zlib.compressobj(LEVEL, wbits=31)
                out.append(z.compress(x.as_py()) + z.flush())
                archive.append(written // archive_bytes)
                written += len(out[-1]) + len(EMPTY_MEMBER)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(archive, pa.int32())], ["member", "archive"])

    packed = record.mapInArrow(members, "member binary, archive int").select(F.col("member").cast("string").alias("value"), "archive")
    packed.write.partitionBy("archive").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every gzip member that has content."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, start, out = zlib.decompressobj(wbits=31), at, []
        while not z.eof:
            chunk = view[at : at + 65536]
            if not len(chunk):
                raise ValueError("archive ends inside a record")
            out.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        content = b"".join(out)
        if content:
            yield start, at - start, content


def parse_record(content: bytes) -> dict:
    """The header fields of a record, its ``payload``, and the payload's own length and digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    fields["payload"] = payload
    return fields


def _page(urn: str | None) -> int | None:
    got = urn[len("<urn:page:") : -1] if urn else "null"
    return None if got == "null" else int(got)


CAPTURE = "page_id long, url string, captured string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long"


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for every record below ``path``: the capture, where it lies, and with ``payload`` its payload.

    A response whose payload doesn't have the digest its header states is an error. One task holds one archive at
    a time, whose size is bounded when it is written. No archive gives no row.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for offset, length, content in _members(data.as_py()):
                    rows.append(_capture(content) + [file, offset, length])
                    if len(rows) >= 2000:
                        yield _batch(rows, payload)
                        rows = []
                if rows:
                    yield _batch(rows, payload)

    return _archives(spark, path).mapInArrow(parse, CAPTURE + (", payload binary" if payload else ""))


def _archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true")
    return files.load(path).select("path", "content")


def _capture(content: bytes) -> list:
    """What CAPTURE lists of a record but its place, then its payload; checks a response's digest."""
    f = parse_record(content)
    digest, again = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"] != "response"
    if not again and base64.b32encode(hashlib.sha1(f["payload"]).digest()).decode() != digest:
        raise ValueError(f"{f['WARC-Record-ID']}: payload and digest differ")
    size = int(f["WARC-X-Payload-Length"]) if again else len(f["payload"])
    return [f["payload"], _page(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Type"], digest, size, _page(f.get("WARC-Refers-To"))]


def _batch(rows: list, payload: bool) -> pa.RecordBatch:
    """Rows of a payload and CAPTURE's columns as a batch, the payload last or left out."""
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in CAPTURE.split(", ")]
    first, *columns = zip(*rows, strict=True)
    made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made + ([pa.array(first, pa.binary())] if payload else []), names + ["payload"] * payload)


def surt(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then port, path and query, lower-cased, without scheme or fragment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://([^/?#]*@)?|#.*$", "")
    host = F.regexp_extract(bare, "^[^/?:]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substring(bare, F.length(host) + 1, F.length(bare)))


BLOCKS = "block int, first_key string, last_key string, n int, data binary, shard int"


def build_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Sort captures by (key, time, page) into compressed blocks at ``path``/blocks, and their directory beside it.

    A shard is one range of keys; equal keys share a shard, whose rows are streamed block by block, so that a key
    with very many captures makes many blocks rather than one large one.
    """
    lines = captures.withColumn("key", surt(F.col("url")))
    ordered = lines.repartitionByRange("key", "page_id", "offset").withColumn("shard", F.spark_partition_id()).sortWithinPartitions("key", "captured", "page_id", "file", "offset")

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = [], 0
        names = ["key"] + [x.split()[0] for x in CAPTURE.split(", ")]

        def pack(rows: pd.DataFrame, number: int) -> pd.DataFrame:
            data = zlib.compress(rows[names].to_json(orient="split", index=False).encode(), LEVEL)
            return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "block": [number], "first_key": [rows["key"].iloc[0]], "last_key": [rows["key"].iloc[-1]], "n": [len(rows)], "data": [data]})

        for f in frames:
            f = f.astype({"page_id": "Int64", "refers_to": "Int64"})
            held.append(f)
            while sum(map(len, held)) >= block_lines:
                whole = pd.concat(held, ignore_index=True)
                yield pack(whole.iloc[:block_lines], number)
                held, number = [whole.iloc[block_lines:]], number + 1
        if held and sum(map(len, held)):
            yield pack(pd.concat(held, ignore_index=True), number)

    made = ordered.mapInPandas(blocks, "shard int, block int, first_key string, last_key string, n int, data binary")
    made.write.partitionBy("shard").parquet(f"{path}/blocks")
    captures.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", "block", "first_key", "last_key", "n").write.parquet(f"{path}/directory")


def _unpack(data: bytes) -> pd.DataFrame:
    import json

    got = json.loads(zlib.decompress(data))
    return pd.DataFrame(got["data"], columns=got["columns"], dtype=object)


def index_captures(spark: SparkSession, path: str) -> DataFrame:
    """Every capture, decoded from the index's blocks."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["data"]:
                yield _unpack(data).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "offset": "int64", "length": "int64"})

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("data").mapInPandas(decode, "key string, " + CAPTURE)


def lookup(spark: SparkSession, path: str, urls: DataFrame, url: str = "url") -> DataFrame:
    """The captures of every URL asked for: (asked, key, capture columns).

    The shards' first keys (one short string a shard, as many as the index has partitions) are the top level; a
    shard's directory meets the keys that fall into it; only blocks named there are decoded. A null URL finds the
    captures of an empty one; an unknown one, or an empty index, gives no row.
    """
    directory = spark.read.parquet(f"{path}/directory")
    tops = sorted((r["k"], r["last"], r["shard"]) for r in directory.groupBy("shard").agg(F.min("first_key").alias("k"), F.max("last_key").alias("last")).collect())

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, lasts = [t[0] for t in tops], [t[1] for t in tops]
        for f in frames:
            rows = [(a, k, tops[i][2]) for a, k in zip(f["asked"], f["key"], strict=True) for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pd.DataFrame(rows, columns=["asked", "key", "shard"])

    def find(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        firsts, lasts, numbers = list(blocks["first_key"]), list(blocks["last_key"]), list(blocks["block"])
        rows = [(a, k, s, numbers[i]) for a, k, s in zip(asked["asked"], asked["key"], asked["shard"], strict=True)
                for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
        return pd.DataFrame(rows, columns=["asked", "key", "shard", "block"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block's row comes before those who ask for it: it is decoded once, and they go past it."""
        now, lines, keys = None, None, []
        for f in frames:
            out = []
            for shard, block, a, k, data in zip(f["shard"], f["block"], f["asked"], f["key"], f["data"], strict=True):
                if data is not None:
                    now, lines = (shard, block), _unpack(data)
                    keys = list(lines["key"])
                elif now == (shard, block):
                    hit = lines.iloc[bisect.bisect_left(keys, k) : bisect.bisect_right(keys, k)]
                    out.append(hit.assign(asked=a))
            if out:
                yield pd.concat(out, ignore_index=True).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "offset": "int64", "length": "int64"})

    keyed = urls.select(F.col(url).alias("asked"), surt(F.col(url)).alias("key")).distinct()
    routed = keyed.mapInPandas(route, "asked string, key string, shard int")
    found = materialize(routed.groupBy("shard").cogroup(directory.groupBy("shard")).applyInPandas(find, "asked string, key string, shard int, block int"), "found")
    # as many shards as the index has partitions: the others' files are not opened
    wanted = [r["shard"] for r in found.select("shard").distinct().collect()]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("shard").isin(wanted)).select("shard", "block", "data")
    blocks = blocks.join(found.select("shard", "block").distinct(), ["shard", "block"], "left_semi")
    names = ["shard", "block", "asked", "key", "data"]
    text = lambda: F.lit(None).cast("string")
    held = blocks.withColumns({"asked": text(), "key": text()}).select(*names)
    met = held.unionByName(found.withColumn("data", F.lit(None).cast("binary")).select(*names))
    dealt = met.repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("data").isNull())
    return dealt.mapInPandas(read, "asked string, key string, " + CAPTURE)


def _opener(path: str):
    """A function that opens files like ``path`` for seeking, or None where only Spark's readers reach them."""
    import re

    from pyarrow import fs

    plain = lambda p: re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", p if re.match("^[a-z0-9]+:/", p) else f"file://{p}"))
    try:
        fs.FileSystem.from_uri(plain(path))
    except (OSError, ValueError, pa.ArrowException):
        return None

    def opened(p: str):
        from urllib.parse import unquote

        system, at = fs.FileSystem.from_uri(plain(p))
        return system.open_input_file(unquote(at) if plain(p).startswith("file:") else at)

    return opened


def fetch(spark: SparkSession, archives: str, captures: DataFrame) -> DataFrame:
    """The records of captures (file, offset, length) as CAPTURE's columns and ``payload``, each read by its range.

    Captures are dealt by stretches of an archive, so an archive that all ask for is read by many tasks, each going
    forward through its stretch. Where only Spark's readers reach the archives, those asked for, of bounded size, are
    read whole and cut instead. A record that differs from its digest is an error.
    """
    need = captures.select("file", "offset", "length").distinct()
    opened, kind = _opener(archives), CAPTURE + ", payload binary"

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for b in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    name, source = file, opened(file)
                source.seek(offset)
                content = next(_members(source.read(length)))[2]
                rows.append(_capture(content) + [file, offset, length])
                held += len(content)
                if held >= 32 << 20:
                    yield _batch(rows, True)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, True)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data = data.as_py()
                rows = [_capture(next(_members(data[p["offset"] : p["offset"] + p["length"]]))[2]) + [file, p["offset"], p["length"]] for p in places.as_py()]
                for at in range(0, len(rows), 1000):
                    yield _batch(rows[at : at + 1000], True)

    if opened:
        dealt = need.repartition("file", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("file", "offset")
        return dealt.mapInArrow(ranges, kind)
    places = need.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    return _archives(spark, archives).join(places, "path").select("path", "content", "places").mapInArrow(cuts, kind)
