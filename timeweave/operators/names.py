"""Free file names: where a name is taken, ``stem_1.ext``, ``stem_2.ext``, ... until one is free, file by file in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.operators.grouped import fold
from timeweave.sources.scratch import materialize, release


def _stem(name: Column) -> tuple[Column, Column]:
    """(stem, extension) of a file name; a name that only begins with a dot has no extension."""
    split = name.rlike(r"^.+\.[^.]*$")
    return F.when(split, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name), F.when(split, F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise("")


def _numbered(name: Column) -> tuple[Column, Column, Column]:
    """(stem, extension, number) of the family in which a name is a numbered one; null where it can't be."""
    stem, ext = _stem(name)
    # a name that ends in a dot has no extension to number it by, so it is nobody's numbered name
    hit = stem.rlike(r"^(.+)_([1-9][0-9]{0,17})$") & ~name.rlike(r"^.+\.$")
    part = lambda i: F.when(hit, F.regexp_extract(stem, r"^(.+)_([1-9][0-9]{0,17})$", i))
    return part(1), F.when(hit, ext), part(2).cast("long")


def collision_free_names(files: DataFrame, existing: DataFrame, order: Sequence[str] = ("file_id",)) -> DataFrame:
    """``new_name`` within each folder: file by file in ``order``, the name itself if nobody has it, else the first free
    of name_1, name_2, ...; nobody gets the name of another or of what exists.

    files(file_id, folder_id, name), existing(folder_id, name). Names of one stem and extension are a family, which is walked
    as a stream in order and remembers only the numbers taken out of turn. Families meet only where a numbered name of one is
    the plain name of another (``a_1.mp4`` among ``a.mp4``): there the numbered name's family tells from which file on
    its plain name is taken, and the other is walked after it. Rounds are as many as names are nested so, usually one or two.
    """
    stem, ext = _stem(F.col("name"))
    place = F.struct(*order)
    all_ = files.select("file_id", "folder_id", "name", stem.alias("stem"), ext.alias("ext"), place.alias("at"))
    left = materialize(all_, "unnamed")
    bases = left.groupBy("folder_id", "name").agg(F.min("at").alias("at"))
    s, e, k = _numbered(F.col("name"))
    # who wants a numbered name of another family as its plain one, and from when on
    wanted = bases.select("folder_id", s.alias("stem"), e.alias("ext"), k.alias("number"), "at").where("number IS NOT NULL")
    taken = existing.select("folder_id", "name").distinct()
    xs, xe = _stem(F.col("name"))
    here = taken.select("folder_id", xs.alias("stem"), xe.alias("ext"), "name", F.lit(None).cast("long").alias("number"))
    here = here.unionByName(taken.select("folder_id", s.alias("stem"), e.alias("ext"), F.lit(None).cast("string").alias("name"), k.alias("number")).where("number IS NOT NULL"))
    families = left.select("folder_id", "stem", "ext").distinct()
    wanted = materialize(wanted.join(families, ["folder_id", "stem", "ext"], "left_semi"), "wanted")
    child = child_of(wanted)

    def step(rows):
        numbers, names, low = set(), set(), 1
        for r in rows:
            if r.kind == "exists":
                if r.name is not None:
                    names.add(r.name)
                else:
                    numbers.add(r.number)
            elif r.kind == "wanted":
                if r.number >= low and r.number not in numbers:
                    numbers.add(r.number)  # free so far, so it is that family's
            else:
                if r.name not in names:
                    names.add(r.name)
                    yield r.file_id, r.name, None
                    continue
                while low in numbers:
                    numbers.discard(low)
                    low += 1
                new = low
                low += 1
                yield r.file_id, f"{r.stem}_{new}" + (f".{r.ext}" if r.ext else ""), new

    at_type = left.schema["at"].dataType
    blank = lambda name, kind: F.lit(None).cast(kind).alias(name)
    event = ["folder_id", "stem", "ext", "turn", "at", "kind", "name", "number", "file_id"]
    done: DataFrame | None = None
    told: DataFrame | None = None  # plain names that their parents' families took
    waiting = families.join(child, ["folder_id", "stem", "ext"], "left_semi")
    ready = families.join(child, ["folder_id", "stem", "ext"], "left_anti")
    scratch = [left, wanted]
    id_kind = files.schema["file_id"].dataType.simpleString()
    while True:
        mine = lambda df: df.join(ready, ["folder_id", "stem", "ext"], "left_semi")  # noqa: B023, E731
        events = mine(here).select("folder_id", "stem", "ext", F.lit(0).alias("turn"), F.lit(None).cast(at_type).alias("at"), F.lit("exists").alias("kind"), "name", "number", blank("file_id", id_kind))
        if told is not None:
            events = events.unionByName(mine(told).select("folder_id", "stem", "ext", F.lit(0).alias("turn"), F.lit(None).cast(at_type).alias("at"), F.lit("exists").alias("kind"), "name", blank("number", "long"), blank("file_id", id_kind)))
        events = events.unionByName(mine(wanted).select("folder_id", "stem", "ext", F.lit(1).alias("turn"), "at", F.lit("wanted").alias("kind"), blank("name", "string"), "number", blank("file_id", id_kind)))
        events = events.unionByName(mine(left).select("folder_id", "stem", "ext", F.lit(1).alias("turn"), "at", F.lit("file").alias("kind"), "name", blank("number", "long"), "file_id"))
        named = fold(events.select(*event), ["folder_id", "stem", "ext"], ["turn", "at", "file_id"], f"file_id {id_kind}, new_name string, number long", step, lazy=True)
        made = materialize(named, "named")
        scratch.append(made)
        done = made if done is None else done.unionByName(made)
        if waiting.isEmpty():
            break
        # a numbered name that went to this round's families and that another wants plainly
        gone = made.where("number IS NOT NULL").join(wanted.select("folder_id", "stem", "ext", "number"), ["folder_id", "stem", "ext", "number"], "left_semi")
        stem2, ext2 = _stem(F.col("new_name"))
        more = gone.select("folder_id", stem2.alias("stem"), ext2.alias("ext"), F.col("new_name").alias("name"))
        told = more if told is None else told.unionByName(more)
        open_children = waiting.join(child_of(wanted.join(waiting, ["folder_id", "stem", "ext"], "left_semi")), ["folder_id", "stem", "ext"], "left_semi")
        ready = materialize(waiting.join(open_children, ["folder_id", "stem", "ext"], "left_anti"), "ready")
        waiting = materialize(open_children, "waiting")
        scratch += [ready, waiting]
    out = materialize(files.select("file_id", "folder_id", "name").join(done.select("file_id", "new_name"), "file_id"), "targets")
    for df in scratch:
        release(df)
    return out


def child_of(wanted: DataFrame) -> DataFrame:
    """The families whose plain names are numbered ones of the rows' families."""
    return wanted.select("folder_id", F.concat_ws("_", "stem", F.col("number").cast("string")).alias("stem"), "ext").distinct()
