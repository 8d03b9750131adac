"""Correction of texts by glossaries: every variant that was heard becomes its term, in one pass over the text.

A glossary is one automaton, made once a task from variants that are sent to all of them; a text is read once however many
variants there are. Longer variants claim first, then earlier ones in the text, and what is claimed no other touches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import correct_terms

#: Characters of all glossaries together that are sent to every task; beyond, each row meets its own glossary in a join.
SENT_CHARS = 50_000_000


class Corrector:
    """One glossary: pairs (heard, term), matched in any case where no letter or digit stands next to them."""

    def __init__(self, pairs: list[tuple[str, str]]):
        import ahocorasick

        clean = [(h.strip(), t.strip()) for h, t in pairs if h and t]
        ranked = sorted((-len(h), -len(h.encode("utf-8", "surrogatepass")), h, t) for h, t in clean if h and t)
        self.folds: dict[str, str] = {}
        self.terms = [t for _, _, _, t in ranked]
        self.found = ahocorasick.Automaton()
        for rank, (_, _, heard, _) in enumerate(ranked):
            key = self.fold(heard)
            if key not in self.found:
                self.found.add_word(key, (rank, len(heard)))
        if ranked:
            self.found.make_automaton()

    def fold(self, text: str) -> str:
        """Lower case, one character for each, so that places stay."""
        low = text.lower()
        if len(low) == len(text):
            return low
        return "".join(x if len(x := c.lower()) == 1 else c for c in text)

    def correct(self, text: str | None) -> str | None:
        if not text or not self.terms:
            return text
        n, hits = len(text), []
        for last, (rank, size) in self.found.iter(self.fold(text)):
            a, b = last + 1 - size, last + 1
            if not (a and text[a - 1].isalnum() or b < n and text[b].isalnum()):
                hits.append((rank, a, b))
        if not hits:
            return text
        starts: list[int] = []
        claimed: list[tuple[int, int, int]] = []
        for rank, a, b in sorted(hits):
            at = bisect_left(starts, a)
            if at < len(starts) and starts[at] < b or at and claimed[at - 1][1] > a:
                continue
            starts.insert(at, a)
            claimed.insert(at, (a, b, rank))
        out, done = [], 0
        for a, b, rank in claimed:
            out += [text[done:a], self.terms[rank]]
            done = b
        return "".join([*out, text[done:]])


def correct_by_glossary(df: DataFrame, text: str, glossary: DataFrame, key: str) -> DataFrame:
    """``df`` with ``text`` corrected by the glossary of its ``key``: glossary(key, term, heard), a row a variant.

    Null texts stay null; rows whose key has no glossary, or is null, stay as they are.
    """
    pairs = glossary.where(F.col(key).isNotNull() & F.col("term").isNotNull() & F.col("heard").isNotNull()).select(F.col(key).alias("key"), "term", "heard")
    size = pairs.agg(F.sum(F.length("term") + F.length("heard")).alias("n")).first()["n"] or 0
    if size > SENT_CHARS:
        held = pairs.groupBy("key", "term").agg(F.collect_list("heard").alias("variants"))
        held = held.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("term", "variants")).alias("terms of the glossary"))
        met = df.join(held, key, "left")
        columns = [F.coalesce(correct_terms(F.col(text), F.col("terms of the glossary")), F.col(text)).alias(text) if c == text else F.col(c) for c in df.columns]
        return met.select(*columns)
    told: dict = {}
    for r in pairs.collect():
        told.setdefault(r["key"], []).append((r["heard"], r["term"]))
    sent = df.sparkSession.sparkContext.broadcast(told)
    columns, at, of = df.columns, df.columns.index(text), df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for b in batches:
            new = []
            for k, t in zip(b.column(of).to_pylist(), b.column(at).to_pylist()):
                if k not in made:
                    made[k] = Corrector(sent.value.get(k, []))
                new.append(made[k].correct(t))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)], columns)

    return df.mapInArrow(run, df.schema)
