"""Language identification by hyperdimensional profiles.

Every letter has a random vector of plus and minus ones. An n-gram of letters is the product of its letters' vectors, each
rotated by its place; a text is the sum of its n-grams; a language is the sum of its texts, scaled to one length. A text's
language is the prototype of largest cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.quality import held_out

DIMS = 1024
GRAM = 3
SEED = 12
UNKNOWN = "und"
#: Rows of each language that prototypes are learnt from, at most (in expectation: rows are chosen by hash).
MAX_FIT_ROWS = 5_000
#: Characters of a text that are counted at a time.
PIECE_CHARS = 1 << 20
#: Texts whose vectors are made together, and n-grams whose vectors are held at a time.
BLOCK_TEXTS, BLOCK_GRAMS = 256, 4096
#: A unit vector's entries are rounded to this part, so that sums of them don't depend on their order.
UNIT = 1 << 20
#: Fixed value: code points take 21 bits.
_BITS = 21
_SPACE = 32


def _kinds() -> np.ndarray:
    """0 for what separates words, 1 for marks, 2 for letters, by code point."""
    first = {"L": 2, "M": 1}
    return np.array([first.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


@dataclass
class Hypervectors:
    """Vectors of letters, made from the seed and the letter alone, and the texts' vectors built from them."""

    dims: int = DIMS
    gram: int = GRAM
    seed: int = SEED
    letters: dict = field(default_factory=dict)
    kinds: np.ndarray | None = None

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= 50_000:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
        """(packed n-grams, counts, whether there is a letter): words in lower case, each between single spaces."""
        if self.kinds is None:
            self.kinds = _kinds()
        text, keys, counts, any_letter = text or "", [], [], False
        tail = np.array([_SPACE], np.int64)
        for at in range(0, len(text), PIECE_CHARS):
            lowered = text[at : at + PIECE_CHARS].lower().encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(lowered, np.uint32).astype(np.int64)
            kind = self.kinds[codes]
            any_letter = any_letter or bool((kind == 2).any())
            codes = np.concatenate([tail, np.where(kind > 0, codes, _SPACE)])
            codes = codes[np.concatenate([[True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)])]
            if at + PIECE_CHARS >= len(text) and codes[-1] != _SPACE:
                codes = np.append(codes, _SPACE)
            if len(codes) >= self.gram:
                packed = np.zeros(len(codes) - self.gram + 1, np.int64)
                for i in range(self.gram):
                    packed = packed << _BITS | codes[i : len(packed) + i]
                k, n = np.unique(packed, return_counts=True)
                keys.append(k)
                counts.append(n)
            tail = codes[-(self.gram - 1) :] if self.gram > 1 else codes[:0]
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), any_letter
        if len(keys) == 1:
            return keys[0], counts[0], any_letter
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64), any_letter

    def bound(self, packed: np.ndarray) -> np.ndarray:
        """The n-grams' vectors: letters' vectors, the last as it is and each before it rotated once more, multiplied."""
        out = np.ones((len(packed), self.dims), np.int8)
        for place in range(self.gram):
            codes, back = np.unique(packed >> (_BITS * place) & ((1 << _BITS) - 1), return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), place) for c in codes])[back]
        return out.astype(np.float32)

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(one vector a text, whether it has a letter); n-grams that texts share are bound once."""
        found = [self.grams(t) for t in texts]
        sizes = [len(k) for k, _, _ in found]
        out = np.zeros((len(texts), self.dims))
        if sum(sizes):
            keys, gram = np.unique(np.concatenate([k for k, _, _ in found]), return_inverse=True)
            row, n = np.repeat(np.arange(len(texts)), sizes), np.concatenate([n for _, n, _ in found])
            order = np.argsort(gram, kind="stable")
            row, gram, n = row[order], gram[order], n[order]
            for at in range(0, len(keys), BLOCK_GRAMS):
                a, b = np.searchsorted(gram, [at, at + BLOCK_GRAMS])
                dense = np.zeros((len(texts), min(BLOCK_GRAMS, len(keys) - at)), np.float32)
                dense[row[a:b], gram[a:b] - at] = n[a:b]
                out += dense @ self.bound(keys[at : at + BLOCK_GRAMS])
        return out, np.array([has for _, _, has in found], bool)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@dataclass(frozen=True)
class Prototypes:
    """Languages in order and one unit vector each; ``mean`` is what the languages have in common, taken off texts too."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    mean: np.ndarray
    space: Hypervectors

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x, has = self.space.vectors(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        near = _unit(_unit(x) - self.mean) @ self.vectors.T
        best = near.argmax(axis=1)
        score = np.where(has, np.clip((1 + near[np.arange(len(texts)), best]) / 2, 0, 1), 0.0)
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, has)], score


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_rows: int = MAX_FIT_ROWS, dims: int = DIMS, gram: int = GRAM,
        seed: int = SEED) -> Prototypes:
    """Prototypes of every language named by a row with a text that isn't held out; of each, about ``max_rows`` rows chosen by hash.

    Every text counts alike, however long. Vectors are summed as whole numbers inside tasks and then by language and
    entry, so what comes back has one vector a language. Rows without id, text or language are not learnt from.
    """
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    usable = usable.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(max_rows)) / F.col("n"))
    spot = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # one row a language, as the model has: small enough to send everywhere, so that texts stay where they are
    rows = usable.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(spot < F.col("share")).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Hypervectors(dims, gram, seed), {}
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_TEXTS):
                part = b.slice(at, BLOCK_TEXTS)
                x, _ = space.vectors(part.column(1).to_pylist())
                whole = np.rint(_unit(x) * UNIT).astype(np.int64)
                for name, v in zip(part.column(0).to_pylist(), whole):
                    sums[name] = sums[name] + v if name in sums else v
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n] for n in names], pa.list_(pa.int64()))], ["lang", "x"])

    parts = rows.mapInArrow(bundle, "lang string, x array<long>").select("lang", F.posexplode("x").alias("at", "v"))
    got: pd.DataFrame = parts.groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("x")).toPandas()
    got = got.sort_values("lang")
    raw = _unit(np.array(got["x"].tolist(), dtype=float).reshape(len(got), dims))
    mean = raw.mean(axis=0) if len(got) > 1 else np.zeros(dims)
    return Prototypes(tuple(got["lang"]), _unit(raw - mean), mean, Hypervectors(dims, gram, seed))


def identify(docs: DataFrame, model: Prototypes, text: str = "text", into: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with each whole text's language and its score, (1 + cosine) / 2.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything where nothing was learnt; ties go
    to the language first in order; repeated rows are alike; an empty table gives an empty one. Columns named as the
    outputs are replaced, others kept.
    """
    columns = [c for c in docs.columns if c not in (into, score) or c == text]
    rows = docs.select(*columns)
    where = columns.index(text)
    kept = [i for i, c in enumerate(columns) if c not in (into, score)]
    schema = docs.select(*[columns[i] for i in kept]).schema.add(into, "string").add(score, "double")
    names = [columns[i] for i in kept] + [into, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_TEXTS):
                part = b.slice(at, BLOCK_TEXTS)
                lang, value = model.predict(part.column(where).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], pa.array(lang, pa.string()), pa.array(value, pa.float64())], names)

    return rows.mapInArrow(run, schema)
