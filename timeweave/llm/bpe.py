"""Byte-level BPE over a public vocabulary, merged with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from timeweave.llm.names import free_name

#: Fixed value: the pre-tokenisation of byte-level BPE; white space is the Unicode property.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE_ENTRIES = 1_000_000
_NONE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer(dict):
    """Encodes pieces; as a dict it maps a piece to its packed ids, filled on demand and emptied when full."""

    def __init__(self, spec: str, cache_entries: int = CACHE_ENTRIES):
        import regex

        super().__init__()
        data = json.loads(spec)
        letters, vocab = byte_letters(), data["model"]["vocab"]
        self.cache_entries = cache_entries
        self.of_byte = [0] * 256
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes_of[i] = raw = bytes(letters[c] for c in token)
            if len(raw) == 1:
                self.of_byte[raw[0]] = i
        self.merges, self.into = {}, {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 17 | vocab[b]] = rank << 31
            self.into[rank << 31] = vocab[a + b]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else lambda t: [t]
        self.pieces = regex.compile(PRETOKENS).findall

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece.

        A tree of minima stands over the pairs that begin at each position; a leaf holds rank * 2**31 + position, so
        the root is the leftmost pair of lowest rank. A merge changes three leaves at most, each in logarithmic time.
        """
        ids = list(map(self.of_byte.__getitem__, data))
        n, rank = len(ids), self.merges.get
        if n < 2:
            return ids
        half = 1 << (n - 2).bit_length()
        node = [_NONE] * (2 * half)
        for i in range(n - 1):
            hit = rank(ids[i] << 17 | ids[i + 1])
            if hit is not None:
                node[half + i] = hit + i
        for i in range(half - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        into, left = self.into, n
        while (low := node[1]) != _NONE:
            i = low & 0x7FFFFFFF
            j = after[i]
            new = ids[i] = into[low - i]
            ids[j] = -1
            left -= 1
            k = after[i] = after[j]
            changed = []
            if j < n - 1:
                changed.append((half + j, _NONE))
            if k < n:
                before[k] = i
                hit = rank(new << 17 | ids[k])
                changed.append((half + i, _NONE if hit is None else hit + i))
            else:
                changed.append((half + i, _NONE))
            p = before[i]
            if p >= 0:
                hit = rank(ids[p] << 17 | new)
                changed.append((half + p, _NONE if hit is None else hit + p))
            for at, leaf in changed:
                if node[at] == leaf:
                    continue
                node[at] = leaf
                at >>= 1
                while at:
                    a, b = node[2 * at], node[2 * at + 1]
                    if b < a:
                        a = b
                    if node[at] == a:
                        break
                    node[at] = a
                    at >>= 1
        return ids if left == n else [x for x in ids if x >= 0]

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        made = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.cache_entries:
                self.clear()
            self[piece] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers; special tokens' strings are special."""
        out = []
        for k, part in enumerate(self.split_special(text)):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out.extend(map(self.__getitem__, self.pieces(part)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, special tokens kept; bytes that aren't UTF-8 become replacement characters."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def tokenize(docs: DataFrame, tokenizer_file: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None,
             keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with the packed ids, their number, and with ``decoded`` the text read back.

    The vocabulary file is read once where the driver runs and broadcast: its size is that of a vocabulary, whatever
    the corpus. Null is encoded as the empty text, to no ids; whole texts are encoded; repeated rows alike; columns
    of the output's names are replaced.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        # a list, in which a worker process keeps its tokenizer from task to task
        spec = spark.sparkContext.broadcast([f.read()])
    made = [ids, n_tokens] + [decoded] * bool(decoded)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    schema = docs.select(*kept).schema.add(ids, "binary").add(n_tokens, "long")
    if decoded:
        schema = schema.add(decoded, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_here = spec.value
        if isinstance(kept_here[0], str):
            kept_here[0] = Tokenizer(kept_here[0])
        tok = kept_here[0]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                packed = [tok.encode(t.as_py() or "") for t in part.column(len(kept))]
                columns = [*part.columns[: len(kept)], pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
                if decoded:
                    columns.append(pa.array(list(map(tok.decode, packed)), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, kept + made)

    return docs.select(*kept, docs[text].alias(free_name(kept, "_text"))).mapInArrow(run, schema)
