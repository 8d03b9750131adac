"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a VARIANT of any layout. Its nested field paths, but for those that no layout knows, are hashed; the hash
selects one of the declared layouts, whose mapping turns the record into canonical turns. The turns are then written in one template
whose control strings cannot occur inside a text, because texts are escaped reversibly.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"
# What may follow "<" or "[" in a control string of this or of common other templates.
_REST = r"(\||/?s>|/?SYS>|/?INST\])"


@dataclass(frozen=True)
class Layout:
    """A declared layout: its field paths and how turns are read from it.

    ``paths`` are the nested shapes it has, scalars written as ``V`` and an array without elements as ``ARRAY<>``.
    Either ``items`` names an array with the given role and text fields, or ``turns`` lists (role, field) pairs of a
    flat record; values that are empty are left out where several fields make one turn (an empty ``input``), and so
    is an empty turn of a role in ``optional``.
    """

    name: str
    paths: Sequence[str]
    items: str | None = None
    role_field: str = "role"
    text_field: str = "content"
    turns: Sequence[tuple[str, str]] = ()
    roles: Mapping[str, str] = field(default_factory=dict)
    optional: Sequence[str] = ()

    def read(self, v: Column) -> Column:
        if self.items:
            kind = f"array<struct<`{self.role_field}`:string,`{self.text_field}`:variant>>"
            got = F.variant_get(v, f"$.{self.items}", kind)
            known = F.create_map(*[F.lit(x) for kv in self.roles.items() for x in kv]) if self.roles else None

            def one(t: Column) -> Column:
                role = t[self.role_field]
                role = F.coalesce(known[role], role) if known is not None else role
                return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(content(t[self.text_field]), F.lit("")).alias("text"))

            return F.transform(F.filter(got, lambda t: t.isNotNull()), one).cast(TURNS)
        parts: dict[str, list[Column]] = {}
        for role, name in self.turns:
            parts.setdefault(role, []).append(F.variant_get(v, f"$.{name}", "string"))
        made = [
            F.struct(
                F.lit(role).alias("role"),
                (F.coalesce(cols[0], F.lit("")) if len(cols) == 1 else F.array_join(F.filter(F.array(*cols), lambda c: c.isNotNull() & (c != "")), "\n\n")).alias("text"),
            )
            for role, cols in parts.items()
        ]
        return F.filter(F.array(*made), lambda t: ~t["role"].isin(*self.optional, "") | (t["text"] != "")).cast(TURNS)


def content(v: Column) -> Column:
    """A turn's text: of an array of parts the parts' texts, joined; of any other value its string."""
    parts = F.variant_get(v, "$", "array<variant>")
    text = F.transform(parts, lambda p: F.coalesce(F.when(F.schema_of_variant(p).startswith("OBJECT"), F.variant_get(p, "$.text", "string")).otherwise(F.variant_get(p, "$", "string")), F.lit("")))
    return F.when(v.isNull(), None).when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(text, "")).otherwise(F.variant_get(v, "$", "string"))


def _listed(name: str, role: str, text: str) -> tuple[str, ...]:
    """The shapes of a layout of turns in an array: of texts, of texts in parts, and without turns."""
    item = lambda t: "OBJECT<" + ", ".join(sorted((f"{text}: {t}", f"{role}: V"))) + ">"
    return tuple(f"OBJECT<{name}: ARRAY<{x}>>" for x in (item("V"), item("ARRAY<OBJECT<text: V, type: V>>"), item("ARRAY<V>"), ""))


def _flat(*names: str) -> tuple[str]:
    return ("OBJECT<" + ", ".join(f"{n}: V" for n in sorted(names)) + ">",)


_SHAREGPT = {"human": "user", "gpt": "assistant", "bot": "assistant"}
LAYOUTS = (
    Layout("turns", _listed("turns", "role", "text"), items="turns", text_field="text"),
    Layout("messages", _listed("messages", "role", "content"), items="messages"),
    Layout("conversations", _listed("conversations", "from", "value"), items="conversations", role_field="from", text_field="value", roles=_SHAREGPT),
    Layout("instruction_input", _flat("input", "instruction", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", _flat("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_completion", _flat("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", _flat("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", _flat("answer", "question"), turns=(("user", "question"), ("assistant", "answer"))),
    Layout("system_instruction", _flat("input", "instruction", "output", "system"), turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system",)),
    Layout("system_prompt", _flat("prompt", "response", "system"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
)


def field_paths(v: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """The nested shape of a VARIANT, scalar kinds written as ``V`` (so a null or a number keeps the shape).

    Fields that no layout knows (an id, a name, metadata) are left out, nested ones up to four levels deep.
    """
    kinds = r"\b(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|BINARY|FLOAT|DATE|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+, ?\d+\))(?=[,>]|$)"
    shape = F.regexp_replace(F.regexp_replace(F.schema_of_variant(v), "ARRAY<VOID>", "ARRAY<>"), kinds, "V")
    known = "|".join(sorted({w for x in layouts for p in x.paths for w in re.findall(r"(\w+):", p)}))
    odd = rf"(?<=<|, )(?!(?:{known}): )[^<>,: ][^<>,:]*: (?:V|ARRAY<(?:V|OBJECT<>)?>|OBJECT<>)(?:, |(?=>))"
    for _ in range(4):
        shape = F.regexp_replace(F.regexp_replace(shape, odd, ""), ", >", ">")
    return shape


def fingerprint(v: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the record's nested field paths."""
    return F.xxhash64(field_paths(v, layouts))


def escape(c: Column) -> Column:
    """Put one more backslash inside every control string; :func:`unescape` takes it out again."""
    return F.regexp_replace(c, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def canonical_turns(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` (name, or null when no declared layout has the record's fingerprint) and ``turns``.

    A null record or an unknown layout has null ``turns``, a known one without turns has none; null roles and texts
    become empty strings; a repeated record gives a repeated row, an empty table an empty one. Names ``layout`` and
    ``turns`` in the input are replaced, other columns are kept.
    """
    v = F.col(record)

    def read(fp: Column) -> Column:
        out = None
        for x in layouts:
            hit, got = fp.isin([_hash(records, p) for p in x.paths]), F.struct(F.lit(x.name).alias("layout"), x.read(v).alias("turns"))
            out = F.when(hit, got) if out is None else out.when(hit, got)
        return out

    told = F.transform(F.array(F.when(v.isNotNull(), fingerprint(v, layouts))), read)[0]
    rest = [c for c in records.columns if c not in ("layout", "turns")]
    name = "_told"
    while name in rest:
        name += "_"
    return records.select(*rest, told.alias(name)).select(*rest, f"{name}.layout", f"{name}.turns")


def _hash(df: DataFrame, shape: str) -> int:
    """The fingerprint of a declared shape."""
    if shape not in _HASHES:
        _HASHES[shape] = df.sparkSession.range(1).select(F.xxhash64(F.lit(shape)).alias("h")).first()["h"]
    return _HASHES[shape]


_HASHES: dict[str, int] = {}


def format_turns(df: DataFrame, turns: str = "turns", loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``.

    ``loss_mask`` has one span for each turn whose role is in ``loss_roles``: the turn's position, where its
    block begins in ``formatted`` (``block_at``), and the span's start and length inside the block, all in code
    points and from 0. No turns give an empty string and an empty mask; null turns give nulls. Texts are written whole,
    however long; columns of these two names are replaced.
    """
    t = F.col(turns)

    def block(x: Column) -> Column:
        return F.concat(F.lit(ROLE), escape(x["role"]), F.lit(TEXT), escape(x["text"]), F.lit(END))

    def span(acc: Column, x: Column) -> Column:
        start = F.lit(len(ROLE) + len(TEXT)) + F.length(escape(x["role"]))
        n = F.length(escape(x["text"]))
        one = F.struct(acc["i"].alias("turn"), acc["at"].alias("block_at"), start.cast("int").alias("start"), n.cast("int").alias("length"))
        spans = F.when(x["role"].isin(*loss_roles), F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"])
        return F.struct((acc["i"] + 1).alias("i"), (acc["at"] + F.length(block(x))).cast("bigint").alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<turn:int,block_at:bigint,start:int,length:int>>").alias("spans"))
    return df.withColumns({"formatted": F.array_join(F.transform(t, block), ""), "loss_mask": F.aggregate(t, zero, span, lambda a: a["spans"])})


def read_back(df: DataFrame) -> DataFrame:
    """Adds ``parsed`` (turns read from ``formatted``) and ``loss_texts`` (unescaped text under each mask span)."""
    blocks = F.split("formatted", r"(?<=<\|end\|>\n)")
    blocks = F.filter(blocks, lambda b: b != "")

    def turn(b: Column) -> Column:
        head = F.substring_index(b, TEXT, 1)
        role = unescape(F.substring(head, len(ROLE) + 1, 2**31 - 1))
        text = F.substring_index(F.substring_index(b, TEXT, -1), "<|end|>", 1)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    def told(b: Column) -> Column:
        under = F.transform("loss_mask", lambda s: unescape(F.substring(F.element_at(b, s["turn"] + 1), s["start"] + 1, s["length"])))
        return F.struct(F.transform(b, turn).alias("parsed"), under.alias("loss_texts"))

    rest = [c for c in df.columns if c not in ("parsed", "loss_texts")]
    name = "_told"
    while name in rest:
        name += "_"
    return df.select(*rest, F.transform(F.array(blocks), told)[0].alias(name)).select(*rest, f"{name}.parsed", f"{name}.loss_texts")
