"""Glossaries by automaton: equal to the expression form, and to the rule spelt out."""

import random

from pyspark.sql import functions as F

from timeweave.functions.text import correct_terms
from timeweave.operators import glossary


def plain(pairs, text):
    """Longest variants first, each from the left, nothing claimed twice, no letter or digit next to it."""
    claimed = []
    for heard, term in sorted(pairs, key=lambda p: (-len(p[0]), -len(p[0].encode()), p)):
        for a in range(len(text) - len(heard) + 1):
            b = a + len(heard)
            same = all(x.lower() == y.lower() for x, y in zip(text[a:b], heard))
            alone = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
            if same and alone and not any(a < e and b > s for s, e, _ in claimed):
                claimed.append((a, b, term))
    out, done = "", 0
    for a, b, term in sorted(claimed):
        out, done = out + text[done:a] + term, b
    return out + text[done:]


def cases(rng):
    bits = ["ab", "Ab cd", "cd", "a", "é", "É x", "x", "a.b", "\\E", "(z)", "İ", "ß"]
    pairs = sorted({(rng.choice(bits) + rng.choice(["", " " + rng.choice(bits)]), rng.choice("RSTU") + "é") for _ in range(9)})
    texts = ["".join(rng.choice(bits + [" ", " ", ",", "3", ""]) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    return pairs, texts


def test_automaton_equals_the_rule():
    rng = random.Random(4)
    for _ in range(40):
        pairs, texts = cases(rng)
        one = glossary.Corrector(pairs)
        assert [one.correct(t) for t in texts] == [plain(pairs, t) for t in texts]
    assert glossary.Corrector([]).correct("x") == "x" and glossary.Corrector([(" ", "y"), ("x", " ")]).correct("x") == "x"


def test_glossaries_by_key_either_way(spark, monkeypatch):
    pairs, texts = cases(random.Random(9))
    pairs = [p for p in pairs if "İ" not in p[0]]  # the expression's regular expressions fold it another way
    rows = [(i, k, t, 5) for i, t in enumerate(texts + [None, ""]) for k in (1, 2, 3, None)]
    df = spark.createDataFrame(rows, "id long, k long, t string, term long")
    told = spark.createDataFrame([(1, t, h) for h, t in pairs] + [(2, "TWO", "ab"), (2, None, "x"), (None, "N", "x"), (2, "y", None)], "k long, term string, heard string")
    got = glossary.correct_by_glossary(df, "t", told, "k")
    assert got.columns == df.columns
    rule = {1: pairs, 2: [("ab", "TWO")]}
    want = sorted(((i, k, plain(rule[k], t) if k in rule and t else t) for i, k, t, _ in rows), key=repr)
    assert sorted(((r.id, r.k, r.t) for r in got.collect()), key=repr) == want
    monkeypatch.setattr(glossary, "SENT_CHARS", 0)
    assert sorted(((r.id, r.k, r.t) for r in glossary.correct_by_glossary(df, "t", told, "k").collect()), key=repr) == want


def test_a_thousand_variants_as_the_expression_does(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(1000)]
    text = " ".join(rng.choice(words + ["zz", "yy."]) for _ in range(3000))
    pairs = [(w, w.upper() + "!") for w in sorted(set(words))]
    assert glossary.Corrector(pairs).correct(text) == plain([], " ".join((w.upper() + "!") if w in set(words) else w for w in text.split(" ")))
    few = pairs[:5]
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.array(F.lit(h)).alias("variants")) for h, t in few])
    assert spark.range(1).select(correct_terms(F.lit(text), terms)).first()[0] == glossary.Corrector(few).correct(text)
