"""Texts of a megabyte against every native pattern, and tables whose columns are named as the operators name theirs."""

import pytest
from pyspark.sql import functions as F

from timeweave.llm import bpe, chat_format, license_scan, ngram_join, pii
from timeweave.llm.queries import tokenizer_file

LONG = {
    "labels": "x@" + "a." * 100_000 + "com", "alternating": "a." * 500_000, "digits": "7" * 1_000_000, "dashes": "12-" * 300_000, "spaces": " " * 1_000_000, "at": "@" * 500_000,
    "plus": "+1 " * 300_000, "groups": "AB12 CD34 " * 100_000, "quads": "1.2." * 250_000, "quoted": '"' + "a" * 1_000_000 + '"', "local": "a" * 1_000_000 + "@b.com", "brackets": "<|" * 300_000,
    "stops": "licence. " * 100_000, "lines": "a\n" * 500_000, "slashes": "<\\" * 300_000,
}


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(LONG.values())], "doc_id long, text string")


def test_pii_reads_long_texts(spark, long_docs):
    got = {r.doc_id: r.text for r in pii.pseudonymise(long_docs, "k").collect()}
    names = list(LONG)
    assert set(got) == set(range(len(names)))
    host = got[names.index("labels")]
    assert host != LONG["labels"] and len(host) == len(LONG["labels"]) and host.endswith(".com") and host.count(".") == 100_000
    for name in ("alternating", "dashes", "spaces", "at", "digits", "lines"):
        assert got[names.index(name)] == LONG[name]


def test_license_and_chat_read_long_texts(spark, long_docs):
    assert all(r.licenses == [] for r in license_scan.scan(long_docs).collect())
    turn = F.transform(F.array("text"), lambda t: F.struct(F.lit("user").alias("role"), t.alias("content")))
    records = long_docs.select("doc_id", F.to_variant_object(F.struct(turn.alias("messages"))).alias("record"))
    back = chat_format.read_back(chat_format.format_turns(chat_format.canonical_turns(records)))
    assert {r.doc_id: r.parsed[0].text for r in back.select("doc_id", "parsed").collect()} == dict(enumerate(LONG.values()))


def test_addresses_end_before_an_empty_label(spark):
    rows = ["to x@mail.com..b.org now", "x@a..com", "x@mail.com.b1..c", "one@two.example, x@mail.com..", "a@b.co.uk"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.kinds) for r in pii.pseudonymise(df, "k", found="kinds").collect()}
    alone = spark.createDataFrame([(0, "x@mail.com")], "doc_id long, text string")
    made = pii.pseudonymise(alone, "k").first().text
    assert got[0] == (f"to {made}..b.org now", ["email"])
    assert got[1] == ("x@a..com", [])
    assert got[2] == (f"{made}.b1..c", ["email"])
    assert got[3][0].endswith(f", {made}..") and got[3][1] == ["email", "email"]
    assert got[4][0].endswith(".uk") and got[4][0] != rows[4] and got[4][1] == ["email"]


def test_long_owner_names(spark):
    owner = "the Regents of the University of " + "Somewhere and " * 40 + "Elsewhere"
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
        f"3. Neither the name of {owner} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    )
    program = f"{owner} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    plain = bsd.replace(owner, "Somebody")
    df = spark.createDataFrame([(0, bsd), (1, program), (2, plain)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan(df).collect()}
    assert got[0] == got[2] and got[1] == ["GPL-3.0-or-later"] and "BSD-2-Clause" not in got[0]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "same words here again", 5, 6, 7, 8), (2, "same words here again", 5, 6, 7, 8)], "doc_id long, text string, _told long, _text long, _place long, _MADE long")
    scanned = license_scan.scan(df)
    assert set(df.columns) < set(scanned.columns) and [tuple(r)[2:6] for r in scanned.collect()] == [(5, 6, 7, 8)] * 2
    told = bpe.tokenize(df, tokenizer_file(), decoded="decoded")
    assert [(r._text, r.decoded) for r in told.collect()] == [(6, "same words here again")] * 2
    groups = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, n_shingles long, component_id long")
    kept = ngram_join.keep_one(df, groups)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "same words here again", 5, 6, 7, 8)]
