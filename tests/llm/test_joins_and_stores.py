"""N-gram join, nearest neighbours, embedding duplicates, WARC and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import ann, hnsw, ngram_join, warc


def brute_groups(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b)
            if a and b and (100 * same >= percent * (len(a) + len(b) - same) or rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows)))


def test_similarity_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = word()
            rows.append((i, " ".join(text)))
            i += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "w " * 30_000), (905, "w " * 30_000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n long")
    want = brute_groups(rows, 3, 80)
    got = sorted(map(tuple, ngram_join.similarity_groups(df, 3, 80).collect()))
    assert got == want
    monkeypatch.setattr(ngram_join, "HEAVY_BUCKET", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", 2000)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    assert sorted(map(tuple, ngram_join.similarity_groups(df, 3, 80).collect())) == want
    kept = ngram_join.keep_one(df, spark.createDataFrame(want, "doc_id long, n_shingles long, component_id long"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    assert ngram_join.similarity_groups(df.limit(0)).count() == 0


def test_combinations_keep_every_pair():
    rng = np.random.default_rng(3)
    counts = np.zeros(1 << ngram_join.COUNT_BITS, np.int32)
    universe = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    counts[ngram_join._slot(universe[:300])] = 1000
    signer = ngram_join.Signer(80, counts, np.sort(universe[:200]), 64)
    for _ in range(300):
        n = int(rng.integers(1, 150))
        a = np.unique(rng.choice(universe, n))
        b = a.copy()
        for _ in range(int(rng.integers(0, max(1, n // 6)))):
            b[rng.integers(len(b))] = rng.choice(universe)
        b = np.unique(b)
        same = len(np.intersect1d(a, b))
        if 100 * same >= 80 * (len(a) + len(b) - same):
            assert len(np.intersect1d(signer.sign(a)[0], signer.sign(b)[0]))


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


ODD = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] + [1.0] * 15, 0), (9004, [None] + [1.0] * 15, 0), (9005, [float("inf")] + [1.0] * 15, 0), (9006, [1.0, 2.0], 0), (9007, [], 0)]


def test_nearest_neighbours_recall(spark):
    x = np.random.default_rng(1).standard_normal((1500, 16)).astype(np.float32)
    x[700] = x[0]
    df = vectors(spark, x, ODD)
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), 10).collect()
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert hit >= 0.9 * 150
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def exact_nearest(rows, queries, k):
    """(query_id, rank, vec_id) by comparing all; rows are (id, vector) pairs, of an id the nearest counts."""
    out = []
    for q, v in queries:
        best = {}
        for i, w in rows:
            if i != q:
                best[i] = min(best.get(i, np.inf), float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())))
        out += [(q, n + 1, i) for n, (i, _) in enumerate(sorted(best.items(), key=lambda p: (p[1], p[0]))[:k])]
    return out


def test_nearest_neighbours_odd_tables(spark):
    """Few rows, a far outlier, many copies, repeated ids and one query split over large buckets."""
    few = [(i, [float(i), 1.0]) for i in (100, 1, 2, 2, 200)] + [(None, [1.0, 2.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df.where("vec_id % 100 = 0"), 10).collect())
    known = [r for r in few if r[0] is not None]
    assert got == sorted(exact_nearest(known, [r for r in known if r[0] % 100 == 0], 10))
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 8))
    x[:400] = x[0] + 1e-9 * rng.standard_normal((400, 8))
    x[500] = 1e12
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(df, df.where("vec_id % 100 = 0"), 10).collect()}
    want = exact_nearest(rows, rows[::100], 10)
    assert set(got) == {(q, r) for q, r, _ in want} and all(got[500, r] == v for q, r, v in want if q == 500)


def test_probes_come_in_descending_order_of_success():
    rng = np.random.default_rng(9)
    at = rng.uniform(-3, 3, 4)
    cells = ann.probe_sequence(at, 0.9, 0.8)
    edge = lambda c: ann._normal_cdf((c - at) / 0.9)
    chance = np.prod(edge(cells + 1) - edge(cells), axis=1)
    assert (np.diff(chance) <= 1e-12).all() and len({tuple(c) for c in cells}) == len(cells)
    assert chance.sum() >= 0.8 > chance[:-1].sum() and (cells[0] == np.floor(at)).sum() >= 3
    assert ann.probe_sequence(at, 50.0, 0.8, 100) is None


def test_embedding_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    x[300:600] = x[0] + 0.05 * rng.standard_normal((300, 16))
    x[600:620] = x[1]
    x = x.astype(np.float32)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(vectors(spark, x, ODD)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    label = np.arange(900)
    while (new := np.array([label[r].min() for r in near]) if True else None) is not None and (new != label).any():
        label = new
    assert all(got[i] == (near[i].sum() - 1, label[i], label[i] == i) for i in range(900))
    assert all(got[i] == (0, i, True) for i in range(9001, 9008))
    assert hnsw.near_duplicates(vectors(spark, x[:0])).count() == 0
    same = spark.createDataFrame([(5, [1.0, 1e-200]), (5, [1.0, 1e-200]), (6, [1e-200, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in hnsw.near_duplicates(same).collect()), key=str)
    assert rows == [(0, 0, None), (5, 2, 5), (5, 2, 5), (6, 2, 5)]


def test_links_count_at_both_ends_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(31)
    centre = rng.standard_normal((3, 16))
    x = np.vstack([c + 0.25 * rng.standard_normal((n, 16)) for c, n in zip(centre, (90, 40, 2))] + [rng.standard_normal((60, 16))])
    x = np.vstack([x, x[:3]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    monkeypatch.setattr(hnsw, "BLOCK_ROWS", 8)
    monkeypatch.setattr(hnsw, "PAIRS_HELD", 500)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in hnsw.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    low = list(range(len(x)))
    for _ in range(len(x)):
        low = [min([low[i], *[low[j] for j in np.flatnonzero(near[i])]]) for i in range(len(x))]
    assert [got[i].component_id for i in range(len(x))] == low


def test_audit_sees_lost_small_groups_and_rare_links(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16))
    x[:1000] = x[0] + 0.02 * rng.standard_normal((1000, 16))  # one large group beside 300 pairs
    x[2700:] = x[2400:2700] + 0.01 * rng.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    within = hnsw.Graph.within

    def lossy(self, q, least, width, slack):
        """Finds the large group only."""
        a, v = within(self, q, least, width, slack)
        return a[part[v] < 1000], v[part[v] < 1000]

    ids = np.arange(3000)
    graph = hnsw.Graph(x)
    assert not hnsw.audit(graph, 0.95)[2]
    monkeypatch.setattr(hnsw.Graph, "within", lossy)
    for part in (ids, ids[1000:], np.concatenate([ids[1000:2401], ids[2700:2701]])):
        graph = hnsw.Graph(x[part])
        told = hnsw.audit(graph, 0.95)
        assert told[2]
        a, v = hnsw.search(graph, x[part], 0.95, *told)
        got = {(part[i], part[j]) for i, j in zip(a, v, strict=True) if i != j}
        near = x[part] @ x[part].T >= 0.95
        np.fill_diagonal(near, False)
        want = {(part[i], part[j]) for i, j in zip(*np.nonzero(near), strict=True)}
        assert want and not want - got


def test_warc_round_trip_index_and_fetch(spark, tmp_path):
    rows = [(1, "http://a.example.com/x?q=1", "<p>one</p>", 0), (2, "https://b.example.org/", "<p>one</p>", 0), (3, None, None, 0), (4, "http://a.example.com/x?q=1", "", 0), (5, "http://c.d/\n", "é\r\n\r\n" * 9000, 0), (5, "http://c.d/\n", "é\r\n\r\n" * 9000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, length int")
    warc.write_warc(df, f"{tmp_path}/a")
    captures = warc.read_warc(spark, f"{tmp_path}/a")
    warc.build_index(captures, f"{tmp_path}/i", 2)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.index_captures(spark, f"{tmp_path}/i").collect())
    assert got == [(1, "revisit", 2, 10), (2, "response", None, 10), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 54000), (5, "response", None, 54000)]
    asked = spark.createDataFrame([("http://a.example.com/x?q=1",), ("http://none/",), ("http://c.d/%0A",)], "url string")
    found = warc.lookup(spark, f"{tmp_path}/i", asked)
    assert sorted(r.page_id for r in found.collect()) == [1, 4, 5, 5]
    payloads = {r.page_id: bytes(r.payload) for r in warc.fetch(spark, f"{tmp_path}/a", found).collect()}
    assert payloads[5] == rows[4][2].encode() and payloads[4] == b"" and set(payloads) == {1, 4, 5}
    warc.write_warc(df.limit(0), f"{tmp_path}/e")
    none = warc.read_warc(spark, f"{tmp_path}/e")
    warc.build_index(none, f"{tmp_path}/ei")
    assert none.count() == 0 and warc.lookup(spark, f"{tmp_path}/ei", asked).count() == 0


def test_archives_are_read_by_others_and_by_ranges(spark, tmp_path, monkeypatch):
    import gzip
    import re
    from pathlib import Path

    html = lambda i: f"<p>{i}</p>" + "".join(random.Random(i).choices("abcdefgh", k=3000))
    df = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/{i}", html(i)) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, f"{tmp_path}/a", archive_bytes=50_000)
    files = sorted(Path(tmp_path, "a").rglob("part-*"))
    assert len(files) > 5 and all(f.stat().st_size < 55_000 for f in files)
    seen = {}
    for f in files:  # a plain reader of gzip and of WARC headers
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            seen[int(re.search(rb"Record-ID: <urn:page:(\d+)>", head)[1])] = rest[:n].partition(b"\r\n\r\n")[2].decode()
            assert rest[n : n + 4] == b"\r\n\r\n"
            data = rest[n + 4 :]
    assert seen == {i: html(i) for i in range(200)}
    warc.build_index(warc.read_warc(spark, f"{tmp_path}/a"), f"{tmp_path}/i", 10)
    own = spark.read.parquet(f"{tmp_path}/i/directory").where("first_key <= 'com,example,h3)/17' AND last_key >= 'com,example,h3)/17'").collect()
    assert len(own) == 1
    for d in Path(tmp_path, "i", "blocks").glob("shard=*"):
        if d.name != f"shard={own[0].shard}":  # a lookup doesn't open other shards
            for f in d.iterdir():
                f.write_bytes(b"none")
    asked = spark.createDataFrame([("http://h3.example.com/17",)], "url string")
    found = warc.lookup(spark, f"{tmp_path}/i", asked).collect()
    assert [r.page_id for r in found] == [17]
    for f in files:  # what lies outside the range, and other archives, may be anything
        r = found[0]
        data = f.read_bytes()
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        if r.file.endswith(str(f)):
            f.write_bytes(b"x" * r.offset + data[r.offset : r.offset + r.length] + b"x" * 100)
        else:
            f.unlink()
    one = spark.createDataFrame([(r.file, r.offset, r.length) for r in found], "file string, offset long, length long")
    assert [bytes(x.payload).decode() for x in warc.fetch(spark, f"{tmp_path}/a", one).collect()] == [html(17)]
    monkeypatch.setattr(warc, "_opener", lambda path: None)
    assert [x.page_id for x in warc.fetch(spark, f"{tmp_path}/a", one).collect()] == [17]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """All five stages against plain Python: scores, all pairs, Feistel networks, Poisson sums and the library's tokens."""
    import hashlib
    import math

    import corpus_pipeline as p
    from test_text_operators import plain_pseudonymised

    from timeweave.llm import quality

    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    good = lambda: " ".join(word() for _ in range(40)) + "."
    texts = [good() + rng.choice(["", " a.b@c.example.com", " +1 612-555-4887", " 1984-02-29"]) if i % 4 else " | ".join(word() for _ in range(50)) for i in range(160)]
    texts += [texts[1], texts[2] + " more", None, ""]
    docs = [(i, t, "en", None if i % 9 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(160)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = p.run(spark, str(tmp_path)).collect()

    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [d for d in docs if model.score(np.array([quality.statistics(d[1])]))[0] >= 0.3]
    group = {i: c for i, _, c in brute_groups([(d[0], d[1]) for d in kept], 5, 80)}
    kept = [d for d in kept if group[d[0]] == d[0]]
    kept = [(d[0], plain_pseudonymised(d[1], p.PII_KEY)[0], d[3], d[4]) for d in kept]
    size, weight = {}, {}
    for _, t, s, n in kept:
        size[s] = size.get(s, 0) + (n if t is None else len(t))
        weight[s] = p.WEIGHTS.get(s, 1.0)
    library = tokenizers.Tokenizer.from_file(p.tokenizer_file())
    want = []
    for i, t, s, _ in kept:
        rate = weight[s] * sum(size.values()) / (sum(weight.values()) * size[s])
        u, total, n = int(hashlib.md5(f"mix{p.MIX_SEED}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52), 0.0, 0
        while (total := total + math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))) <= u:
            n += 1
        ids = library.encode(t or "", add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] * n
    assert len(want) > 50 and sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
