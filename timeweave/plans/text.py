"""Registered text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.functions import text as tx
from timeweave.operators import reports as rp
from timeweave.operators.glossary import correct_by_glossary
from timeweave.plans.base import registrar
from timeweave.sources.fixtures import fixture

QUERIES, ORACLES, query = registrar()


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _lines(spark, d):
    return fixture(spark, d, "doc_lines")


NORM = r"trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')), '\s+', ' ', 'g'))"


@query(f"SELECT video_id, line_no, {NORM} AS norm FROM doc_lines", "doc_lines")
def t1_norm_text(spark, d):
    return _lines(spark, d).select("video_id", "line_no", tx.norm_text(F.col("text")).alias("norm"))


@query("""SELECT segment_id, printf('%02d:%02d.%d', start_ms // 60000, (start_ms % 60000) // 1000, (start_ms % 1000) // 100) AS clock,
printf('%02d:%02d:%02d,%03d', start_ms // 3600000, (start_ms % 3600000) // 60000, (start_ms % 60000) // 1000, start_ms % 1000) AS srt,
segment_id AS sentence, CASE WHEN segment_id % 3 = 0 THEN segment_id % 7 END AS word FROM segments""", "segments")
def t2_clock_and_refs(spark, d):
    s = fixture(spark, d, "segments")
    ref = F.concat(F.lit("s"), F.col("segment_id").cast("string"), F.when(F.col("segment_id") % 3 == 0, F.concat(F.lit("@"), (F.col("segment_id") % 7).cast("string"))).otherwise(""))
    got = tx.sentence_ref(ref)
    return s.select("segment_id", tx.fmt_clock(F.col("start_ms")).alias("clock"), tx.fmt_srt(F.col("start_ms")).alias("srt"), got["sentence"].alias("sentence"), got["word"].cast("long").alias("word"))


@query(r"""SELECT video_id, line_no, CASE WHEN length(text) <= 40 THEN text ELSE rtrim(substr(text, 1, 39)) || '…' END AS short,
CASE WHEN length(rtrim(trim(text), '.!?,;:')) <= 40 THEN rtrim(trim(text), '.!?,;:') ELSE rtrim(regexp_replace(substr(rtrim(trim(text), '.!?,;:'), 1, 40), ' [^ ]*$', ''), ',;:') || '…' END AS title FROM doc_lines""", "doc_lines")
def t3_shorten(spark, d):
    return _lines(spark, d).select("video_id", "line_no", tx.shorten(F.col("text"), 40).alias("short"), tx.title_of(F.col("text"), 40).alias("title"))


LAST = r"regexp_extract(text, '(\S+)\s*$', 1)"
STRIPPED = rf"""regexp_replace({LAST}, '["''”’»)\]]+$', '')"""


@query(rf"""SELECT video_id, line_no, regexp_matches({STRIPPED}, '[.?!…]$') AND NOT lower({STRIPPED}) IN ({_quoted(tx.ABBREVIATIONS)}) AND NOT regexp_matches({STRIPPED}, '^.?\d\.$') AS ends,
suffix({STRIPPED}, '?') AND lower(regexp_replace({LAST}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) IN ({_quoted(tx.TAGS)}) AS tag, regexp_matches({LAST}, '[,;:]$') AS clause FROM doc_lines""", "doc_lines")
def t4_sentence_ends(spark, d):
    w = tx.last_word(F.col("text"))
    return _lines(spark, d).select("video_id", "line_no", tx.ends_sentence(w).alias("ends"), tx.ends_on_tag(F.col("text")).alias("tag"), tx.ends_clause(w).alias("clause"))


FIRST = r"lower(regexp_replace(regexp_extract(text, '^\s*(\S+)', 1), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"
SECOND = r"lower(regexp_replace(regexp_extract(text, '^\s*\S+\s+(\S+)', 1), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"


@query(f"""SELECT video_id, line_no, CASE WHEN {FIRST} IN ({_quoted(tx.REPLIES)}) THEN 'reply' WHEN {FIRST} IN ({_quoted(tx.CONNECTIVES)}) THEN 'connective'
WHEN CASE WHEN {FIRST} = 'lo' THEN {SECOND} = 'cual' ELSE {FIRST} IN ({_quoted(tx.CONTINUATIONS)}) END THEN 'continuation' WHEN {FIRST} IN ({_quoted(tx.FILLERS)}) THEN 'filler' END AS opener FROM doc_lines""", "doc_lines")
def t5_opener_class(spark, d):
    return _lines(spark, d).select("video_id", "line_no", tx.opener_class(F.col("text")).alias("opener"))


@query(r"""WITH t AS (SELECT conv_id, turn, text || CASE conv_id % 3 WHEN 0 THEN ' my name is Ana María' WHEN 1 THEN ' Me llamo Luis, gracias' ELSE '' END AS s FROM conversations)
SELECT conv_id, turn, nullif(regexp_extract(s, '^(?s:.)*?(?i:my name is|mi nombre es|me llamo|my name''s) +([\p{Lu}][\p{L}\p{N}''-]*(?: +[\p{Lu}][\p{L}\p{N}''-]*){0,2})', 1), '') AS name FROM t""")
def t6_introduced_name(spark, d):
    extra = F.when(F.col("conv_id") % 3 == 0, " my name is Ana María").when(F.col("conv_id") % 3 == 1, " Me llamo Luis, gracias").otherwise("")
    c = fixture(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.introduced_name(F.regexp_replace(F.concat("text", extra), "\n", " ")).alias("name"))


@query(r"""SELECT page_id, regexp_replace(html, 'x^', '') AS html, 'a [data image/png ' || CAST((length(repeat('QUJD', CAST(page_id % 5 + 1 AS BIGINT))) * 3) // 4 AS VARCHAR) || ' bytes] b' AS redacted FROM pages""")
def t8_redact_data_urls(spark, d):
    p = fixture(spark, d, "pages")
    made = F.concat(F.lit("a data:image/png;base64,"), F.expr("repeat('QUJD', CAST(page_id % 5 + 1 AS INT))"), F.lit(" b"))
    return p.select("page_id", tx.redact_data_urls(F.col("html")).alias("html"), tx.redact_data_urls(made).alias("redacted"))


@query("""SELECT event_id, CASE WHEN value <= 0 THEN -1e2 ELSE greatest(-1e2, round(10e0 * log10(value), 6)) END AS db FROM events""")
def t11_dbfs(spark, d):
    return fixture(spark, d, "events").select("event_id", F.round(tx.dbfs(F.col("value")), 6).alias("db"))


@query("""WITH b AS (SELECT a.vec_id AS a, b.vec_id AS b, (a.vec_id%7)/1e1 AS ax, (b.vec_id%5)/1e1 AS bx FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
i AS (SELECT *, greatest(0e0, least(ax + 3e-1, bx + 3e-1) - greatest(ax, bx)) * 2e-1 AS inter FROM b) SELECT a, b, round(inter / (6e-2 + 6e-2 - inter), 9) AS iou FROM i""")
def t10_iou(spark, d):
    e = fixture(spark, d, "embeddings").select("vec_id")
    p = e.select(F.col("vec_id").alias("a")).join(e.select(F.col("vec_id").alias("b")), F.col("b") == F.col("a") + 1)
    box = lambda c, m: F.struct(((F.col(c) % m) / 10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.3).alias("w"), F.lit(0.2).alias("h"))
    return p.select("a", "b", F.round(tx.iou(box("a", 7), box("b", 5)), 9).alias("iou"))


@query(rf"""WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM benchmark),
e AS (SELECT item_id, unnest(range(1, len(words) + 1)) AS i, words FROM w), t AS (SELECT item_id, i, words[i] AS term, words[i] IN ({_quoted(tx.STOPWORDS)}) AS stop FROM e),
k AS (SELECT item_id, i, term FROM t WHERE NOT stop OR item_id NOT IN (SELECT item_id FROM t WHERE NOT stop)), f AS (SELECT item_id, term, min(i) AS i FROM k GROUP BY 1, 2)
SELECT item_id, term, length(term) >= 4 AS prefix, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS BIGINT) AS pos FROM f""")
def b2_query_terms(spark, d):
    b = fixture(spark, d, "benchmark")
    return b.select("item_id", F.posexplode(tx.query_terms(F.col("text"))).alias("pos", "term")).select("item_id", "term", (F.length("term") >= 4).alias("prefix"), F.col("pos").cast("long").alias("pos"))


@query(r"""SELECT segment_id FROM segments WHERE NOT coalesce(off_mic, FALSE) AND trim(text) <> '' AND NOT (regexp_matches(trim(text), '(?s)^(\[.*\]|\(.*\))$') OR NOT regexp_matches(text, '[\p{L}\p{N}]'))""", "segments")
def b5_b6_spoken(spark, d):
    s = fixture(spark, d, "segments")
    return rp.spoken(s).select("segment_id")


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'broll' WHEN 'view' THEN 'drone' WHEN 'purchase' THEN 'interview' ELSE event_type END AS category, value FROM events)
SELECT event_id, CASE category WHEN 'interview' THEN 'Interviews' WHEN 'broll' THEN 'B-Roll' WHEN 'drone' THEN 'Drones & Aerials' ELSE upper(substr(category, 1, 1)) || substr(lower(category), 2) END AS folder,
category IN ('broll', 'drone') AND (value > 10 OR event_id % 2 = 0) AS ambience FROM c""")
def b7_categories(spark, d):
    e = fixture(spark, d, "events")
    cat = F.when(F.col("event_type") == "click", "broll").when(F.col("event_type") == "view", "drone").when(F.col("event_type") == "purchase", "interview").otherwise(F.col("event_type"))
    return e.withColumn("category", cat).select("event_id", tx.folder_of(F.col("category")).alias("folder"), tx.plays_ambience(F.col("category"), F.greatest(F.col("value") - 10, F.lit(0.0)), F.when(F.col("event_id") % 2 == 0, "manual").otherwise("auto")).alias("ambience"))


@query(r"""WITH g AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS heard FROM benchmark), m AS (SELECT map(list(heard), list(upper(heard))) AS m FROM g),
p AS (SELECT doc_id, source, m, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS parts FROM documents, m)
SELECT doc_id, coalesce(array_to_string(CASE WHEN source IN ('src0', 'src1') THEN list_transform(parts, lambda x: coalesce(m[lower(x)], x)) ELSE parts END, ''), '') AS text FROM p""")
def t7_glossary(spark, d):
    """Whole documents of two sources by a glossary of all longer words of the benchmark, which it writes in capitals."""
    docs = fixture(spark, d, "documents").select("doc_id", "source", "text")
    heard = fixture(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("heard")).distinct()
    words = heard.select(F.explode(F.array(F.lit("src0"), F.lit("src1"))).alias("source"), F.upper("heard").alias("term"), "heard")
    return correct_by_glossary(docs, "text", words, "source").select("doc_id", "text")
