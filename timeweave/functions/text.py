"""Text expressions: normalising, references and clocks, sentence ends, openings, introductions, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists.
STOPWORDS = ("a an and are as at be by for from has have how i in is it its of on or that the this to was we what when where which who with you "
             "de del el en es la las lo los un una y o que con por para se al como").split()
REPLIES = "exacto exactamente claro sí totalmente correcto efectivamente obvio obviamente exactly right yeah yes sure absolutely totally true".split()
CONNECTIVES = "pero entonces porque además también aunque sino pues and but so because also which although".split()
FILLERS = "yeah yes yep right exactly sure absolutely totally okay ok so well um uh oh and but like exacto exactamente claro sí si bueno pues entonces vale y".split()
CONTINUATIONS = "en de del con para al a que cual cuales donde cuyo cuya lo of in with for to than which whose whom".split()
ABBREVIATIONS = "sr. sra. dr. dra. vs. etc. ej. p.ej. ud. uds. mr. mrs. e.g. i.e.".split()
TAGS = "ok okay no vale verdad sí si eh ves sabes cierto right yeah see".split()
FOLDERS = {"interview": "Interviews", "broll": "B-Roll", "screencast": "Screen Recordings", "drone": "Drones & Aerials", "audio": "Music & Audio", "other": "Other"}

CLOSERS = "[\"'”’»)\\]]+$"


def norm_text(c: Column) -> Column:
    """Letters, digits and single spaces, lower-cased."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", "")), r"\s+", " "))


def search_words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def content_words(c: Column) -> Column:
    """Words of four bytes or more that mean something, each once."""
    words = F.transform(F.split(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}']+"), lambda w: F.lower(F.regexp_replace(w, "^'+|'+$", "")))
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~w.isin(STOPWORDS)))


def query_terms(c: Column) -> Column:
    """Words worth searching, each once in order; all of them if none is."""
    words = search_words(c)
    chosen = F.array_except(words, F.array(*map(F.lit, STOPWORDS)))
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.array_distinct(words))


def fmt_clock(ms: Column) -> Column:
    """mm:ss.t, tenths cut off."""
    return F.format_string("%02d:%02d.%d", F.floor(ms / 60000), F.floor(F.pmod(ms, F.lit(60000)) / 1000), F.floor(F.pmod(ms, F.lit(1000)) / 100))


def fmt_srt(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(F.pmod(ms, F.lit(3600000)) / 60000), F.floor(F.pmod(ms, F.lit(60000)) / 1000), F.pmod(ms, F.lit(1000)))


def sentence_ref(c: Column) -> Column:
    """struct(sentence, word) of ``s412`` or ``s412@3``; null of anything else."""
    ok = c.rlike(r"^s\d{1,18}(@\d{1,9})?$")
    word = F.regexp_extract(c, r"@(\d+)$", 1)
    return F.when(ok, F.struct(F.regexp_extract(c, r"^s(\d+)", 1).cast("long").alias("sentence"), F.when(word != "", word.cast("int")).alias("word")))


def shorten(c: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis where something was cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…")))


def title_of(c: Column, n: int) -> Column:
    """The text without stops at its end, or its first n characters up to a word's end and an ellipsis."""
    t = F.regexp_replace(F.trim(c), "[.!?,;:]+$", "")
    head = F.substring(t, 1, n)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.regexp_replace(head, " [^ ]*$", ""), "[,;:]+$", ""), F.lit("…")))


def ends_sentence(word: Column) -> Column:
    """Whether a word ends a sentence: a stop, closing quotes allowed, but no abbreviation or list number."""
    w = F.regexp_replace(word, CLOSERS, "")
    listed = w.rlike(r"^.?\d\.$")
    return w.rlike("[.?!…]$") & ~F.lower(w).isin(ABBREVIATIONS) & ~listed


def last_word(c: Column) -> Column:
    return F.regexp_extract(c, r"(\S+)\s*$", 1)


def bare(word: Column) -> Column:
    """A word without punctuation at its ends, lower-cased."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def ends_on_tag(c: Column) -> Column:
    """Whether a text ends on a tag question."""
    w = last_word(c)
    return F.regexp_replace(w, CLOSERS, "").endswith("?") & bare(w).isin(TAGS)


def ends_clause(word: Column) -> Column:
    return word.rlike("[,;:]$")


def opener_class(c: Column) -> Column:
    """reply, connective, continuation, filler or null, by a text's first word; ``lo`` continues only before ``cual``."""
    first = bare(F.regexp_extract(c, r"^\s*(\S+)", 1))
    second = bare(F.regexp_extract(c, r"^\s*\S+\s+(\S+)", 1))
    continues = F.when(first == "lo", second == "cual").otherwise(first.isin(CONTINUATIONS))
    return F.when(first.isin(REPLIES), "reply").when(first.isin(CONNECTIVES), "connective").when(continues, "continuation").when(first.isin(FILLERS), "filler")


def introduced_name(c: Column) -> Column:
    """One to three capitalised words after the first self-introduction, up to punctuation."""
    word = r"[\p{Lu}][\p{L}\p{N}'-]*"
    got = F.regexp_extract(c, rf"^.*?(?i:my name is|mi nombre es|me llamo|my name's) +({word}(?: +{word}){{0,2}})", 1)
    return F.when(got != "", got)


def non_speech(c: Column) -> Column:
    """Bracketed annotations and texts without a letter or digit."""
    t = F.trim(c)
    return t.rlike(r"(?s)^(\[.*\]|\(.*\))$") | ~t.rlike(r"[\p{L}\p{N}]")


def redact_data_urls(c: Column) -> Column:
    """Base64 data URLs replaced by their kind and byte count."""
    pattern = r"data:[a-zA-Z0-9.+/-]+;base64,[A-Za-z0-9+/]*={0,2}"
    urls, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)

    def told(u: Column, i: Column) -> Column:
        body = F.regexp_replace(u, "^[^,]*,|=", "")
        kind = F.regexp_extract(u, "^data:([^;]*)", 1)
        return F.concat(F.lit("[data "), kind, F.lit(" "), F.floor(F.length(body) * 3 / 4).cast("string"), F.lit(" bytes]"), F.element_at(gaps, i + 2))

    return F.array_join(F.concat(F.slice(gaps, 1, 1), F.transform(urls, told)), "")


def folder_of(category: Column) -> Column:
    """Folder of a category; own categories capitalised, none ``Other``."""
    known = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    return F.when(F.coalesce(category, F.lit("")) == "", "Other").otherwise(F.coalesce(known[F.lower(category)], F.concat(F.upper(F.substring(category, 1, 1)), F.substring(F.lower(category), 2, 1 << 30))))


def plays_ambience(category: Column, confidence: Column, source: Column) -> Column:
    return F.lower(category).isin("broll", "drone") & ((confidence > 0) | (source == "manual"))


def dbfs(mean_square: Column) -> Column:
    """Decibels of a mean square, -100 at least; null, not-a-number and infinite are silence."""
    odd = mean_square.isNull() | F.isnan(mean_square) | (mean_square <= 0) | (mean_square == float("inf"))
    return F.when(odd, -100.0).otherwise(F.greatest(F.lit(-100.0), 10 * F.log10(mean_square)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes struct(x, y, w, h)."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def correct_terms(c: Column, terms: Column) -> Column:
    """A text with each variant that was heard replaced by its term, whole words in any case, longest variants first.

    ``terms``: array<struct<term, variants array<string>>>, or null for none. What one variant has claimed no other one
    touches: it is marked first, and terms are put in at the end.
    """
    heard = F.flatten(F.transform(terms, lambda t: F.transform(t["variants"], lambda v: F.struct(-F.length(F.trim(v)), -F.octet_length(F.trim(v)), F.trim(v).alias("heard"), F.trim(t["term"]).alias("term")))))
    pairs = F.transform(F.array_sort(F.filter(heard, lambda p: (p["heard"] != "") & (p["term"] != ""))), lambda p, i: F.struct(p["heard"].alias("heard"), p["term"].alias("term"), i.alias("i")))
    edge = "\\p{L}\\p{N}\ue000\ue001"
    mark = lambda p: F.concat(F.lit("\ue000"), p["i"].cast("string"), F.lit("\ue001"))
    # an escaped variant: \\Q...\\E, a \\E inside it ended and begun again
    quoted = lambda p: F.concat(F.lit(f"(?iu)(?<![{edge}])\\Q"), F.replace(p["heard"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?![{edge}])"))
    claimed = F.aggregate(pairs, c, lambda text, p: F.regexp_replace(text, quoted(p), mark(p)))
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, claimed, lambda text, p: F.replace(text, mark(p), p["term"]))).otherwise(c)


def register(spark) -> None:
    """The scalar functions for use from SQL."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION norm_text(s STRING) RETURNS STRING RETURN trim(regexp_replace(lower(regexp_replace(s, '[^\\p{L}\\p{N}\\s]', '')), '\\s+', ' '))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"
              " / sqrt(aggregate(a, 0D, (s, v) -> s + v * v) * aggregate(b, 0D, (s, v) -> s + v * v))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))")
