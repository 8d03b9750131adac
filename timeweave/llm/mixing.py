"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.sources.scratch import materialize

#: Rate tables up to this many bytes are broadcast; larger ones are joined on salted keys.
BROADCAST_BYTES = 4 << 20
SALTS = 64
#: Up to this rate a source's cumulative probabilities are a table; beyond it each of its documents sums them itself.
TABLE_RATE = 5000.0
#: A document of more copies is dealt out in blocks of this many.
BLOCK_COPIES = 100_000
ADDED = ("mix_copies", "mix_copy", "mix_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over ``parts`` joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of the counts 0, 1, ... until the rest is below double precision."""
    last = F.ceil(rate + F.sqrt(rate) * 12.0 + 20.0).cast("int")

    def step(acc: Column, k: Column) -> Column:
        lp = F.when(k == 0, -rate).otherwise(acc["lp"] + F.log(rate) - F.log(k.cast("double")))
        total = acc["total"] + F.exp(lp)
        return F.struct(lp.alias("lp"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    zero = F.struct(F.lit(0.0).alias("lp"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf"))
    made = F.aggregate(F.sequence(F.lit(0), last), zero, step, lambda a: a["cdf"])
    return F.when(rate > 0, made).otherwise(F.array(F.lit(1.0)))


def poisson_count(rate: Column, u: Column) -> Column:
    """How many cumulative probabilities of a large ``rate`` are at most ``u``, by Stirling's series.

    Counts over 12 standard deviations from the rate have no weight in double precision and are not summed. This takes
    some 24 roots of the rate in steps, fewer than the copies that follow from it.
    """
    reach = F.sqrt(rate) * 12.0 + 20.0
    low, last = F.floor(F.greatest(rate - reach, F.lit(1.0))), F.ceil(rate + reach)

    def step(acc: Column, n: Column) -> Column:
        k = n.cast("double")
        off = k - acc["rate"]
        lp = off - k * F.log1p(off / acc["rate"]) - F.log(k * (2 * math.pi)) / 2 - F.lit(1.0) / (k * 12) + F.lit(1.0) / (k * k * k * 360)
        total = acc["total"] + F.exp(lp)
        return F.struct(acc["rate"].alias("rate"), acc["u"].alias("u"), total.alias("total"), (acc["count"] + (total <= acc["u"]).cast("long")).alias("count"))

    zero = F.struct(rate.alias("rate"), u.alias("u"), F.lit(0.0).alias("total"), low.cast("long").alias("count"))
    return F.aggregate(F.sequence(low.cast("long"), last.cast("long")), zero, step, lambda a: a["count"])


def source_rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0,
                 source: str = "source", size: str = "n_chars") -> DataFrame:
    """(source key, rate): the mean repetitions that give every source its share of ``epochs`` times the input.

    rate = weight * epochs * total size / (sum of the weights of the sources present * size of the source). Sources
    missing from ``weights`` have ``default_weight``; null is a source of its own; a source of size 0 has rate 0.
    Only two totals reach the driver.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    per = docs.groupBy(key.alias("_key")).agg(F.sum(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))).cast("double").alias("_size"))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("_key") == "s" + name, F.lit(float(w))).otherwise(weight)
    per = materialize(per.withColumn("_weight", weight), "sizes")
    total = per.agg(F.sum("_size"), F.sum("_weight")).first()
    size_sum, weight_sum = float(total[0] or 0.0), float(total[1] or 0.0)
    rate = F.when((F.col("_size") > 0) & F.lit(weight_sum > 0), F.col("_weight") * F.lit(epochs * size_sum) / (F.lit(weight_sum or 1.0) * F.col("_size"))).otherwise(0.0)
    return per.select("_key", rate.alias("_rate"))


def mix(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 17,
        source: str = "source", size: str = "n_chars", doc_id: str = "doc_id") -> DataFrame:
    """Every document repeated by its own Poisson count, in a global random order.

    Adds ``mix_copies`` (the document's count), ``mix_copy`` (1 to that count) and ``mix_key``, the hash by which
    rows are dealt to partitions and ordered within them. The count inverts the Poisson distribution of the source's
    rate at a number hashed from the seed and the id alone: a rerun, or any partitioning, gives the same copies.
    Repeated rows (and rows of null id) share the count of their id. Documents of count 0 leave the mixture, as
    the method says. No text is looked at. An empty table gives an empty result. Columns named as those added are
    replaced; others are kept, whatever their names.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rates = materialize(source_rates(docs, weights, default_weight, epochs, source, size).select("_key", "_rate", F.when(F.col("_rate") <= TABLE_RATE, poisson_cdf(F.col("_rate"))).alias("_cdf")), "rates")
    told = rates.agg(F.sum(F.octet_length("_key") + F.greatest(F.size("_cdf"), F.lit(0)) * 8 + 72), F.max("_rate")).first()
    need, most = told[0] or 0, told[1] or 0.0
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    whole = F.struct(*[F.col(c) for c in docs.columns if c not in ADDED]).alias("_row")
    keyed = docs.select(whole, key.alias("_key"), ident.alias("_ident"))
    if need <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(rates), "_key")
    else:
        salt = F.pmod(F.xxhash64("_ident"), F.lit(SALTS)).cast("int")
        spread = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", salt).join(spread, ["_key", "_salt"])
    u = uniform(F.lit(f"mix{seed}"), F.col("_ident"))
    count = F.size(F.filter("_cdf", lambda c: c <= u)).cast("long")
    if most > TABLE_RATE:
        count = F.when(F.col("_cdf").isNotNull(), count).otherwise(poisson_count(F.col("_rate"), u))
    counted = joined.select("_row", "_ident", count.alias("mix_copies"))
    few = F.lit(BLOCK_COPIES).cast("long")
    copies = counted.where(F.col("mix_copies").between(1, few)).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    if most + math.sqrt(most) * 12 + 20 > BLOCK_COPIES:
        first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"), few))
        blocks = counted.where(F.col("mix_copies") > few).withColumn("_first", first).repartition("_ident", "_first")
        each = F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + few - 1, F.col("mix_copies"))))
        copies = copies.unionByName(blocks.withColumn("mix_copy", each).drop("_first"))
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "_ident", F.col("mix_copy").cast("string")))
    return copies.select("_row.*", "mix_copies", "mix_copy", order.alias("mix_key")).repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
