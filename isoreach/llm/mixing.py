"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Aside, Stash

#: A rate above this is drawn as a sum of independent rates of at most this size, so exp(-rate) stays a normal double.
RATE_STEP = 256.0


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, total: int | None) -> DataFrame:
    """Per source: n_docs and rate, the mean number of copies that brings the source to its share.

    weights: target shares by source name, scaled to sum to 1 over the sources there are; a source not
    named gets 0. None: equal shares. total: documents wanted in all; None: as many as there are.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        share = counts.withColumn("weight", F.lit(1.0))
    else:
        if any(not w >= 0 or math.isinf(w) for w in weights.values()):
            raise ValueError("target weights must be finite and not negative")
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        share = counts.withColumn("weight", F.coalesce(F.try_element_at(named, F.coalesce("source", F.lit(""))).cast("double"), F.lit(0.0)))
    share = Stash(share, "shares").df
    all_weight, all_docs = share.agg(F.sum("weight"), F.sum("n_docs")).first()
    if not all_weight:
        return share.select("source", "n_docs", F.lit(0.0).alias("rate"))
    wanted = F.lit(int(all_docs if total is None else total))
    return share.select("source", "n_docs", (F.col("weight") / F.lit(float(all_weight)) * wanted / F.col("n_docs")).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Adds n_steps and cdf: the distribution function at 0, 1, ... of a Poisson variable of rate / n_steps."""
    step = F.col("rate") / F.col("n_steps")
    upto = (step + 12 * F.sqrt(step) + 24).cast("int")
    first = F.exp(-step)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))
    return rates.withColumn("n_steps", F.greatest(F.ceil(F.col("rate") / RATE_STEP), F.lit(1)).cast("int")).withColumn(
        "cdf",
        F.aggregate(
            F.sequence(F.lit(1), upto), start,
            lambda acc, k: F.struct(
                (acc["p"] * step / k).alias("p"), (acc["c"] + acc["p"] * step / k).alias("c"),
                F.array_append(acc["cdf"], acc["c"] + acc["p"] * step / k).alias("cdf"),
            ),
            lambda acc: acc["cdf"],
        ),
    )


def poisson_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 17, total: int | None = None, shuffle: bool = True) -> DataFrame:
    """Repeat each document as often as a Poisson variable says whose mean brings its source to its
    target weight, and shuffle all copies globally.

    docs: doc_id, source and any other columns. Returned: those columns, copy int (from 1) and
    shuffle_key long; rows stand in random partitions, by shuffle_key within each, and ordering by
    (shuffle_key, doc_id, copy) gives one fixed global order. The number of copies is the inverse of
    the Poisson distribution function at a hash of (seed, doc_id), so it does not depend on the
    partitioning and a document keeps its number of copies when others come or go and rates stay.

    A null source is a source of its own; named weights reach it under the name "". A null doc_id
    hashes as the empty string. Repeated rows are rows of their own with the same count. Columns
    called copy or shuffle_key are replaced; others may have any name. Texts are moved whole, whatever their length. An empty table gives no rows.
    """
    rates = Stash(poisson_steps(source_rates(docs, weights, total)), "rates")
    side = rates.side(F.col("source").alias("mix_source"), F.col("n_steps").alias("mix_steps"), F.col("cdf").alias("mix_cdf"))
    given = Aside(docs, ("copy", "shuffle_key"))
    key = F.coalesce(given.col("doc_id").cast("string"), F.lit(""))

    def draws(step: Column) -> Column:
        u = unit_hash(F.lit(seed), step, key)
        return F.size(F.filter("mix_cdf", lambda c: c <= u))

    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("mix_steps")), draws), F.lit(0), lambda a, x: a + x)
    counted = given.df.join(side, given.col("source").eqNullSafe(F.col("mix_source"))).withColumn("mix_n", copies).where("mix_n > 0")
    out = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_n"))))
    out = out.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("copy"), key).cast("binary")), 1, 15), 16, 10).cast("long"))
    dealt = out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", given.col("doc_id"), "copy") if shuffle else out
    return dealt.select(*given.back(), "copy", "shuffle_key")
