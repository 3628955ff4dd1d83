"""Mixing sources to target weights by Poisson replication.

A source's target weight over its share of the corpus is the mean number of
times each of its documents should appear.  Every document draws its own count
from a Poisson distribution with that mean, by inverting it at a uniform number
hashed from seed and document (a high mean is the sum of several draws): the draw needs no neighbour, gives the same
result wherever and however often a task runs, and holds for any input size.
Copies are exploded and dealt over the cluster by the hash of (seed, document,
copy), so the output files are a global shuffle.

Counting sources is a partial aggregate.  The rates (a row per source) are
broadcast only when there are at most `broadcast_sources` of them; else they
are joined with a salt, which splits a hot source.

Defined results: a null source is a source of its own; null or empty texts
weigh nothing but are drawn like others of their source; an empty table gives
none; repeated rows draw alike; texts of any length count whole; other columns
pass through whatever their names, but those named like the added ones (copy,
mix_key) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import fresh

#: Bits of the hash that make the uniform number.
BITS = 48
SALTS = 64
#: Up to this rate a Poisson count is one draw: exp(-rate) is 0 in doubles from about 745 on.
MOST_RATE = 500


def uniform(*parts) -> Column:
    """A number in (0, 1) hashed from the parts; md5, as every SQL engine has it."""
    text = F.concat_ws("|", *[F.coalesce(F.lit(p).cast("string") if isinstance(p, (str, int)) else p.cast("string"), F.lit("~")) for p in parts])
    whole = F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(1 << BITS))


def poisson(rate: str, u: str) -> str:
    """SQL: the smallest n whose cumulated Poisson probability reaches u.

    The terms run to a bound at which the rest of the mass is under the
    resolution of u, so nothing is cut off.
    """
    top = f"cast(ceil({rate} + 12 * sqrt({rate}) + 24) as int)"
    return (
        f"aggregate(sequence(1, {top}), named_struct('n', 0, 'p', exp(-{rate}), 'c', exp(-{rate})), "
        f"(s, k) -> if({u} <= s.c, s, named_struct('n', k, 'p', s.p * {rate} / k, 'c', s.c + s.p * {rate} / k)), s -> s.n)"
    )


def drawn_count(rate: str, u: str, seed: int, id_col: str) -> str:
    """SQL: a Poisson count at any rate: over MOST_RATE, the sum of independent draws that share the rate, each with a uniform number of its own."""
    parts = f"cast(ceil({rate} / {MOST_RATE}) as int)"
    digest = f"md5(concat_ws('|', '{seed}', 'part', coalesce(cast(`{id_col}` as string), '~'), cast(j as string)))"
    numbers = f"transform(sequence(1, {parts}), j -> (cast(conv(substring({digest}, 1, {BITS // 4}), 16, 10) as double) + 0.5D) / {float(1 << BITS)!r}D)"
    summed = f"aggregate({numbers}, 0, (total, v) -> total + {poisson(f'({rate} / {parts})', 'v')})"
    return f"if({rate} > {MOST_RATE}, {summed}, {poisson(rate, u)})"


def rates(docs: DataFrame, weights: DataFrame | None, power: float, epochs: float, source_col: str, text_col: str) -> DataFrame:
    """Mean repetitions by source: target share * epochs * corpus size / source size.

    Without weights, the target share goes with the size to the given power.
    """
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(
        F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("double").alias("_size")
    )
    if weights is None:
        sized = sizes.withColumn("_weight", F.pow("_size", F.lit(power)))
    else:
        named = weights.select(F.col("source").alias("_name"), F.col("weight").cast("double").alias("_weight"))
        sized = sizes.join(named, F.col("_source").eqNullSafe(F.col("_name")), "left").fillna(0.0, ["_weight"]).drop("_name")
    total = sized.agg(F.sum("_size").alias("_all"), F.sum("_weight").alias("_weights"))
    rate = F.col("_weight") / F.col("_weights") * F.col("_all") / F.col("_size") * F.lit(float(epochs))
    # one row of totals, so this join makes no more rows than there are sources
    return sized.join(F.broadcast(total)).select(
        "_source", F.when((F.col("_size") > 0) & (F.col("_weights") > 0), rate).otherwise(F.lit(0.0)).alias("_rate")
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    power: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    broadcast_sources: int = 10_000,
) -> DataFrame:
    """Each document as often as drawn, with `copy` from 0 and `mix_key`, in shuffled order."""
    docs = docs.drop("copy", "mix_key")
    rate = rates(docs, weights, power, epochs, source_col, text_col).persist()
    named, mean, u, n = (fresh(x, docs.columns) for x in ("mix_source", "mix_rate", "mix_u", "mix_n"))
    salt, part = fresh("mix_salt", docs.columns), fresh("mix_part", docs.columns)
    rate = rate.withColumnsRenamed({"_source": named, "_rate": mean})
    on = F.col(source_col).eqNullSafe(F.col(named))
    try:
        few = rate.limit(broadcast_sources + 1).count() <= broadcast_sources
        if few:
            rate_rows = docs.sparkSession.createDataFrame(rate.collect(), rate.schema)
            drawn = docs.join(F.broadcast(rate_rows), on, "left")
    finally:
        rate.unpersist()
    if not few:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)))
        spread = rate.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        drawn = salted.join(spread, on & (F.col(salt) == F.col(part)), "left").drop(salt, part)
    drawn = drawn.withColumn(u, uniform(seed, F.col(id_col))).withColumn(n, F.expr(drawn_count(mean, u, seed, id_col))).where(F.col(n) > 0)
    copies = drawn.withColumn("copy", F.explode(F.expr(f"sequence(0, {n} - 1)")))
    keyed = copies.withColumn("mix_key", uniform(seed, F.lit("order"), F.col(id_col), F.col("copy")))
    return keyed.drop(named, mean, u, n).repartition("mix_key").sortWithinPartitions("mix_key")
