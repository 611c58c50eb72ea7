"""Mixing sources to target weights by Poisson replication (operator 1).

A source's target share and its size give a mean repetition rate. Each document draws a Poisson
count of that mean by inverting the distribution at a hash-seeded uniform number, is exploded by its
count, and all copies are shuffled into a random order. Everything is a Spark expression, and each
draw depends on the seed and the document's id only, so a lost task draws the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import written

#: A larger mean is drawn as a sum of independent Poisson numbers of this mean at most (which is exact).
PART_MEAN = 16.0
#: Terms of the distribution that are summed; beyond 96 a mean of 16 leaves less than 1e-40.
TERMS = 96


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and the columns: 52 bits, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in columns))), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def thresholds(mean: Column) -> Column:
    """P(X <= k), k = 0, 1, ..., of a Poisson number; u draws the number of thresholds that are u or less."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("made"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["total"] + p).alias("total"), F.concat(acc["made"], F.array(acc["total"] + p)).alias("made"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["made"])


def source_rates(df: DataFrame, weights: dict[str, float] | None, total: float | None, temperature: float, source: str, text: str) -> DataFrame:
    """(source, size, share, rate): rate is what one document of the source is repeated on average.

    Sizes are characters. ``weights`` are target shares, scaled to 1 over the sources there are; a source that
    it does not name gets none. Without ``weights``, shares are sizes to the power of ``temperature``.
    ``total`` is the number of characters wanted, as many as there are by default. A source of no characters keeps rate 0.
    """
    sizes = df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("size"))
    if weights is None:
        raw = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(float(temperature)))).otherwise(F.lit(0.0))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = F.when(F.col("size") > 0, F.coalesce(F.create_map(*pairs)[F.col("source")] if pairs else F.lit(0.0), F.lit(0.0))).otherwise(F.lit(0.0))
    sizes = sizes.withColumn("raw", raw)
    wholes = sizes.agg(F.sum("raw").alias("all_raw"), F.sum("size").alias("all_size"))
    all_raw = wholes.select("all_raw").scalar()
    wanted = F.lit(float(total)) if total is not None else wholes.select(F.col("all_size").cast("double")).scalar()
    share = F.when(all_raw > 0, F.col("raw") / all_raw).otherwise(F.lit(0.0))
    rate = F.when(F.col("size") > 0, share * wanted / F.col("size")).otherwise(F.lit(0.0))
    return sizes.select("source", "size", share.alias("share"), rate.alias("rate"))


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, temperature: float = 0.5,
                seed: int = 42, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Copies of the rows of ``df`` so that sources have their target weights on average, in a random order.

    Adds ``copy`` (from 0) and ``position`` (a hash; rows come in its order within and over
    partitions of it). Columns of ``df`` with these names are replaced. A null source is the source
    ''; a null id is drawn as the id ''; rows of one id, source and text draw alike. A source without
    characters or target weight is left out.
    """
    spark = df.sparkSession
    df = df.drop(*(c for c in ("copy", "position") if c not in (source, text, key)))
    names = df.columns
    rates = source_rates(df, weights, total, temperature, source, text)
    # stored, so that Spark knows its size and broadcasts it only if it is small
    rates = written(spark, rates.withColumn("__mix_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)))
                    .select(F.col("source").alias("__mix_source"), "rate", "__mix_parts", thresholds(F.col("rate") / F.col("__mix_parts")).alias("__mix_steps")).withColumnRenamed("rate", "__mix_rate").filter("__mix_rate > 0"), "rates")
    id_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    def one(part):
        """The Poisson number of one part; transform() binds the uniform number, so that it is hashed once and not for each threshold."""
        return F.get(F.transform(F.array(uniform(seed, id_text, part)), lambda u: F.size(F.filter(F.col("__mix_steps"), lambda step: step <= u))), F.lit(0))

    draw = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("__mix_parts")), F.lit(0), lambda acc, part: acc + one(part))
    copies = (df.withColumn("__mix_source", F.coalesce(F.col(source).cast("string"), F.lit(""))).join(rates, "__mix_source").withColumn("__mix_n", draw).filter("__mix_n > 0")
              .select(*names, F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1)).alias("copy"))
              .withColumn("position", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), id_text, F.col("copy").cast("string")))))
    return copies.repartition("position").sortWithinPartitions("position")
