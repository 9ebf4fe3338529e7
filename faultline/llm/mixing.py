"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated Poisson(rate_s) times, where rate_s is the
target share of s times the corpus over the size of s.  The draw inverts the
Poisson distribution at a uniform number that a hash of seed and document
gives, so it needs no state, no order and no second pass, and a document's
count doesn't depend on other documents but through the rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import table, written

SEED = 17
TEMPERATURE = 0.5
#: up to so many sources with so many steps in all the table of rates is
#: broadcast (8 MB); beyond, it is joined with each source dealt over SALTS parts
BROADCAST_SOURCES, BROADCAST_STEPS, SALTS = 10_000, 1_000_000, 64
#: copies that a row is exploded into at once
MOST_COPIES = 1_000


def _text(column: str) -> Column:
    """Distinguishes null from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits of md5."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Adds to rows (source_key, rate) ``first``, a count, and ``steps``: the
    distribution function there and at the counts after it, until it is 1 to
    rounding.

    It covers ten deviations around the mode, so its length grows with the
    root of the rate.  Probabilities go out from the mode as sums of the
    logarithms of ratios, so that no rate underflows; the sum over all of them
    normalises.
    """
    spread = 10.0 * F.sqrt("rate") + 25.0
    first = F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("long")
    rows = rates.withColumn("first", first).withColumn("k", F.explode(F.sequence("first", F.ceil(F.col("rate") + spread).cast("long"))))
    up = Window.partitionBy("source_key").orderBy("k")
    ratio = F.when(F.col("k") == F.col("first"), 0.0).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))
    # log p(k) but for a constant; its maximum is the mode's
    rows = rows.withColumn("log", F.sum(ratio).over(up))
    rows = rows.withColumn("p", F.exp(F.col("log") - F.max("log").over(Window.partitionBy("source_key"))))
    rows = rows.withColumn("step", F.sum("p").over(up) / F.sum("p").over(Window.partitionBy("source_key")))
    # one row a source, of as many steps as its rate asks
    steps = rows.groupBy("source_key").agg(F.first("rate").alias("rate"), F.first("first").alias("first"), F.sort_array(F.collect_list("step")).alias("steps"))
    return steps.select("source_key", "rate", "first", "steps")


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source_key, size, rate): the mean repetitions that turn the sources'
    sizes into the target weights at the same total size.

    ``weights`` gives target weights by source; without it a source's weight
    is its size to the power ``temperature``.  Size is characters plus one a
    document.  Sources with weight 0 go; unknown sources have weight 0.
    """
    sizes = docs.groupBy(_text("source").alias("source_key")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).cast("double").alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        rows = [("-" if k is None else f"={k}", float(w)) for k, w in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "source_key string, weight double")
        weighted = sizes.join(given, "source_key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = weighted.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return weighted.crossJoin(F.broadcast(totals)).select(  # one row
        "source_key", "size", F.try_divide(F.col("weight") * F.col("all_size"), F.col("all_weight") * F.col("size")).alias("rate")
    )


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED, shuffle: bool = True, columns: bool = True
) -> DataFrame:
    """The documents, each repeated by its Poisson count, in a random order.

    Adds ``copy`` (from 0) and ``rate``, which replace input columns of these
    names; with ``columns=False`` nothing is added or replaced.  Nulls: a null
    source is a source of its own, a null text has size 1, a null doc_id is
    hashed as such.  Rows equal in doc_id and text get the same count, ties in
    the order are equal rows.  Very long texts are hashed whole.  An empty
    table gives no rows.  The sum of repeated sizes meets the input's in
    expectation.
    """
    own = "_mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    key, u, first, steps, copies, copy, rate, part, salt, place = (f"{own}_{c}" for c in ("key", "u", "first", "steps", "copies", "copy", "rate", "part", "salt", "place"))
    rates = poisson_steps(source_rates(docs, weights, temperature).where("rate > 0").select("source_key", "rate"))
    rates = written(rates.select(F.col("source_key").alias(key), F.col("rate").alias(rate), F.col("first").alias(first), F.col("steps").alias(steps)), "rates")
    keyed = docs.withColumn(key, _text("source")).withColumn(u, uniform(seed, _text("doc_id"), F.md5(F.coalesce("text", F.lit("")))))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES and (rates.agg(F.sum(F.size(steps))).first()[0] or 0) <= BROADCAST_STEPS:
        joined = keyed.join(F.broadcast(rates), key)
    else:  # every source is spread over so many parts, whatever its size
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64("doc_id", u), F.lit(SALTS)).cast("int")).join(salted, [key, salt]).drop(salt)
    drawn = joined.withColumn(copies, F.col(first) + F.size(F.filter(steps, lambda c: c <= F.col(u)))).where(F.col(copies) > 0).drop(key, u, first, steps)
    if (rates.agg(F.max(rate)).first()[0] or 0) > MOST_COPIES:
        # many copies of a row are made in parts, by more than one task
        parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / MOST_COPIES))
        drawn = drawn.withColumn(part, F.explode(parts)).repartition(*([c for c in ("doc_id",) if c in docs.columns]), part)
        begin = F.col(part) * MOST_COPIES
        drawn = drawn.withColumn(copy, F.explode(F.sequence(begin, F.least(F.col(copies), begin + MOST_COPIES) - 1))).drop(part)
    else:
        drawn = drawn.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    drawn = drawn.withColumn(copy, F.col(copy).cast("int")).drop(copies)
    if shuffle:
        tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        # a random place for each row: a hashed partition, then hashed order
        drawn = drawn.withColumn(place, F.xxhash64(F.lit(seed), "doc_id", copy, F.length("text"))).repartition(tasks, place).sortWithinPartitions(place).drop(place)
    if not columns:
        return drawn.select(*docs.columns)
    return drawn.select(*[c for c in docs.columns if c.lower() not in ("copy", "rate")], F.col(copy).alias("copy"), F.col(rate).alias("rate"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to square-root source weights: doc_id, source,
    lang, copy, rate and text of each copy.  Nulls, ties, repeated rows, long
    texts, empty tables and other columns are as ``mix_sources`` says."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "text", "copy", F.round("rate", 9).alias("rate"))


OP2_SQL = f"""
WITH sizes AS (
  SELECT coalesce('=' || source, '-') AS source_key, CAST(sum(coalesce(length(text), 0) + 1) AS DOUBLE) AS size
  FROM documents GROUP BY 1),
rates AS (
  SELECT source_key, (pow(size, {TEMPERATURE}) * sum(size) OVER ()) / (sum(pow(size, {TEMPERATURE})) OVER () * size) AS rate
  FROM sizes),
logs AS (
  SELECT source_key, rate, k, -rate + sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source_key ORDER BY k) AS log_p
  FROM (SELECT source_key, rate, unnest(range(0, CAST(ceil(rate + 10.0 * sqrt(rate) + 25.0) AS BIGINT) + 1)) AS k FROM rates)),
steps AS (
  SELECT source_key, rate, k, sum(exp(log_p)) OVER (PARTITION BY source_key ORDER BY k) AS step FROM logs),
drawn AS (
  SELECT d.*, coalesce('=' || source, '-') AS source_key,
    CAST(('0x' || substr(md5('{SEED}|' || coalesce('=' || doc_id, '-') || '|' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d),
counted AS (
  SELECT w.doc_id, w.source, w.lang, w.text, r.rate, (SELECT count(*) FROM steps s WHERE s.source_key = w.source_key AND s.step <= w.u) AS copies
  FROM drawn w JOIN rates r USING (source_key))
SELECT doc_id, source, lang, text, CAST(unnest(range(0, copies)) AS INTEGER) AS copy, round(rate, 9) AS rate FROM counted
"""
