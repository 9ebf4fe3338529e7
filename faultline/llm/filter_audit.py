"""How text filters interact, for every order of application, from one pass.

A document's failures are a mask of one bit a filter.  For every part and label
2^k signed parity sums are added up (each document adds +1 or -1 to the sum of
w, by the parity of the failures it has in w): a Walsh-Hadamard transform of
the table of masks, whose size doesn't depend on the data.  The transform is
its own inverse but for the factor 2^k, so exact integers give back how many
documents have exactly which failures, and from these cells every order of the
filters is evaluated without another look at the documents.  A document with f
failures is removed by each of its filters in k!/f of all k! orders, which
gives the Shapley value in closed form.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import table

#: the filters of documents; the last one compares documents
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"
#: more filters would have more orders than a driver can list
MOST_FILTERS = 7


def _odd(mask: str | Column, w: int | Column) -> Column:
    """Whether an odd number of the failures in ``w`` is in the mask."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return F.bit_count(mask.bitwiseAND(F.lit(w) if isinstance(w, int) else w)) % 2 == 1


def parity_sums(rows: DataFrame, filters: int, by: list[str], mask: str = "mask", n: str = "n") -> DataFrame:
    """``by`` and ``sums``: for every w the sum of n, negative where the mask
    has an odd number of the filters of w."""
    sums = [F.sum(F.when(_odd(mask, w), -F.col(n)).otherwise(F.col(n))) for w in range(1 << filters)]
    return rows.groupBy(*by).agg(F.array(*sums).alias("sums"))


def mask_cells(sums: DataFrame, filters: int) -> DataFrame:
    """The inverse: a row for each mask with the number ``n`` of documents
    that fail exactly its filters, 0 included."""
    size = 1 << filters
    cells = sums.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    inverse = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda total, w: total + F.when(_odd("mask", w), -F.get("sums", w)).otherwise(F.get("sums", w)))
    return cells.withColumn("n", F.shiftright(inverse, filters)).drop("sums")


def evaluate_orders(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every step of every order of the filters in every part.

    ``cells`` has part, good and toxic (booleans), mask and n.  ``names`` has a
    letter for each bit of a mask, lowest first.  The result is described in
    ``op12_filter_audit``; a part's rows come from its 2^k cells alone.
    """
    k = len(names)
    if k > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    cell = F.struct("mask", "n", "good_n", "toxic_n")
    sums = (F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good_n"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic_n"))
    parts = cells.groupBy("part", "mask").agg(*sums).groupBy("part").agg(F.collect_list(cell).alias("cells"))
    orders = F.array(*[F.lit("".join(order)) for order in itertools.permutations(names)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def bits(where) -> Column:
        return sum((F.when(where(F.instr("filter_order", letter)), 1 << at).otherwise(0) for at, letter in enumerate(names)), F.lit(0))

    steps = steps.withColumn("own", bits(lambda place: place == F.col("step"))).withColumn("before", bits(lambda place: place < F.col("step")))

    def total(where, value=lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(where(c["mask"]), value(c)).otherwise(F.lit(0).cast("long")))

    def has(mask: Column, bits: str) -> Column:
        return mask.bitwiseAND(F.col(bits)) != 0

    def here(mask: Column) -> Column:
        return has(mask, "own") & ~has(mask, "before")

    share = F.lit(math.factorial(k))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda m: ~has(m, "own") & ~has(m, "before")).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: has(m, "own") & has(m, "before")).alias("redundant"),
        total(lambda m: m == F.col("own")).alias("unique_fails"),
        total(here, lambda c: c["good_n"]).alias("good_lost"),
        total(here, lambda c: c["toxic_n"]).alias("toxic_lost"),
        total(lambda m: has(m, "own"), lambda c: c["n"] * (share / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def text_failures(text: str = "text") -> Column:
    """Mask of the filters A to D that a whole text fails; null is empty."""
    text = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    chars = F.length(text)
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failures = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * chars,
        text.rlike(SYMBOLS),
    )
    return sum((F.when(fails, 1 << at).otherwise(0) for at, fails in enumerate(failures)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: documents with these failures of A to E.

    Texts are compared by their SHA-256.  Rows are counted by text, part and
    label before texts meet, so a text that a third of all rows has comes as
    one row a task; what meets is a row for each part and label.  Rows without
    doc_id have no label, no smaller id and are smaller than none.
    """
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_failures().alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"),
    ).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").select(*rows.columns, "good", "toxic")
    rows = known.unionByName(rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    by = ["part", "good", "toxic", "mask"]
    # smallest id of a text in its part and label, and the rows that have it
    texts = rows.groupBy("digest", *by).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    alone = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    outcomes = F.array(F.struct(F.col("mask").alias("mask"), alone.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - alone).alias("n")))
    return texts.select("part", "good", "toxic", F.inline(outcomes))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """See ``op12_filter_audit``."""
    sums = parity_sums(failure_counts(docs, labels), len(FILTERS), ["part", "good", "toxic"])
    return evaluate_orders(mask_cells(sums, len(FILTERS)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each part (lang; null and empty are one part), order of the
    five filters and step: documents kept after it, removed by it, failing it
    but removed before (redundant), failing it alone, lost though of quality 1,
    lost and toxic, and removed by its filter over all 120 orders.

    Null texts are empty texts; equal texts are told by content, so null and
    empty ones are copies; rows that repeat a doc_id and its text are copies of
    a smaller id's text only.  A document counts as good or toxic if any of its
    labels says so.  Whole texts are read however long; other columns, whatever
    their names, are ignored; without documents there is no part and no row.
    """
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# orders are tried one by one on the counts of failures
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text), 'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(d.doc_id > least, false)} AS fails
  FROM d JOIN least ON d.text = least.text LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
failing AS (
  SELECT part, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS own
  FROM g),
tried AS (
  SELECT part, n, good, toxic, own, filter_order, step, substr(filter_order, step, 1) AS letter,
    coalesce(list_min(list_transform(own, lambda x: instr(filter_order, x))), 6) AS gone
  FROM failing, orders, (SELECT unnest(range(1, 6))::INT AS step)),
s AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
    sum(n) FILTER (list_contains(own, letter) AND gone < step) AS redundant, sum(n) FILTER (own = [letter]) AS unique_fails,
    sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
  FROM tried GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM s
"""
