"""Prefix scans of long files and busy keys, cut into slices.

A window from the first row to the current one puts a whole file into one
task.  Here a key's rows are cut into slices that follow each other: each slice
is scanned for itself, of each slice one row goes to a scan over the slices of
the key, and what has been carried up to a slice's border is joined to its
rows.  The largest group is a slice, or the list of a key's slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: lines of a slice of a file
SLICE = 65_536


def line_slice(line_number: str = "line_number") -> Column:
    return F.floor(F.col(line_number) / SLICE)


def scan(rows: DataFrame, keys: list[str], order: list[str], piece: Column, last: dict[str, Column] | None = None, counts: dict[str, Column] | None = None, earlier: dict[str, Column] | None = None) -> DataFrame:
    """Adds for each name in ``last`` the last value up to and including the
    row that isn't null, for each in ``earlier`` that before the row, and for
    each in ``counts`` the running sum.

    ``piece`` numbers the slices of a key: of two rows of different slices that
    in the smaller one comes first.  Rows are looked at twice, once for the
    borders of slices.
    """
    inclusive, counts, earlier = last or {}, counts or {}, earlier or {}
    last = inclusive | earlier
    cut = rows.withColumn("_slice", piece).withColumns({f"_of_{n}": c for n, c in (last | counts).items()})
    place = F.struct(*order)
    ends = [F.max_by(f"_of_{n}", F.when(F.col(f"_of_{n}").isNotNull(), place)).alias(f"_end_{n}") for n in last]
    ends += [F.sum(f"_of_{n}").alias(f"_end_{n}") for n in counts]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    borders = cut.groupBy(*keys, "_slice").agg(*ends).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_slice").alias("_border"),
        *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in last], *[F.sum(f"_end_{n}").over(before).alias(f"_before_{n}") for n in counts],
    )
    so_far = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumns({f"_own_{n}": F.last(f"_of_{n}", ignorenulls=True).over(above if n in earlier else so_far) for n in last} | {f"_own_{n}": F.sum(f"_of_{n}").over(so_far) for n in counts})
    same = F.col("_slice").eqNullSafe(F.col("_border"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = own.join(borders, same, "left")
    out = {n: F.coalesce(f"_own_{n}", f"_before_{n}") for n in last}
    # a count that is null so far has nothing to add
    out |= {n: F.when(F.col(f"_own_{n}").isNull() & F.col(f"_before_{n}").isNull(), None).otherwise(F.coalesce(f"_own_{n}", F.lit(0)) + F.coalesce(f"_before_{n}", F.lit(0))) for n in counts}
    return joined.select(*[c for c in rows.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def in_one_row(lines: DataFrame) -> bool:
    """Lines of texts that were one row each: such a file has been in one task
    already, so a window over it needs no slices."""
    return "n_lines" in lines.columns


def scan_lines(lines: DataFrame, last: dict[str, Column] | None = None, counts: dict[str, Column] | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``scan`` over the lines (path, line_number) of files: in slices where
    files were read in splits (``numbered_lines``)."""
    if not in_one_row(lines):
        return scan(lines, list(keys), ["line_number"], line_slice(), last, counts)
    so_far = Window.partitionBy(*keys).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({n: F.last(c, ignorenulls=True).over(so_far) for n, c in (last or {}).items()} | {n: F.sum(c).over(so_far) for n, c in (counts or {}).items()})


def nearby(lines: DataFrame, before: int, after: int, columns: dict[str, Column]) -> DataFrame:
    """Adds for each name the first value that isn't null from ``before`` lines
    above to ``after`` below.  The lines of a file are numbered without gaps;
    the few next to a border are copied to the neighbouring slice."""
    if in_one_row(lines):
        w = Window.partitionBy("path").orderBy("line_number").rowsBetween(-before, after)
        return lines.withColumns({n: F.first(c, ignorenulls=True).over(w) for n, c in columns.items()})
    at = F.pmod(F.col("line_number"), F.lit(SLICE))
    home = line_slice()
    slices = F.array_compact(F.array(home, F.when(at >= SLICE - before, home + 1), F.when(at < after, home - 1)))
    copied = lines.withColumn("_slice", F.explode(slices))
    w = Window.partitionBy("path", "_slice").orderBy("line_number").rowsBetween(-before, after)
    seen = copied.withColumns({n: F.first(c, ignorenulls=True).over(w) for n, c in columns.items()})
    return seen.where(F.col("_slice") == home).drop("_slice")
