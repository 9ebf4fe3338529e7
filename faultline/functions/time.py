"""Timestamps in log lines.  Times without a zone count as UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values -----------------------------------------------------------------
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
ISO_ZONE = r"\b(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2}))\b"
ISO_SPACE = r"\b(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\b"
CLASSIC = rf"^((?:{DAYS})\s+(?:{MONTHS})\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\d{{4}})\s*$"
DAY_MONTH = r"(?i)\b(\d{2}-[A-Z]{3}-\d{4}\s+\d{2}:\d{2}:\d{2})\b"
MONTH_SLASH = r"\b(\d{1,2}/\d{1,2}/\d{4}\s+\d{2}:\d{2}:\d{2})\b"
YEAR_SLASH = r"\b(\d{4}/\d{1,2}/\d{1,2}\s+\d{2}:\d{2}:\d{2})\b"
NO_YEAR = rf"(?i)^((?:{MONTHS})\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}})(?:\.\d+)?\b"
# -----------------------------------------------------------------------------


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def iso_time(raw: Column) -> Column:
    return F.regexp_replace(one_space(raw), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def classic_time(raw: Column) -> Column:
    """'Mon Mar  4 01:02:03 2024'; the weekday isn't looked at."""
    return F.try_to_timestamp(F.regexp_replace(one_space(raw), r"^\w+ ", ""), F.lit("MMM d HH:mm:ss yyyy"))


def short_time(raw: Column, year: Column) -> Column:
    """'Mar  4 01:02:03' of a year, null without one."""
    at = F.try_to_timestamp(F.concat_ws(" ", F.initcap(one_space(raw)), year.cast("string")), F.lit("MMM d HH:mm:ss yyyy"))
    return F.when(year.isNotNull(), at)


def line_time(line: Column, year: Column | None = None) -> Column:
    """struct(ts, raw, confidence) of the first form that parses; a form
    without year needs ``year`` and never gets the current one."""
    s = F.trim(line)
    year = F.lit(None).cast("int") if year is None else year
    forms = [
        (group(s, ISO_ZONE), iso_time),
        (group(s, ISO_SPACE), iso_time),
        (group(s, CLASSIC), classic_time),
        (group(s, DAY_MONTH), lambda r: F.try_to_timestamp(F.initcap(F.regexp_replace(one_space(r), "-", " ")), F.lit("dd MMM yyyy HH:mm:ss"))),
        (group(s, MONTH_SLASH), lambda r: F.try_to_timestamp(one_space(r), F.lit("M/d/yyyy HH:mm:ss"))),
        (group(s, YEAR_SLASH), lambda r: F.try_to_timestamp(one_space(r), F.lit("yyyy/M/d HH:mm:ss"))),
    ]
    parts = [F.when(parse(raw).isNotNull(), F.struct(parse(raw).alias("ts"), raw.alias("raw"), F.lit("HIGH").alias("confidence"))) for raw, parse in forms]
    short = group(s, NO_YEAR)
    at = short_time(short, year)
    parts.append(F.when(short.isNotNull(), F.struct(at.alias("ts"), short.alias("raw"), F.when(at.isNotNull(), "MEDIUM").otherwise("LOW").alias("confidence"))))
    none = F.struct(F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("raw"), F.lit("LOW").alias("confidence"))
    return F.coalesce(*parts, none)


def infer_years(lines: DataFrame, first_lines: int = 80) -> DataFrame:
    """(path, year) of the first line of a file that has a full time."""
    dated = lines.where(F.col("line_number") <= first_lines).withColumn("_t", line_time(F.col("line"))["ts"]).where("_t is not null")
    return dated.groupBy("path").agg(F.min_by(F.year("_t"), "line_number").alias("year"))
