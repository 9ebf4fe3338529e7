"""One-call diagnosis of a text, a file or a folder of archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import evidence, translator
from faultline.plans.diagnose import diagnose
from faultline.sources.archives import read_bundles
from faultline.sources.files import Limits, archive_kind, read_texts


def diagnose_text(spark: SparkSession, text: str, incident: str = "input", rules: dict | None = None, benign: list[str] = ()) -> dict[str, DataFrame]:
    """K8: events, analysis and report of a pasted text."""
    files = spark.createDataFrame([(incident, incident, text)], "incident string, path string, text string")
    return with_evidence(files, diagnose(files, rules, benign))


def is_folder(spark: SparkSession, path: str) -> bool:
    """What the file system says of a path, whatever its name looks like."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(context._jsc.hadoopConfiguration())
    return store.exists(where) and store.getFileStatus(where).isDirectory()


def diagnose_path(spark: SparkSession, path: str, rules: dict | None = None, benign: list[str] = (), limits: Limits = Limits()) -> dict[str, DataFrame]:
    """K8: the same of a file, an archive or a folder of either; every
    top-level file is an incident, and what wasn't read is in ``skipped``."""
    found = read_bundles(spark, path, limits) if archive_kind(path) or is_folder(spark, path) else read_texts(spark, path).select(
        F.col("path").alias("bundle"), "path", "text", F.lit(None).cast("string").alias("skip_reason")
    )
    files = found.where("text is not null").select(F.col("bundle").alias("incident"), "path", "text")
    out = with_evidence(files, diagnose(files, rules, benign))
    out["skipped"] = found.where("skip_reason is not null").select(F.col("bundle").alias("incident"), "path", "skip_reason")
    return out


def with_evidence(files: DataFrame, out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds the tables of a root-cause report: codes, other rows, timeline and
    the signals that texts show."""
    own = files.select("incident", "path").dropDuplicates(["path"])
    events = evidence.project_events(out["events"]).join(own, "path", "left")
    out["codes"], out["timeline"] = evidence.ora_rows(events), evidence.timeline(events)
    out["others"] = evidence.non_ora_rows(events, out["report"].select("incident", F.explode("matched").alias("pattern_id")))
    out["signals"] = translator.signals(files, "path")
    return out
