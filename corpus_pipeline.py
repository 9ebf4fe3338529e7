"""The training-data pipeline: four stages, each one an operator of the llm
subpackage.  Every stage gets what its predecessor kept, written as Parquet
and read again, and returns the columns of documents; the last returns the
packed pieces.

Extra columns of documents stay, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.jaccard import near_duplicate_rows, with_keys
from faultline.llm.language import label_documents, learn
from faultline.llm.mixing import mix_sources
from faultline.llm.packing import pack_documents
from faultline.llm.shared import release_plans, table, written

#: a document goes if less than this share of its words is of one language
LEAST_SCORE = 0.4
#: near copies share this percentage of their runs of so many words
NEAR_PERCENT, NEAR_WORDS = 80, 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known with enough certainty: of
    their words at least LEAST_SCORE.  Null and letterless texts go.  Equal
    rows share their fate; whole texts are read however long; a table without
    rows or without any lang keeps none."""
    return label_documents(docs, learn(docs), least_score=LEAST_SCORE)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the smallest doc_id, and
    of rows that repeat a doc_id one of each group they are in.

    Null and wordless texts are in no group and stay; so do rows without
    doc_id.  Equal rows are one group; whole texts are compared however long;
    an empty table stays empty.
    """
    release_plans(spark)  # those of the stage before
    groups = written(near_duplicate_rows(docs, NEAR_PERCENT, NEAR_WORDS), "groups")
    release_plans(spark)
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    dropped = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    if not repeated.take(1):
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(dropped.unionByName(repeated).distinct(), "doc_id", "left_anti").select(*docs.columns)
    # an id's rows may have different texts: each counts with its own set
    kept = groups.where(F.col("doc_id") == F.col("component_id")).join(repeated, "doc_id", "left_semi").select("doc_id", "key", "component").distinct()
    rows = with_keys(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns), NEAR_WORDS)
    rows = rows.alias("r").join(kept.alias("k"), (F.col("r.doc_id") == F.col("k.doc_id")) & F.col("r.key").eqNullSafe(F.col("k.key")))
    # wordless texts are in no group
    rows = rows.withColumn("alone", F.when(F.col("r.key").isNull(), F.col("r.text"))).withColumn("of", F.col("r.doc_id")).dropDuplicates(["of", "component", "alone"])
    return once.unionByName(rows.select(*[F.col(f"r.{c}") for c in docs.columns]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources.  A null source
    is a source of its own, null texts count as empty ones, equal rows are
    repeated alike, an empty table stays empty."""
    release_plans(spark)
    return mix_sources(docs, columns=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences.  Null texts are one end
    id, repeated rows are packed each, an empty table gives no piece."""
    release_plans(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_groups),
    ("mixing", mixed),
    ("packing", packed),
]

#: a trained field and a tokenizer can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
