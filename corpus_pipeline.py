"""The corpus pipeline: documents from the raw table to balanced shards.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

In every stage a row is judged by its whole text. Null and empty texts are clean: they are no copies
of each other, hold no benchmark passage and are kept or thinned by their features alone. Rows that
repeat an id are rows of their own; null ids are kept like others. Columns beside doc_id and text are
carried along whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm import decontaminate, minhash_dedup, mixing, sharding, toxicity
from tidepanel.session import materialize, ship_package, shared_path

#: SQL can express neither the classifiers nor the iterations
ORACLE_SQL = None

#: the share of expected tokens of each value of labels.quality after mixing
MIXTURE = {"1": 0.95, "0": 0.05}
SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold.

    Labels of unknown ids, null labels and ids with labels that differ teach nothing; rows of equal text
    score alike, so that all of them go or stay.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id (a null one last), of each near-duplicate group (similarity 0.8).

    Rows are told apart by a written number, so that repeated and null ids hide no copy. Ties of the
    smallest id go to the row that was written first; texts without words are in no group and stay.
    """
    numbered = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("node")), "near-rows")
    groups = minhash_dedup.near_duplicate_groups(numbered.select("node", "row.text"), id_col="node").join(numbered.select("node", "row.doc_id"), "node")
    groups = materialize(groups.select("node", "component_id", "doc_id"), "near-groups")
    first = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"))
    first = materialize(first.where("rows > 1"), "near-first")  # both sides of the join as they lie, so that a large group can be split
    copies = groups.join(first, "component_id").where(F.col("node") != F.col("first.node")).select("node")
    return numbered.join(copies, "node", "left_anti").select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that copies a benchmark item.

    Each row is judged by its own text: of rows that share an id only those that leak go, with or without an id.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to MIXTURE; those of the scarcest domain stay whole.

    Rows of equal id and text draw alike. Without labels there is one domain, and all rows stay.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIXTURE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for each document left: doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each row of docs.

    No copies are left by now, so that documents are linked by the lines that they share.
    """
    return sharding.shard_documents(docs, SHARDS, lines=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
