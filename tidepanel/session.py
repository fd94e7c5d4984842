"""Session-level helpers shared by the panel operators and the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(cores: str = "8", app: str = "tidepanel") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent (tests on one machine) a temporary folder
    takes its place, and the context is told so that checkpoint() uses it too.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = "file://" + tempfile.mkdtemp(prefix="tidepanel-")
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and branches over the result share one computation.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tidepanel_path = path
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads, as all that came of them is written."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(table._tidepanel_path)
        target.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not on their path already, and keep Arrow batches small."""
    if spark.conf.get(ARROW_ROWS) == "10000":  # the default: a batch of long texts would fill a worker
        spark.conf.set(ARROW_ROWS, "1000")
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in paths or os.path.realpath(os.getcwd()) == str(ROOT) or getattr(spark, "_tidepanel_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tidepanel-ship-")) / "tidepanel_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((ROOT / "tidepanel").rglob("*.py")):
            z.write(source, str(source.relative_to(ROOT)))
    spark.sparkContext.addPyFile(str(archive))
    spark._tidepanel_shipped = True
