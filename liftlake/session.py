"""Session settings the plans rely on.

Only runtime-settable SQL options are touched, and only where the caller left
the default, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# AQE sizes joins at run time: it turns a shuffled join into a broadcast only
# after the small side's real size is known, and splits skewed join partitions.
_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Rows go to Python workers in batches; a batch counted by rows alone may hold any amount of text, in the executor's
# direct memory and again in the worker.
_BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def build_session(app_name: str = "liftlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local work; on a cluster the submitter's settings apply."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # call-site capture for every Column costs several driver round trips each
    quiet = {"spark.python.sql.dataFrameDebugging.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    for key, value in {**_ADAPTIVE, **quiet, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that its Python functions run from any folder."""
    name = f"liftlake-{spark.sparkContext.applicationId}.zip"
    if not any(path.endswith(name) for path in spark.sparkContext.listFiles):
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="liftlake-"), name)
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, files in os.walk(root):
                for file in files:
                    if file.endswith(".py"):
                        full = os.path.join(folder, file)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Adaptive execution and the package's code for a session somebody else built."""
    _defaults(spark, _ADAPTIVE)
    return ship(spark)


def _defaults(spark: SparkSession, values: dict[str, str]) -> None:
    for key, value in values.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def batch_by_bytes(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of a few MB, for jobs that hand long texts from stage to stage."""
    _defaults(spark, _BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    The cluster's ``spark.checkpoint.dir`` (storage every executor sees). Where it
    is unset, a folder of this machine serves a local master, whose tasks run in
    this process; any other master raises, since its executors would not see it.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "liftlake-checkpoints")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate once and read it back.

    A Parquet table in the shared folder cuts the lineage, survives lost
    executors, is read column-wise, and tells the optimizer its size, so small
    facts are broadcast by measured size rather than by guess.
    """
    spark = df.sparkSession
    path = new_table_path(spark, "facts")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """As ``materialize``, in buckets of a key: what joins or adds up its rows by that key leaves them in place."""
    spark = df.sparkSession
    path = new_table_path(spark, "facts")
    name = "facts_" + path.rpartition("-")[2]
    df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(name)
    return spark.table(name)


#: Rows of a written table beyond which its size on disk says too little about its size in memory.
FEW_ROWS = 500_000


def hinted(written: DataFrame, *sides: DataFrame) -> tuple[DataFrame, ...]:
    """``sides``, derived from a written table, for a join: never gathered by the driver where that table has many rows.

    Keys that repeat take a few bytes a row in a file and some hundred in memory, so a table of a few MB may be gigabytes as a broadcast.
    """
    if written.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return sides
    return tuple(side.hint("shuffle_merge") for side in sides)
