"""Session helpers shared by the queries."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test layout: one Parquet file or folder per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores. A table of a few files that cannot be split would keep most cores idle
    while Python or long expressions work on it; a larger one has enough partitions already and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is missing in a local run (tests) a temporary one is made and set; on a cluster, where executors would
    write what nobody else can read, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_written: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    A lost executor costs no recomputation of what came before, and later plans carry neither the lineage
    nor the constraints of it. Tables are removed by ``drop`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``cut`` that nothing will read any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            remove(file.rsplit("/", 1)[0])


def remove(path: str) -> None:
    for known in [p for p in _written if path.endswith(p.split(":", 1)[-1])]:
        spark = _written.pop(known)
        where = spark._jvm.org.apache.hadoop.fs.Path(known)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def remove_all() -> None:
    for path in list(_written):
        try:
            remove(path)
        except Exception:  # the session has ended: its folder is its cluster's to clean
            return


#: Most rows of a table that may be broadcast; the reference lists hold a few hundred, fixed.
BROADCAST_ROWS = 20_000


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if a count shows at most ``rows`` rows; else leave the join to shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
