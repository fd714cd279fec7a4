"""Session settings, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read table ``name`` of a data folder; timestamps without zone stay as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    ``spark.checkpoint.dir`` of the session holds. Only where it is unset (tests on one machine) a
    temporary folder is made, because a machine-local folder is of no use to a cluster.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"siftlode-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return own


def own_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it is deleted when the application ends."""
    sc = spark.sparkContext._jsc.sc()
    if sc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    own = sc.getCheckpointDir().get()
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The files survive the loss of any executor, unlike a local checkpoint or a cache. They go when the frame
    is no longer used (``spark.cleaner.referenceTracking.cleanCheckpoints``, set by :func:`session`) and, at
    the latest, when the application ends.
    """
    own_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a Parquet table in the same folder: small on disk, and each reader takes only the columns it needs.

    For wide rows that are read more than once. The table goes with :func:`release` or when the application ends.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the one table of :func:`stored` that ``df`` reads, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Delete the tables of :func:`stored`, once the results that read them are written; returns their number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("table-")] if fs.exists(path) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, as the width for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def widen(df: DataFrame) -> DataFrame:
    """The frame in at least half as many partitions as there are cores: for costly work on a file with few splits.

    Inputs of any size have more splits than that and pass unchanged, without a shuffle. Only for scans with
    filters and projections: counting the partitions of a plan with exchanges would run them.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() >= want else df.repartition(want)


def session(app: str = "siftlode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides (dots as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
