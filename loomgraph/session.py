"""The session, the folder that all executors share, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_shipped: set[str] = set()
_scratch: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def session(name: str = "loomgraph", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary
    folder; on a cluster that raises, as no folder is known that all its machines share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local.setdefault("dir", tempfile.mkdtemp(prefix="loomgraph-"))
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; :func:`release` removes it, at the latest
    when this process ends."""
    app = spark.sparkContext.applicationId
    at = f"{shared_dir(spark)}/loomgraph/{app}"
    if app not in _scratch:
        _scratch[app] = at
        atexit.register(_end, spark, app)
    return at


def release(spark: SparkSession) -> None:
    """Remove all that :func:`saved` and :func:`bucketed` wrote in this application, and the
    latter's catalog entries. Results that still read it are lost."""
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if at := _scratch.pop(spark.sparkContext.applicationId, None):
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _end(spark: SparkSession, app: str) -> None:
    # The session may have ended, or been stopped, before the process.
    with contextlib.suppress(Exception):
        if spark.sparkContext.applicationId == app:
            release(spark)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts the lineage, and
    the loss of an executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, tag: str, key: str, deal: bool = False) -> DataFrame:
    """As :func:`saved`, in as many buckets of ``key`` as a shuffle has partitions: joins and sums
    by that key then need no exchange on this side. Each task writes a file for each bucket that
    it has rows of, so ``deal`` shuffles rows that don't lie by ``key`` yet."""
    spark = df.sparkSession
    buckets = bucket_count(spark)
    name = f"loomgraph_{tag}_{uuid.uuid4().hex}"
    if deal:
        df = df.repartition(buckets, key)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    df.write.bucketBy(buckets, key).option("path", f"{scratch_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)
