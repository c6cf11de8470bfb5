"""Session settings and the folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent

#: What results depend on, and how many rows a Python worker is sent at a time (texts are long); other sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
}

_shipped: set[str] = set()
_folders: dict[int, str] = {}


def build(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS and what `more` adds, its keys' dots as double underscores."""
    b = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (b.master(master) if master else b).getOrCreate()


def settle(spark: SparkSession) -> SparkSession:
    """Put SETTINGS into a session that someone else made, and this package where its workers find it."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    ship(spark)
    return spark


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and workers are one process's threads and children, as with master local or local[8]."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, but for a local master's workers that have it on their path or as their working folder."""
    app = spark.sparkContext.applicationId
    here = str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == str(ROOT)
    if app in _shipped or one_machine(spark) and here:
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp()) / "tracemill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "tracemill").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and the master is local, as in tests, a new local one."""
    sc = spark.sparkContext
    if not (found := sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tracemill_dir", None)):
        if not one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = sc._tracemill_dir = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        sc.setCheckpointDir(found)
    return found if ":" in found.split("/")[0] else f"file://{os.path.abspath(found)}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in shared_dir that nobody uses; what is in it goes when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tracemill/{name}-{uuid.uuid4().hex[:12]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: later jobs start from its files, not from its lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[id(found)] = path
    weakref.finalize(found, _folders.pop, id(found), None)
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written() tables that nothing will read again: all that was made of them is written itself."""
    for t in tables:
        where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders.pop(id(t)))
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as read, its rows dealt out evenly if it gives fewer partitions than there are cores: for work on rows that costs far more than to move them.

    A small file of one row group is read by one task however many cores there are. Tables of more bytes give a partition a core at least and are
    left as they are, so no large table is moved. For tables as read only: counting the partitions of what comes after an exchange would run that.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
