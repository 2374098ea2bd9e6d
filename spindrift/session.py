"""Session helpers: configuration defaults, table access and shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

_TEST_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SCRATCH: dict[str, list[str]] = {}


def build_session(app: str = "spindrift", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster sizing is left to the caller's ``conf``."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of rows that go to a Python worker at a time, unless the session says otherwise. Spark's own
#: value is four times that, in the executor's memory outside of its heap and in the worker's, twice.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def tune(spark: SparkSession) -> None:
    """Set what this package's operators need, where the session leaves it open."""
    key, value = BATCH_BYTES
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, value)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it where the driver does."""
    tune(spark)
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or "site-packages" in root.parts or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(app)
    # the driver serves the archive for as long as it runs
    folder = tempfile.mkdtemp(prefix="spindrift-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/spindrift-{app}", "zip", root, "spindrift"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder; read by Spark alone, so any file system will do."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is so small that a scan would keep few of them busy. Tables
    of over a scan partition for each core, by the optimizer's estimate, stay where they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df if df.isStreaming or int(str(size)) > cores * most else df.repartition(cores)


def bound(df: DataFrame) -> DataFrame:
    """``df`` with its columns as they are: what reads them doesn't evaluate their expressions again. The
    optimizer moves neither projections nor filters below an observed count."""
    return df if df.isStreaming else df.observe(f"rows-{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))


_KEPT: dict[tuple, object] = {}


def remembered(spark: SparkSession, key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gave for the key in this application, until scratch space is released."""
    key = spark.sparkContext.applicationId, *key
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local master (tests)
    gets a temporary folder and a cluster gets a folder in the warehouse, which is shared too.
    """
    ship_package(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext.applicationId
    if app not in _TEST_FOLDERS:
        if spark.sparkContext.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="spindrift-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = f"file://{folder}"
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(root)
        _TEST_FOLDERS[app] = root
    return _TEST_FOLDERS[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under :func:`shared_root`; nothing is created."""
    path = f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write ``df`` to shared Parquet and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.options(**options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``df``; nothing may read it any more."""
    if path := getattr(df, "_scratch", None):
        remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all scratch folders of this application, once its results have been written."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
