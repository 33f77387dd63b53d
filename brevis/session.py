"""Session helpers: scratch tables in shared storage and package shipping."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of a row group of a staged table, which its writer holds in memory.
ROW_GROUP = 32 << 20


def build_session(app: str = "brevis", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors that holds intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local master gets
    a temporary folder (driver and executors are one process there) and any other master a
    folder below the warehouse, which is shared as well.
    """
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None) or getattr(sc, "_brevis_scratch", None)
    if not root:
        if sc.master.startswith("local") and "cluster" not in sc.master:
            root = Path(tempfile.mkdtemp(prefix="brevis-scratch-")).as_uri()
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_brevis_scratch"
        sc._brevis_scratch = root  # noqa: SLF001
    return root.rstrip("/")


def trim(spark: SparkSession) -> None:
    """Give back the memory that finished work has left on the driver: Arrow's and the C library's
    free blocks, and the JVM's garbage of plans, which would only be collected once its heap is full."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    spark._jvm.System.gc()  # noqa: SLF001


class scratch:  # noqa: N801
    """A block of work whose staged tables are deleted at its end, but for those it keeps."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> None:
        self.tables = [t for t in self.tables if t is not df]

    def __enter__(self) -> scratch:
        _SCOPES.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _SCOPES.remove(self)
        for df in self.tables:
            drop_staged(df)


_SCOPES: list[scratch] = []


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is read straight from files, row by row: a task that runs again then meets
    the same rows in the same order."""
    plan = df._jdf.queryExecution().optimizedPlan()  # noqa: SLF001
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's bytes: of its files, where it is read from some."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it is read from fewer file splits than there are cores. Only tables
    too small for that are dealt anew; a large one is read as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()  # noqa: SLF001
    if not is_scan(df) or plan_bytes(df) >= cores * split or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def staged(df: DataFrame, name: str, folders: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back. Rows are
    parted into folders by the column ``folders``, so that a filter on it reads its own alone.

    This cuts the lineage: a lost executor re-reads the table instead of recomputing the plan
    above it. Unlike ``checkpoint`` the plan runs once and the rows are stored compressed.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path, partitionBy=folders)
    out = spark.read.schema(df.schema).parquet(path)
    out._brevis_path = path  # noqa: SLF001
    if _SCOPES:
        _SCOPES[-1].tables.append(out)
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table made by :func:`staged` that nothing reads any more."""
    path = getattr(df, "_brevis_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm  # noqa: SLF001
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


#: Rows of an Arrow batch where the session has Spark's own default of 10,000: texts are long, and
#: a batch is held by the JVM and by a Python worker at once.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Prepare a session for operators that run Python: batches of bounded size, and, once per
    Spark context, this package importable in Python workers."""
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_brevis_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="brevis-ship-")) / "brevis_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"brevis/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._brevis_shipped = True  # noqa: SLF001
