"""Session helpers: a local session for tests and benches, and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and bench.py use."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("palimpsest")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset and the master is local, a temporary one for this process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{made}")
        found = f"file://{made}"
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read back, so later readers prune columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the folder of a table that written() made; nothing may read it afterwards."""
    jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within, Arrow batches have at most rows rows (the session's bound if it is lower) and about 16 MB.

    For actions that run inside; the settings come back after.
    """
    most, size = (f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    before = {k: spark.conf.get(k) for k in (most, size)}
    own = int(before[most])
    for k, v in {most: str(min(own, rows) if own > 0 else rows), size: "16m"}.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Rows of a wide step that one task takes, about 100 MB in a hash table.
ROWS_A_TASK = 1 << 19


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of a shuffle of so many rows: the session's number, and more where a task would get over ROWS_A_TASK."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


@contextlib.contextmanager
def shuffle_tasks(spark: SparkSession, tasks: int | None) -> Iterator[None]:
    """Within, shuffles have so many tasks, if that is more than the session's number, and small ones are merged up to 8 MB only.

    For actions that run inside; the settings come back after.
    """
    own = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    if tasks and tasks > int(own["spark.sql.shuffle.partitions"]):
        for k, v in zip(own, (str(tasks), "8m"), strict=True):
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application, in case that they do not find it by themselves."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    made = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(f"{made}/palimpsest.zip", "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(f"{made}/palimpsest.zip")
    _shipped.add(context.applicationId)
