"""Session helpers shared by tests, the benchmark and the driver entry."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidewright", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings every job here assumes (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that its Python functions run wherever the driver
    was started from."""
    sent = getattr(spark.sparkContext, "_tidewright_sent", False)
    if sent:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidewright-code-"), "tidewright.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._tidewright_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`. Only a local-mode
    session that names none (tests) gets a scratch folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[str] = []


METHOD_BYTES = 8000  # the JVM interprets larger methods, it does not compile them
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def reliable(df: DataFrame, compiled: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage with a table that outlives executors, is read by column,
    and tells the planner its size. `release` removes such tables. `compiled` is
    for long chains of projections: where one generated method would be too large
    for the JVM to compile, Spark runs them operator by operator.
    """
    if compiled:
        before = df.sparkSession.conf.get(METHOD_LIMIT)
        df.sparkSession.conf.set(METHOD_LIMIT, str(METHOD_BYTES))
        try:
            return reliable(df)
        finally:
            df.sparkSession.conf.set(METHOD_LIMIT, before)
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tidewright-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def in_small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator whose Python functions read whole texts: what it runs or stores meets them in Arrow batches of
    `BATCH_BYTES`. Of Spark's 64 MB, the JVM and the Python worker of every running task would each hold one, and the JVM
    another while its buffers grow. What the operator returns unstored runs under the session's own limit."""
    @functools.wraps(operator)
    def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
        conf = rows.sparkSession.conf
        before = conf.get(BATCH_LIMIT)
        conf.set(BATCH_LIMIT, BATCH_BYTES)
        try:
            return operator(rows, *args, **kwargs)
        finally:
            conf.set(BATCH_LIMIT, before)

    return run


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system Spark finds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Remove a table of `reliable` that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove all that `reliable` has written in this process. Call it when the
    results that were built on it have been written or collected."""
    while _written:
        remove(spark, _written.pop())
