"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

# Runtime SQL settings: text timestamps are UTC, and of two equal keys in one
# JSON object the last one counts.  The JVM only interprets a method of over 8,000 bytes of bytecode, so
# stages whose whole code is larger run operator by operator, in methods that are cut up.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: some operators run Python there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="run-"), f"{package.name}.zip")  # the driver serves it from here
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session somebody else built, and send it this package."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    ship_code(spark)
    return spark


def local_session(cores: int | str = 8, app: str = "archivemill", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # Expressions are many and small: recording a call site for each is slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


#: Rows of a narrow table that one task makes lines of; a line is about a hundred times the row's bytes.
TASK_ROWS = 20_000


def spread(df: DataFrame, task_rows: int | None = None, by: Sequence[Column | str] = ()) -> DataFrame:
    """Deal a scan to tasks of at most ``task_rows`` rows (default: ``TASK_ROWS``), and to every core.

    A scan is split by the bytes it reads, and a row group is never split; what is made of the rows here is far larger
    than they are, so tasks are cut by rows, which are narrow and move once.  They are counted from the files' footers.
    ``by``: a task takes a range of these keys, of about that many rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // (task_rows or TASK_ROWS)))
    return df.repartitionByRange(tasks, *by) if by else df.repartition(tasks)
