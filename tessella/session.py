"""Session factory and the shared scratch folder.

``build_session`` is for local runs and tests.  On a cluster the session is
made by ``spark-submit``; the operators change none of its settings, but for
those that read texts in Python, which lower
``spark.sql.execution.arrow.maxBytesPerBatch`` to 8 MB where it is larger.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessella", cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, as many shuffle partitions as cores."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the workers, once an application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="tessella-code-")) / "tessella-code.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    context.addPyFile(str(bundle))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, by any path Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors and driver share, from ``spark.checkpoint.dir``; a temporary one on a local master where that is unset.

    On a cluster a folder of one machine would lose what other machines write,
    so that a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def rows_of(column):
    """A column of lists of equal length as the rows of an array of doubles, out of its buffer."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs its own tasks, never a whole
    chain of stages, and what is used twice is made once.  The table read back
    has no known partitioning, so that a join over it has a plain exchange on
    either side, which adaptive execution can split where a key is hot.  Tables
    are dropped by ``release`` or when the application ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out.tessella_path = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written within are deleted at the end: for long-lived sessions, around a query and the use of its result.

    What it gives keeps a table of ``materialize`` beyond the end: an operator
    that is done with large tables deletes them so, when all that it reads
    later is written.
    """
    before, kept = len(_written), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.tessella_path)
        return table

    try:
        yield keep
    finally:
        within = _written[before:]
        _written[before:] = [w for w in within if w[1] not in kept]
        release(before)
        _written.extend(w for w in within if w[1] in kept)


def release(keep: int = 0) -> None:
    """Delete every table that ``materialize`` wrote in this application, but for the first ``keep``."""
    while len(_written) > keep:
        spark, path = _written.pop()
        local = path.removeprefix("file://")
        if "://" not in local and Path(local).exists():
            shutil.rmtree(local, ignore_errors=True)
            continue
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended: its folder is the cluster's to clean
            return


atexit.register(release)
