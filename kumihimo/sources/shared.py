"""Intermediate tables that several jobs read.

An expensive intermediate result (a signature table, an edge list) is written once, as
compressed Parquet, below the folder in ``spark.checkpoint.dir``, which every executor can
read, so an executor may be lost at any time without the result being lost with it. A
session's tables lie in one folder of its own, which is removed when its driver ends, or
before that by ``clear``.
"""

from __future__ import annotations

import atexit
import io
import itertools
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_numbers = itertools.count()
_session = uuid.uuid4().hex
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set on a local master (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not (sc.master.startswith("local[") or sc.master == "local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="kumihimo-")
            atexit.register(clear, spark, shared)
        sc.setCheckpointDir(shared)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def session_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/kumihimo-{_session}"


def clear(spark: SparkSession, folder: str | None = None) -> None:
    """Remove the tables written by this session; frames that read them can't be used after."""
    try:
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(folder or session_folder(spark))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone by now, and its folder with it
        pass


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run within are removed as each ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, its lineage cut and its shuffle files removed.

    It is read with ``schema`` if given, such as one of vectors for their stored form.
    """
    spark = df.sparkSession
    number = next(_numbers)
    if not number:
        atexit.register(clear, spark)
    path = f"{session_folder(spark)}/{number}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, wherever the driver was started: once a session.

    A zip of the sources is put into the session's shared folder, from which Spark hands it out.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    target = f"{session_folder(spark)}/{root.name}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    sc.addPyFile(target)
