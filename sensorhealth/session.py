"""Session settings, the shared folder, lineage cuts and shipping the package to workers."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Compressed bytes that adaptive execution gives to one task after a shuffle. Telemetry compresses to a
#: few bytes a row and a chain of windows holds about a kilobyte of each, so the default of 64 MB
#: is gigabytes in a task.
SHUFFLED = "4m"


#: Bytes of a generated method. The JVM never compiles longer ones but interprets them row by row, and the
#: default of 65535 lets them through; above this Spark runs such a stage by smaller methods.
COMPILED = "8000"


def configure(spark: SparkSession) -> SparkSession:
    """Settings every plan of the library relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return root


def local_scratch(spark: SparkSession) -> SparkSession:
    """For entry points and tests: a scratch folder where a local session names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local[") or not named and context.master == "local":
        context.setCheckpointDir(_own_folder("sensorhealth-"))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/sensorhealth/{name}-{uuid.uuid4().hex}"


#: Tables written below the shared folder, by application.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a columnar table to the shared folder and reading it back.

    The copy survives executor loss, and its known size lets the planner choose a broadcast
    only for tables that really are below the session's threshold. It stays until
    ``delete_tables`` or the end of a ``temporary_tables`` block.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_tables(spark: SparkSession, after: int = 0) -> int:
    """Delete what ``materialize`` has written, but for the first ``after`` tables; how many were deleted.

    Frames that still read them can't be used any more.
    """
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone = paths[after:]
    del paths[after:]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end; write or collect results before."""
    before = len(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        delete_tables(spark, before)


def _own_folder(prefix: str) -> str:
    """A folder of this driver that goes when it ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    top, data = os.path.dirname(package), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, top))
    target = os.path.join(_own_folder("ship-"), "sensorhealth_package.zip")
    with open(target, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)
    return spark
