"""What every executor must reach: the shared folder and this package."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="sagalog-")
        found = _OWN_DIRS[app]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sagalog-{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, in case it is not installed there.

    The archive lies in the shared folder, from where Spark hands it out.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    top = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, str(Path(top.name) / path.relative_to(top)))
    target = f"{scratch_path(spark, 'code')}/{top.name}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(target)
