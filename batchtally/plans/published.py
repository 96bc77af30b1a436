"""Things on storage that change as a whole.

New content goes to a folder of its own; a small pointer file that names it is
renamed into place last. Readers see the old version or the new one, also after
a crash between the two steps. The version before stays for one more
round, for readers that have begun with it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from batchtally.plans.storage import remove

POINTER = "_current"  # Spark's readers skip names with an underscore


def _pointer(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def read_pointer(spark: SparkSession, root: str) -> dict[str, Any]:
    """What was committed last; empty before the first commit."""
    fs, path = _pointer(spark, root)
    if not fs.exists(path):
        return {}
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_pointer(spark: SparkSession, root: str, content: dict[str, Any]) -> None:
    """Commit ``content`` by one rename over the old pointer."""
    fs, path = _pointer(spark, root)
    hadoop = spark._jvm.org.apache.hadoop.fs
    written = hadoop.Path(path.getParent(), f"{POINTER}-{uuid.uuid4().hex}")
    stream = fs.create(written)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    how = getattr(hadoop, "Options$Rename")
    over = spark._sc._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    hadoop.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(written, path, over)


def fresh_folder(label: str) -> str:
    return f"{label}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a new folder below ``root`` and make it the current version."""
    before = read_pointer(spark, root)
    folder = fresh_folder("v")
    write(f"{root}/{folder}")
    write_pointer(spark, root, {"current": folder, "before": before.get("current")})
    if before.get("before"):
        remove(spark, f"{root}/{before['before']}")


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version; None before the first."""
    folder = read_pointer(spark, root).get("current")
    return f"{root}/{folder}" if folder else None
