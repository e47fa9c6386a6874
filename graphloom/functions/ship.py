"""Send this package to the executors, so that Python tasks can import it wherever they run."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file to the session's context, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="graphloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)


def shipped(f):
    """``f`` whose first argument is a session, with ``ship`` before it."""

    @functools.wraps(f)
    def run(spark, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return run
