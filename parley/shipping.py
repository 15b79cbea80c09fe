"""Gives executors this package, as Spark's workers import it by name."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


@contextlib.contextmanager
def by_value(module: str):
    """What is pickled in this block takes the module's functions and classes along. Processes by which the driver plans a
    streaming source or a stateful operator don't get the files of `ship`."""
    there = sys.modules[module]
    cloudpickle.register_pickle_by_value(there)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(there)


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="parley-code-")  # the driver's own; Spark serves the file to executors from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{here.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
