"""Makes the package importable on executors that don't share the driver's folders."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package along once an application, unless workers find it by PYTHONPATH or in the folder they start in."""
    known = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    app = spark.sparkContext.applicationId
    if ROOT in known or app in _sent:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lintel-')}/lintel", "zip", ROOT, "lintel")
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
