"""Sessions: scoped configuration, which settings may change at run time, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(app: str = "tidemark", cpus: int | str = "*", **conf) -> SparkSession:
    """A session on this machine; ``cpus=1`` runs single-threaded. Static settings go in ``conf`` (dots as ``__``)."""
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    for key, value in ({"spark__sql__session__timeZone": "UTC", "spark__ui__enabled": "false"} | conf).items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cluster_session(app: str = "tidemark") -> SparkSession:
    """A session whose master and resources come from ``spark-submit``."""
    return SparkSession.builder.appName(app).getOrCreate()


def set_log_level(spark: SparkSession, level: str = "WARN") -> None:
    spark.sparkContext.setLogLevel(level)


def set_runtime_conf(spark: SparkSession, key: str, value) -> None:
    """Set a SQL setting; a static one (executor memory, say) raises instead of being ignored."""
    if not spark.conf.isModifiable(key):
        raise ValueError(f"{key} is fixed when the application starts")
    spark.conf.set(key, value)


@contextmanager
def scoped_conf(spark: SparkSession, settings: dict[str, object]) -> Iterator[SparkSession]:
    """Set SQL settings and put back what was there before.

    Plans are made when an action runs, so the action belongs inside the scope.
    """
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            set_runtime_conf(spark, key, str(value))
        yield spark
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def no_broadcast(spark: SparkSession):
    """A scope in which only explicit hints broadcast."""
    return scoped_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.adaptive.autoBroadcastJoinThreshold": -1})


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    top = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_modules.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, Path(top.name) / path.relative_to(top))
    context.addPyFile(target)
    context._tidemark_shipped = True
