"""Session helpers and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def session(app: str = "quantloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; cluster settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Local sessions without the setting get a temporary folder. A cluster must
    name one, because a folder on one machine is lost with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="quantloom-")
    return _LOCAL_ROOTS[app]


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage so that later jobs neither recompute nor resample it, and an
    executor lost afterwards takes nothing with it. Column pruning and predicate
    pushdown work on the stored table.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/quantloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once, so that task functions can be imported there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    made = os.path.join(tempfile.mkdtemp(prefix="quantloom-code-"), "quantloom.zip")
    with zipfile.ZipFile(made, "w") as out:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(made)
    _SHIPPED.add(context.applicationId)
