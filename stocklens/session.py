"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stocklens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC as time zone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def let_workers_import(spark: SparkSession) -> None:
    """Puts the folder of this library on the module path of Python workers that start from now on.

    Where the library is not installed and the session was started elsewhere, tasks would not find it. On a cluster
    whose machines do not share the folder, ship it with ``--py-files``.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        environment["PYTHONPATH"] = os.pathsep.join([home, *[p for p in known if p]])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a session that runs in one process (``local[...]``: tests, a laptop) gets a folder of its
    own where none is set. On a cluster a missing setting is an error, because executors would write
    to disks that the others cannot read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="stocklens-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result survives the loss of executors and cuts the lineage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stocklens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
