"""Session helpers: conservative defaults for large clusters, and the shared
checkpoint folder used to cut lineage between retry rounds."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Defaults that matter at scale.  AQE re-plans joins and coalesces small
# shuffle partitions at run time; skew-join splitting handles hot items.
CLUSTER_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when the split needs an extra
    # shuffle after it: the aggregate that follows our "first success" join
    # then pre-aggregates the pieces of a hot item before that shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Explicit broadcasts are only of inputs whose size is fixed by
    # configuration (the retry schedule, a one-row cut); everything else is
    # broadcast by AQE only when its measured size is under this bound.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "proofloom", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the defaults above; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Of the defaults above, those that a session of the caller gets as well.
SKEW_SETTINGS = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin")


def split_skewed_joins(spark: SparkSession) -> None:
    """Skew-join settings for a session that ``get_spark`` did not build."""
    for key in SKEW_SETTINGS:
        spark.conf.set(key, CLUSTER_DEFAULTS[key])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python
    stages find it from any working directory.  The archive is built on the
    driver and served by Spark."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="proofloom-ship-"), "proofloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("proofloom", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system); unset, it is an error there.  Only a single-JVM local
    session (tests) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        sc_dir = spark.sparkContext.getCheckpointDir()
        configured = sc_dir
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="proofloom-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, in this application's own folder under
    the shared checkpoint folder.  Lazy frames read such tables, so they stay
    while the application runs; the folder can go when it has ended."""
    return f"{scratch_folder(spark)}/{name}-{os.urandom(8).hex()}"


def scratch_folder(spark: SparkSession) -> str:
    """Everything that this application writes for itself lies here."""
    return f"{checkpoint_dir(spark)}/proofloom/{spark.sparkContext.applicationId}"


def written(df, name: str):
    """The frame, written to this application's folder and read from there:
    what reads it several times does not make it anew."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df, rows: int) -> int:
    """Tasks for an exchange of ``df`` (counted here, so give it something
    cheap to count): those of ``shuffle.partitions``, and more where a task
    would get over ``rows`` rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def free_column(df, name: str) -> str:
    """A working-column name that no column of ``df`` has, in any spelling of
    upper and lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
