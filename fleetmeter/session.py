"""Session settings the jobs rely on. A cluster's own settings win over these."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Runtime settings; each is applied only where the session leaves it unset.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
#: Settings fixed at start-up.
STATIC_DEFAULTS = {
    # Column expressions otherwise record their Python call site, which costs more than building the plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(app_name: str = "fleetmeter", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and the defaults above; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC_DEFAULTS, **RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built.

    Timestamps in the telemetry are UTC wall-clock values, so truncation to an hour must run in UTC.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    explicit = dict(spark.sparkContext.getConf().getAll())
    for key, value in RUNTIME_DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a temporary folder:
    on a cluster the executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="fleetmeter-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")
