"""Session helpers: a local session for tests, lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "clauseloom", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder named by spark.checkpoint.dir and read it back from there.

    The setting is read from the session; a folder of this machine is set only where it is unset and
    the master is this machine, else that is an error. Executors may be lost afterwards, the files stay.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="clauseloom-"))
    return df.checkpoint(eager=True)


#: Rows up to which a table that was counted is sent to all tasks.
SMALL = 20_000


def if_small(df: DataFrame) -> DataFrame:
    """df, written down, to be broadcast if it has SMALL rows at most; else it is joined as any other."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.limit(SMALL + 1).count() <= SMALL else kept


def tasks(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions for a stage of our own: what the session shuffles into, never less than at_least."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
