"""Record gates over a stream: they look at one row at a time, so they run unchanged as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseloom.operators.gates import BLOCKING, with_findings
from clauseloom.sources.io import CLAUSES


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Clause records from JSON lines files as they arrive in a folder."""
    return spark.readStream.schema(CLAUSES).json(path)


def gated(stream: DataFrame) -> DataFrame:
    """The stream with findings and blocked."""
    return with_findings(stream)


def finding_counts(stream: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Findings per window of time, policy and kind; rows later than `late` are left out once their window is closed."""
    rows = with_findings(stream.withWatermark(time, late)).select(time, "policy_id", F.explode("findings").alias("kind"))
    return rows.where(F.col("kind").isin(BLOCKING)).groupBy(F.window(time, window), "policy_id", "kind").count()


def write_clean(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows that nothing blocks, appended to parquet; what is there by now, then the query ends."""
    clean = gated(stream).where(~F.coalesce("blocked", F.lit(False))).drop("findings", "blocked")
    return clean.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
