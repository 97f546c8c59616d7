"""Streams of games: every function of games is stateless, so it runs on streams as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.columns import call


def read_games(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of Parquet files of games as they arrive under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def matching(games: DataFrame, pattern: str, movedata: str = "movedata") -> DataFrame:
    """The games of a table or stream that match a pattern; those that can't be decoded don't."""
    return games.where(call("scoutfish_query", movedata, pattern, tried=True))


def results_by_window(games: DataFrame, time: str = "utc_timestamp", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Games, their moves and White's score by window of time; rows that come later than ``late`` are left out of a stream."""
    points = F.when(F.col("result") == "1-0", 1.0).when(F.col("result") == "0-1", 0.0).when(F.col("result") == "1/2-1/2", 0.5)
    at = F.col(time).cast("timestamp")
    return games.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("games"), F.sum("ply_count").alias("plies"), F.avg(points).alias("white_score"))
