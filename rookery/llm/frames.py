"""Helpers for DataFrames: quoting, fresh names, checkpoints, and the identity of a row.

A *unit* is a document as the operators see it: one value of the id column together
with one text. Rows that agree in both are repetitions of one unit.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_of(df: DataFrame, name: str) -> Column:
    return col(name).cast("string")


def unit_keys(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The identity of a unit as two null-safe columns, ``uid`` and ``uhash``."""
    return [col(id_col).alias("uid"), F.xxhash64(text_of(df, text_col), col(text_col).isNull()).alias("uhash")]


def with_units(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """``df`` with its unit keys under names that don't clash."""
    uid, uhash = fresh(df, "unit_id"), fresh(df, "unit_hash")
    a, b = unit_keys(df, id_col, text_col)
    return df.withColumns({uid: a, uhash: b}), uid, uhash


def join_units(df: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """Semi or anti join of ``df`` with units listed in ``keys`` (uid, uhash); null ids match."""
    tagged, uid, uhash = with_units(df, id_col, text_col)
    left, right = tagged.alias("l"), keys.select("uid", "uhash").alias("r")
    on = F.col(f"l.{uhash}").eqNullSafe(F.col("r.uhash")) & F.col(f"l.{uid}").eqNullSafe(F.col("r.uid"))
    return left.join(right, on, how).drop(uid, uhash)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is what the session names in ``spark.checkpoint.dir``; a temporary one
    is used only for a local master that names none.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rookery-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt to all of them, since what follows costs far more than moving its rows."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # only their number leaves the JVM
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df
