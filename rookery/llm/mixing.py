"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has an inclusion probability that gives it its target share of the words of
the mix. Of given weights the mix is as large as it can be without repeating a document. By default its size
is fixed from the words of the corpus, and scarce sources are taken whole, so that none shrinks the others. Within a source
the vector of probabilities is moved along the null space of two constraints, the number of
documents and the number of words, at random and without drift, until all but two
coordinates at most are 0 or 1 (the flight). Sources are cut into blocks by a hash, each
with a flight of its own; what the blocks leave, two documents each, is the input of the next
level, until a source is one block. The last leftovers of all sources fly together, and
the two that remain of those are landed: first the words, then the documents are let go.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import checkpointed, col, join_units, table, text_of
from .words import count_words, mix

#: A source's weight is its number of words to this power, if no weights are given.
POWER = 0.5
#: Documents that fly together at most, about.
BLOCK = 5000
_EPS = 1e-9


def _step(p: list[float], active: list[int], u: tuple[float, ...], draw: float) -> None:
    """Moves the active probabilities along ``u`` or against it until one is 0 or 1; the expectation stays."""
    up = down = float("inf")
    for i, x in zip(active, u):
        if x > 0:
            up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
        elif x < 0:
            up, down = min(up, -p[i] / x), min(down, -(1 - p[i]) / x)
    step = up if draw * (up + down) < down else -down
    for i, x in zip(active, u):
        v = p[i] + step * x
        p[i] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v


def flight(p: list[float], t: list[float], draws: list[float]) -> list[float]:
    """Probabilities after the flight; of those strictly between 0 and 1, two at most, of different sizes.

    The sum of p and the sum of p * t stay what they were. Each step takes the next draw; there are no more
    steps than coordinates, since each makes one whole.
    """
    p = list(p)
    draw = iter(draws)
    active: list[int] = []
    waiting = [i for i in range(len(p)) if 0 < p[i] < 1]
    waiting.reverse()
    while True:
        active = [i for i in active if 0 < p[i] < 1]
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            a, b, c = (t[i] for i in active)
            u: tuple[float, ...] = (c - b, a - c, b - a)
            if a == b == c:
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and t[active[0]] == t[active[1]]:
            u = (1.0, -1.0)
        else:
            return p
        scale = max(map(abs, u))
        _step(p, active, tuple(x / scale for x in u), next(draw))


def landing(p: list[float], draws: list[float]) -> list[float]:
    """All probabilities 0 or 1: pairs trade until one is whole, then the last is drawn by itself."""
    p = list(p)
    draw = iter(draws)
    while len(active := [i for i in range(len(p)) if 0 < p[i] < 1]) > 1:
        _step(p, active[:2], (1.0, -1.0), next(draw))
    for i in active:
        p[i] = 1.0 if next(draw) < p[i] else 0.0
    return p


def _draws(h: pd.Series, level: int) -> list[float]:
    x = mix(h.to_numpy(np.int64).view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return ((x >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()


def probabilities(words: Mapping, weights: Mapping | None, power: float) -> dict:
    """Inclusion probability by source. Sources without words get 1 (they add none), those without a weight 0.

    Given weights are met exactly, so the scarcest source bounds the mix. By default the corpus's words are dealt by weight:
    a source with no more than its part is whole, the others give their part. That is the water-filling of a
    mix of this size; a tiny source hardly changes it.
    """
    share = {s: (float(n) ** power if weights is None else float(weights.get(s, 0.0))) for s, n in words.items()}
    can = [words[s] / share[s] for s in words if words[s] > 0 and share[s] > 0]
    total = min(can, default=0.0)
    if weights is None and can:
        total = sum(float(n) for n in words.values() if n) / sum(share[s] for s, n in words.items() if n)
    return {s: (1.0 if share[s] > 0 or weights is None else 0.0) if not n else min(1.0, total * share[s] / n) for s, n in words.items()}


def sampled(docs: DataFrame, weights: Mapping | None = None, power: float = POWER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """uid, uhash, source, words, probability, selected of every unit of ``docs``.

    A null source is a source of its own. Null, empty and wordless texts have 0 words. Repeated rows are
    one unit of one row's words; if they differ in source, the least source, nulls first, is theirs. Of
    equal sizes and ids all is decided by hashes, so that a run can be repeated. An empty
    table gives no rows. Other columns are ignored.
    """

    @F.arrow_udf(returnType="long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(count_words(batch), pa.int64())

    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("uid"), F.xxhash64(text_of(docs, text_col), col(text_col).isNull()).alias("uhash"), F.struct(col(source_col).cast("string").alias("v")).alias("s"), count(text_of(docs, text_col)).alias("words"))
    units = checkpointed(rows.groupBy("uid", "uhash").agg(F.min("s")["v"].alias("source"), F.first("words").alias("words")))
    totals = {r.source: (r.n, r.words) for r in units.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).collect()}
    chance = probabilities({s: w for s, (_, w) in totals.items()}, weights, power)
    rates = spark.createDataFrame([(s, chance[s]) for s in chance], "source string, probability double")
    state = units.join(F.broadcast(rates) if len(chance) < 100_000 else rates, units.source.eqNullSafe(rates.source)).select("uid", "uhash", units.source, "words", "probability", F.col("probability").alias("p"), F.xxhash64("uid", "uhash").alias("h"))
    schema, done, level = state.schema, [], 0
    keep = [f.name for f in schema]
    while True:
        def fly(frame: pd.DataFrame, level: int = level, land: bool = False) -> pd.DataFrame:
            frame = frame.sort_values(["h", "words"], kind="stable")
            draws = _draws(frame["h"], level)
            p = flight(frame["p"].tolist(), frame["words"].astype(float).tolist(), draws)
            return frame.assign(p=landing(p, _draws(frame["h"], level + 1)) if land else p)[keep]

        sizes = spark.createDataFrame([(s, max(1, -(-n // block))) for s, (n, _) in totals.items()], "b_source string, blocks int")
        blocked = state.join(F.broadcast(sizes) if len(totals) < 100_000 else sizes, state.source.eqNullSafe(sizes.b_source))
        blocked = blocked.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")))
        moved = checkpointed(blocked.groupBy("b_source", "block").applyInPandas(lambda f: fly(f[keep]), schema))
        open_ = moved.where("p > 0 and p < 1")
        done.append(moved.where("p <= 0 or p >= 1"))
        state, level = open_, level + 1
        single = all(n <= block for n, _ in totals.values())
        totals = {r.source: (r.n, 0) for r in open_.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        if single or not totals:
            break
    if totals:
        done.append(checkpointed(state.groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: fly(f[keep], level, True), schema)))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select("uid", "uhash", "source", "words", "probability", (F.col("p") > 0.5).alias("selected"))


def mixed(docs: DataFrame, weights: Mapping | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` whose unit is selected, columns unchanged. See ``sampled``."""
    chosen = sampled(docs, weights, POWER, id_col, text_col, source_col).where("selected")
    return join_units(docs, chosen, id_col, text_col, "left_semi")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "documents")).select(F.col("uid").alias("doc_id"), "source", "words", "probability", "selected")
