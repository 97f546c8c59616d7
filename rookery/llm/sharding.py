"""Contiguous shards whose largest is as small as can be.

Groups of rows that must stay together are ordered by their key. The smallest capacity
for which a greedy pass needs no more than ``shards`` shards is found by binary search; the greedy pass at
that capacity sets the cuts.

The sizes stay distributed, as running totals over range partitions. The driver holds
some known group ends only and, between two of them, whether there are others. A pass that
cuts at known ends bounds the capacity from above, one that may also cut anywhere between
unknown ones bounds it from below. Where the bounds differ, the stretches that a cut can fall
into are asked for in more detail, ``DETAIL`` ends at a time, until they meet: the result is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType

from .frames import checkpointed, col, fresh, table, text_of

SHARDS = 64
#: Stretches that one round asks for, each with two ends.
DETAIL = 20_000


class Ends:
    """Known group ends in running totals; ``hidden[i]``: others may lie between ends i and i + 1."""

    def __init__(self, total: int):
        self.at, self.hidden = [0, total], [True]

    def cuts(self, capacity: int, shards: int, anywhere: bool) -> list[int] | None:
        """Ends of the shards of a greedy pass, or None if they are too few. anywhere: hidden ends lie where they suit."""
        out, start = [], 0
        while start < self.at[-1]:
            if len(out) == shards:
                return None
            to = start + capacity
            if to >= self.at[-1]:
                out.append(self.at[-1])
                break
            i = bisect_right(self.at, to) - 1
            if not (anywhere and self.hidden[i]):
                to = self.at[i]
            if to <= start:
                return None
            out.append(to)
            start = to
        return out

    def least(self, shards: int, anywhere: bool) -> int:
        """The least capacity that suffices."""
        low, high = 0, self.at[-1]
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, shards, anywhere) is not None else (middle + 1, high)
        return low

    def unsure(self, low: int, high: int, shards: int) -> list[int]:
        """Stretches with hidden ends that a cut can fall into at a capacity from low to high."""
        out: set[int] = set()
        first = last = 0
        for _ in range(shards):
            first_to = self.at[bisect_right(self.at, first + low) - 1]
            first = max(first, first_to)
            i = bisect_right(self.at, last + high) - 1
            last = min(self.at[-1], last + high) if i < len(self.hidden) and self.hidden[i] else self.at[i]
            a, b = bisect_right(self.at, first) - 1, min(bisect_right(self.at, last), len(self.hidden))
            out.update(k for k in range(max(0, a - 1), b) if self.hidden[k])
        return sorted(out)

    def refine(self, found: dict[int, tuple[int, int, int]], asked: list[int]) -> None:
        """found: by bucket the least and the greatest end in it, and whether there may be others between."""
        hidden_after = {a: h for a, h in zip(self.at, self.hidden)}
        for k in asked:
            hidden_after[self.at[k]] = False
        for a, b, n in found.values():
            hidden_after[a] = a < b and n > 2
            if a < b:
                hidden_after.setdefault(b, False)
        self.at = sorted({*self.at, *hidden_after})
        self.hidden = [hidden_after.get(a, False) for a in self.at[:-1]]


def _running(groups: DataFrame) -> tuple[DataFrame, int]:
    """The groups with the running total of sizes at their end, and the total of all."""
    kind = groups.schema["g"].dataType.simpleString()
    ordered = checkpointed(groups.repartitionByRange("g").sortWithinPartitions("g"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            sums = np.cumsum(batch.column("size").to_numpy(zero_copy_only=False)) + total
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(np.full(len(sums), part, np.int32)), pa.array(sums, pa.int64())], names=["g", "part", "end"])

    local = checkpointed(ordered.mapInArrow(add, f"g {kind}, part int, end long"))
    sums = dict(sorted((r.part, r.total) for r in local.groupBy("part").agg(F.max("end").alias("total")).collect()))
    before, total = {}, 0
    for part, size in sums.items():
        before[part] = total
        total += size
    if not before:
        return local.select("g", "end"), 0
    offsets = groups.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    return local.join(F.broadcast(offsets), "part").select("g", (F.col("end") + F.col("before")).alias("end")), total


def _ask(running: DataFrame, low: list[int], high: list[int], each: int) -> dict[int, tuple[int, int, int]]:
    """Ends strictly inside the stretches (low, high), in ``each`` buckets a stretch: least, greatest, number of distinct by task."""
    lows, highs = np.array(low, np.int64), np.array(high, np.int64)
    width = np.maximum(1, -(-(highs - lows) // each))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = np.unique(batch.column("end").to_numpy(zero_copy_only=False))
            k = np.searchsorted(lows, end, "left") - 1
            inside = (k >= 0) & (end < highs[np.maximum(k, 0)])
            end, k = end[inside], k[inside]
            bucket = k * each + (end - lows[k] - 1) // width[k]
            name, first, n = np.unique(bucket, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(end[first]), pa.array(end[first + n - 1] if len(n) else end[:0]), pa.array(n)], names=["k", "a", "b", "n"])

    rows = running.select("end").mapInArrow(part, "k long, a long, b long, n long").groupBy("k").agg(F.min("a"), F.max("b"), F.sum("n"))
    return {r[0]: (r[1], r[2], r[3]) for r in rows.collect()}


def cut(running: DataFrame, total: int, shards: int, detail: int = DETAIL) -> list[int]:
    """Running totals at which the shards end, for the least capacity."""
    ends = Ends(total)
    while total:
        low, high = ends.least(shards, True), ends.least(shards, False)
        asked = ends.unsure(low, high, shards) if low < high else []
        if not asked:
            break
        bounds = [(ends.at[k], ends.at[k + 1]) for k in asked]
        found = _ask(running, [a for a, _ in bounds], [b for _, b in bounds], max(2, detail // len(asked)))
        ends.refine(found, asked)
    return ends.cuts(ends.least(shards, False), shards, False) or []


def with_shard(docs: DataFrame, group_col: str, size: Column, shards: int = SHARDS, detail: int = DETAIL) -> tuple[DataFrame, str]:
    """``docs`` with a column of shard numbers from 0, whose name is returned too.

    Rows with one group key stay together; the null key is a group, the first. Null sizes count as
    0, and groups of size 0 go to the shard that ends where they stand. There may be fewer
    shards than asked for. A group larger than the others' share makes the capacity. An empty table
    stays empty. Rows are assigned by comparing keys with the cuts, without a shuffle.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    groups = docs.select(col(group_col).alias("g"), F.coalesce(size.cast("long"), F.lit(0)).alias("size")).groupBy("g").agg(F.sum("size").alias("size"))
    running, total = _running(groups)
    running = checkpointed(running)
    at = np.array(cut(running, total, shards, detail), np.int64)

    @F.arrow_udf(returnType="int")
    def shard_of(end: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(at[:-1], end.to_numpy(zero_copy_only=False), "left").astype(np.int32))

    name = fresh(docs, "shard")
    last = running.where("g is not null").select("g", shard_of("end").alias("shard")).groupBy("shard").agg(F.max("g").alias("g")).orderBy("shard").collect()
    number = F.lit(0)
    if len(last) > 1 or (last and last[0].shard):
        # shard of a key: that of the first shard whose last key isn't below it
        shared = docs.sparkSession.sparkContext.broadcast(([r.g for r in last], np.array([*(r.shard for r in last), 0], np.int32)))
        kind = docs.schema[group_col].dataType
        if isinstance(kind, (IntegralType, StringType, DateType)):

            @F.arrow_udf(returnType="int")
            def shard_at(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                keys, shard = shared.value
                number = isinstance(kind, IntegralType)
                ends = np.array(keys, np.int64) if number else keys
                for batch in batches:
                    if number:
                        at = np.searchsorted(ends, pc.fill_null(batch, 0).to_numpy(zero_copy_only=False).astype(np.int64), "left")
                    else:
                        at = np.array([0 if k is None else bisect_left(ends, k) for k in batch.to_pylist()], np.int64)
                    yield pa.array(shard[at])

            number = shard_at(col(group_col))
        else:
            keys = F.array(*[F.lit(r.g).cast(kind) for r in last])
            number = F.coalesce(F.get(F.array(*[F.lit(int(r.shard)) for r in last]), F.size(F.filter(keys, lambda k: k < col(group_col)))), F.lit(0))
        number = F.when(col(group_col).isNull(), F.lit(0)).otherwise(number)
    return docs.withColumn(name, number.cast("int")), name


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with their shard: contiguous in doc_id, balanced in bytes of text."""
    return with_shard(docs, "doc_id", F.octet_length(text_of(docs, "text")))[0]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", F.coalesce(F.octet_length(text_of(docs, "text")), F.lit(0)).cast("long").alias("bytes"))
    sharded, name = with_shard(slim, "doc_id", F.col("bytes"))
    return sharded.select("doc_id", "bytes", F.col(name).alias("shard"))


SQL = f"""
WITH RECURSIVE g AS MATERIALIZED (SELECT doc_id, sum(strlen(coalesce(text, '')))::BIGINT AS s FROM documents GROUP BY doc_id),
l AS MATERIALIZED (SELECT list({{'n': 0::BIGINT, 'load': 0::BIGINT, 's': s}} ORDER BY doc_id NULLS FIRST) AS sizes, max(s) AS most, sum(s)::BIGINT AS total FROM g),
bs AS (
  SELECT 0::BIGINT AS low, total AS high FROM l
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE high END FROM (
    SELECT low, high, mid, mid >= most AND list_reduce(sizes, lambda a, x: {{
      'n': CASE WHEN a.load + x.s > mid THEN a.n + 1 ELSE a.n END, 'load': CASE WHEN a.load + x.s > mid THEN x.s ELSE a.load + x.s END, 's': 0::BIGINT }}, {{'n': 1::BIGINT, 'load': 0::BIGINT, 's': 0::BIGINT}}).n <= {SHARDS} AS ok
    FROM (SELECT low, high, (low + high) // 2 AS mid FROM bs WHERE low < high) b, l
  )
),
cap AS MATERIALIZED (SELECT min(high) AS c FROM bs WHERE low = high),
o AS MATERIALIZED (SELECT doc_id, s, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS i FROM g),
walk AS (
  SELECT i, doc_id, s, 0 AS shard, s AS load FROM o WHERE i = 1
  UNION ALL
  SELECT o.i, o.doc_id, o.s, CASE WHEN w.load + o.s > c THEN w.shard + 1 ELSE w.shard END, CASE WHEN w.load + o.s > c THEN o.s ELSE w.load + o.s END
  FROM walk w JOIN o ON o.i = w.i + 1, cap
)
SELECT d.doc_id, strlen(coalesce(d.text, ''))::BIGINT AS bytes, w.shard FROM documents d JOIN walk w ON d.doc_id IS NOT DISTINCT FROM w.doc_id
"""
