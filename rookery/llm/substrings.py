"""Repeated passages across documents, found by difference-cover anchors.

A window of ``w`` words is hashed only at places whose number modulo the period v = 31 lies in
the cover D = {1, 5, 11, 24, 25, 27}. Every residue is a difference of two members of D, so
for any two places i and j there is a shift below v that takes both into the cover: if
two documents share ``length = w + v - 1`` words, they share an anchor, whatever the places.
Anchors that two documents have are extended to every window of ``length`` words around them, compared
by 128-bit hashes; those that two documents have cover the repeated passages. Work is linear
in the anchors and windows: no pairs are formed, so a passage may repeat any number of times.

The windows around a document's shared anchors lie in stretches. A stretch that another document has as a whole, as copies and
licence lines do, is shared throughout: one hash settles it, and only one of its owners sends its windows, marked as shared, for the sake of others that have a part of it.
Of the rest too, a task that itself meets a window in two documents sends one mark of it, and its own places straight to
their documents. So however often a passage repeats, no key gets more than about one row from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import checkpointed, col, table, text_of
from .words import Words, mix, powers, slices, windows, words

PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Least number of words of a repeated passage.
LENGTH = 50
_COVERED = np.isin(np.arange(PERIOD), COVER)
_LOW32 = np.int64(0xFFFFFFFF)
#: Shared hashes that a task remembers at most; of more, one is marked again.
REMEMBERED = 1 << 17
#: Bits at most, 8 MB, of the filter that keeps texts without a shared anchor out of the shuffle; units beyond a tenth as many let ever more of these through to the join.
FILTER_BITS = 1 << 26
#: What a row is: a place whose hash is to be judged, a mark that the hash is shared, or so many places from this one on that are shared.
_JUDGE, _MARK = 0, -1


def _tagged(uhash: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The low half of a unit's hash and a place in its text as one number."""
    return (uhash << np.int64(32)) | place


class Known:
    """Hashes of 128 bits, or less, that a task has met in two units."""

    def __init__(self):
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def settle(self, a: np.ndarray, b: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows' hashes are known now, and one row of each that wasn't known before."""
        order = np.argsort(a, kind="stable")
        x, y, u = a[order], b[order], unit[order]
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
        if not len(first):
            return np.zeros(0, bool), np.zeros(0, np.int64)
        where = np.minimum(np.searchsorted(self.a, x[first]), max(0, len(self.a) - 1))
        before = (self.a[where] == x[first]) & (self.b[where] == y[first]) if len(self.a) else np.zeros(len(first), bool)
        shared = np.minimum.reduceat(u, first) != np.maximum.reduceat(u, first)
        new = first[shared & ~before]
        known = np.zeros(len(x), bool)
        known[order] = np.repeat(shared | before, np.diff(np.append(first, len(x))))
        if len(self.a) + len(new) > REMEMBERED:
            self.a, self.b = self.a[:0], self.b[:0]
        both = np.concatenate([self.a, x[new]]), np.concatenate([self.b, y[new]])
        by = np.argsort(both[0], kind="stable")[:REMEMBERED]
        self.a, self.b = both[0][by], both[1][by]
        return known, order[new]


def _candidates(part: pa.Array, lists: pa.Array, length: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the windows [i, i + length) that hold an anchor of their text's list, the text of each, and where their stretches begin among them."""
    x = words(part)
    places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
    # the anchor's place less 0 to PERIOD - 1
    n = len(x.hash)
    mark = np.zeros(n + 1, np.int64)
    anchor_at = x.first[doc] + places
    np.add.at(mark, np.maximum(anchor_at - PERIOD + 1, x.first[doc]), 1)
    np.add.at(mark, anchor_at + 1, -1)
    inside = np.arange(n) + length <= np.repeat(x.first[1:], x.counts())
    at = np.flatnonzero((np.cumsum(mark[:n]) > 0) & inside)
    doc = np.searchsorted(x.first, at, "right") - 1
    begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])])) if len(at) else np.zeros(0, np.int64)
    return x, at, doc, begin


def _stretch_hash(x: Words, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the words from begin to end, the same wherever they stand."""
    up, down = powers(len(x.hash))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.hash + np.uint64(seed)) * up[: len(x.hash)], dtype=np.uint64)])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _units(uid: pa.Array, uhash: np.ndarray) -> np.ndarray:
    """A number for each unit; repeated rows have the same."""
    codes = uid.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique((codes << np.int64(32)) | uhash, return_inverse=True)[1]


def _shared_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by keys, uid and tag, whose keys are marked or rows of another unit have too, and those that are known already.

    What is kept from batch to batch is the last key's rows while all are of one unit.
    """
    held: pa.Table | None = None
    passing: tuple | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        n = t.num_rows
        if not n:
            continue
        key = [t[k].to_numpy() for k in keys]
        tag, uid, what = t["tag"].to_numpy() >> np.int64(32), t["uid"], t["what"].to_numpy()
        new = np.ones(n, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        # a unit begins where its key, uid or hash does
        ids = uid.combine_chunks() if isinstance(uid, pa.ChunkedArray) else uid
        codes = ids.dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        many = (codes[first] != codes[last]) | (tag[first] != tag[last]) | np.logical_or.reduceat(what == _MARK, first)
        if passing is not None and tuple(k[0] for k in key) == passing:
            many[0] = True
        keep = np.repeat(many, last - first + 1)
        end = tuple(k[-1] for k in key)
        held, passing = (None, end) if many[-1] else (t.slice(int(first[-1])), None)
        keep = (keep & (what != _MARK)) | (what > 0)
        if held is not None:
            keep[first[-1] :] = False
        if keep.any():
            yield from t.select(["uid", "tag", "what"]).filter(pa.array(keep)).combine_chunks().to_batches()
    if held is not None:
        known = held.filter(pc.greater(held["what"], 0))
        if known.num_rows:
            yield from known.select(["uid", "tag", "what"]).combine_chunks().to_batches()


def _shared(df: DataFrame, keys: list[str]) -> DataFrame:
    """(uid, uhash, code) of the shared places; the code is the number of places, one after the other, and the first."""
    kind = df.schema["uid"].dataType.simpleString()
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, "uid", "tag")
    found = ordered.mapInArrow(lambda b: _shared_runs(b, keys), f"uid {kind}, tag long, what int")
    code = F.shiftleft(F.greatest("what", F.lit(1)).cast("long"), 32).bitwiseOR(F.col("tag").bitwiseAND(int(_LOW32)))
    return found.select("uid", F.shiftright("tag", 32).alias("uhash"), code.alias("code"))


def _among(df: DataFrame, units: DataFrame) -> DataFrame:
    """All rows of ``df`` whose uhash ``units`` has, and a few others; so that what a join with ``units`` drops isn't shuffled for it."""
    bits = min(FILTER_BITS, 1 << (16 * units.count() + 1024).bit_length())
    # uhash is uniform in its low bits
    at, bit = F.shiftright(F.col("uhash").bitwiseAND(bits - 1), 6), F.expr("shiftleft(1L, cast(uhash & 63 AS int))")
    found = units.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words_ = np.zeros(bits >> 6, np.int64)
    words_[found["at"].to_numpy()] = found["bits"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(words_)

    @F.arrow_udf(returnType="boolean")
    def may_be(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            h = batch.to_numpy(zero_copy_only=False) & np.int64(bits - 1)
            yield pa.array((shared.value[h >> 6] >> (h & 63)) & 1 > 0)

    return df.where(may_be("uhash"))


def _rows(keys: list[np.ndarray], unit: np.ndarray, place: np.ndarray, known: np.ndarray, marked: np.ndarray, uid: pa.Array, uhash: np.ndarray, runs: bool) -> tuple[list[np.ndarray], pa.Array, np.ndarray, np.ndarray]:
    """Keys, uid, tag and what of the rows to be sent for places in ascending order; unit: each one's row of uid and uhash; runs: known places make runs."""
    start = known.copy()
    if runs:
        start[1:] &= ~known[:-1] | (unit[1:] != unit[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(start)
    long = np.diff(np.append(np.flatnonzero(known).searchsorted(begin), known.sum()))
    rest = np.flatnonzero(~known)
    at = np.concatenate([rest, marked, begin])
    what = np.concatenate([np.full(len(rest), _JUDGE), np.full(len(marked), _MARK), long]).astype(np.int32)
    tag = _tagged(uhash[unit[at]], place[at])
    # known places don't go where all others of their key do
    spread = mix(tag[len(rest) + len(marked) :].view(np.uint64))
    out = [np.concatenate([k[at[: len(rest) + len(marked)]], spread if i == 0 else np.zeros_like(spread)]).view(np.int64) for i, k in enumerate(keys)]
    return out, uid.take(pa.array(unit[at])), tag, what


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row (uid, uhash, start, end) for each maximal run of words covered by shared windows of ``length`` words.

    uhash is the low half of the text's hash, start and end count words from 0, end excluded. A window is
    shared if another unit has it too; repetitions of a row are one unit, and passages that
    repeat only within one document aren't reported. Null, empty and short texts have no windows. An
    empty table gives no rows; other columns are ignored. Whole texts are searched.
    """
    w = length - PERIOD + 1
    if w < 1:
        raise ValueError(f"passages must have {PERIOD} words at least")
    slim = docs.select(col(id_col).alias("uid"), (F.xxhash64(text_of(docs, text_col)).bitwiseAND(0x7FFFFFFF)).alias("uhash"), text_of(docs, text_col).alias("text")).where(F.col("text").isNotNull())
    kind = slim.schema["uid"].dataType.simpleString()

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Known()
        for batch in batches:
            for start, part in slices(batch.column("text")):
                uid, uhash = batch.column("uid").slice(start, len(part)), batch.column("uhash").to_numpy(zero_copy_only=False)[start : start + len(part)]
                x = words(part)
                place = np.arange(len(x.hash)) - np.repeat(x.first[:-1], x.counts())
                room = np.repeat(x.counts(), x.counts())
                # texts shorter than a passage can't hold one
                at = np.flatnonzero(_COVERED[place % PERIOD] & (place + w <= room) & (room >= length))
                doc = np.searchsorted(x.first, at, "right") - 1
                # 48 bits are enough for what is compared in full later
                h = windows(x, w, 21)[at] >> np.uint64(16) if len(at) else np.zeros(0, np.uint64)
                known, marked = seen.settle(h, np.zeros_like(h), _units(uid, uhash)[doc])
                (h,), uid, tag, what = _rows([h], doc, place[at], known, marked, uid, uhash, False)
                yield pa.RecordBatch.from_arrays([pa.array(h), uid, pa.array(tag), pa.array(what)], names=["h", "uid", "tag", "what"])

    anchors = _shared(slim.mapInArrow(anchor, f"h long, uid {kind}, tag long, what int"), ["h"])
    by = anchors.groupBy("uid", "uhash").agg(F.collect_list(F.col("code").bitwiseAND(int(_LOW32)).cast("int")).alias("places"))
    by = checkpointed(by)
    unit = lambda a, b: F.col(f"{a}.uid").eqNullSafe(F.col(f"{b}.uid")) & (F.col(f"{a}.uhash") == F.col(f"{b}.uhash"))
    left = _among(slim, by).alias("d").join(by.alias("p"), unit("d", "p")).select("d.uid", "d.uhash", "text", "places")

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column("text")):
                x, at, doc, begin = _candidates(part, batch.column("places").slice(start, len(part)), length)
                first, n = at[begin], np.diff(np.append(begin, len(at)))
                a, b = (_stretch_hash(x, first, first + n - 1 + length, seed).view(np.int64) for seed in (41, 42))
                row = pa.array(start + doc[begin])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column("uid").take(row), batch.column("uhash").take(row), pa.array(first - x.first[doc[begin]]), pa.array(n)], names=["a", "b", "uid", "uhash", "begin", "n"])

    stretches = checkpointed(left.mapInArrow(stretch, f"a long, b long, uid {kind}, uhash long, begin long, n long"))
    owner = F.struct("uid", "uhash")
    groups = stretches.groupBy("a", "b").agg(F.min(owner).alias("least"), F.max(owner).alias("most"), F.min(F.struct("uid", "uhash", "begin")).alias("one")).where(~F.col("least").eqNullSafe(F.col("most")))
    whole = checkpointed(stretches.join(groups, ["a", "b"]).select("uid", "uhash", "begin", "n", F.struct("uid", "uhash", "begin").eqNullSafe(F.col("one")).alias("sends")))
    known = whole.groupBy("uid", "uhash").agg(F.collect_list(F.col("begin") * 2 + F.col("sends").cast("long")).alias("known"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Known()
        for batch in batches:
            for start, part in slices(batch.column("text")):
                uid, uhash = batch.column("uid").slice(start, len(part)), batch.column("uhash").to_numpy(zero_copy_only=False)[start : start + len(part)]
                x, at, doc, begin = _candidates(part, batch.column("places").slice(start, len(part)), length)
                place = at - x.first[doc]
                # stretches that are shared as a whole, and those of them that are sent from here
                lists = batch.column("known").slice(start, len(part))
                code = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                whose = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                name = (doc[begin] << np.int64(32)) | place[begin]
                n = np.diff(np.append(begin, len(at)))
                settled = np.repeat(np.isin(name, (whose << np.int64(32)) | (code >> 1)), n)
                sends = np.flatnonzero(np.repeat(np.isin(name, ((whose << np.int64(32)) | (code >> 1))[code & 1 > 0]), n))
                rest = np.flatnonzero(~settled)
                a, b = (windows(x, length, seed)[at] if len(at) else np.zeros(0, np.uint64) for seed in (31, 32))
                met, marked = seen.settle(a[rest], b[rest], _units(uid, uhash)[doc[rest]])
                marks = _rows([a[sends], b[sends]], doc[sends], place[sends], np.zeros(len(sends), bool), np.arange(len(sends)), uid, uhash, True)
                for (one, two), ids, tag, what in (_rows([a[rest], b[rest]], doc[rest], place[rest], met, marked, uid, uhash, True), marks):
                    batch_ = pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), ids, pa.array(tag), pa.array(what)], names=["a", "b", "uid", "tag", "what"])
                    # of what is sent for others' sake only the marks
                    yield batch_ if what is not marks[3] else batch_.filter(pc.equal(batch_["what"], _MARK))

    # repeated rows repeat their windows; that changes nothing
    left = left.alias("l").join(known.alias("k"), unit("l", "k"), "left").select("l.uid", "l.uhash", "text", "places", "known")
    found = _shared(left.mapInArrow(extend, f"a long, b long, uid {kind}, tag long, what int"), ["a", "b"])
    found = found.unionAll(whole.select("uid", "uhash", F.shiftleft("n", 32).bitwiseOR(F.col("begin")).alias("code")))
    lists = found.groupBy("uid", "uhash").agg(F.collect_list("code").alias("places"))

    @F.arrow_udf(returnType="array<struct<start:int,end:int>>")
    def spans(lists_: pa.Array) -> pa.Array:
        out = []
        for x in lists_:
            code = x.values.to_numpy()
            p, n = code & _LOW32, code >> np.int64(32)
            order = np.argsort(p, kind="stable")
            p, last = p[order], np.maximum.accumulate((p + n - 1)[order])
            first = np.flatnonzero(np.concatenate([[True], p[1:] - last[:-1] > length]))
            out.append([{"start": int(p[a]), "end": int(last[b - 1]) + length} for a, b in zip(first, np.append(first[1:], len(p)))])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return lists.select("uid", "uhash", F.inline(spans("places")))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are given as text, 'start-end' in words, so that doc_id is the only whole number."""
    found = repeated(table(spark, sf_dir, "documents"))
    return found.select(F.col("uid").alias("doc_id"), F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias("span"))


SQL = f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + {LENGTH}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(len(w) - {LENGTH - 1})) AS i FROM t WHERE len(w) >= {LENGTH})
), s AS (
  SELECT h FROM p GROUP BY h HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh
  FROM p WHERE h IN (SELECT h FROM s)
), g AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m
)
SELECT doc_id, min(i) || '-' || (max(i) + {LENGTH}) AS span FROM g GROUP BY doc_id, run
"""
