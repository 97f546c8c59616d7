"""Near duplicates by BagMinHash signatures of weighted word shingles.

A document is a bag: its shingles of ``SHINGLE`` words, each weighted by its number of
occurrences. Every shingle has, for each component of the signature, a Poisson process
of rate 1 in time over the weight axis. The axis is discretised at the whole numbers and
divided into octaves [0, 1), [1, 2), [2, 4), [4, 8) and so on. An octave's process over
all components is drawn at once, in ascending time; each point then descends the octave
by successive hash bits to one discrete weight and counts for the bags whose weight
reaches it. A component's signature is its earliest point, so two bags agree in it with
a probability of their weighted Jaccard similarity. Points later than all components' current
minima can't matter, so a bag needs about ``m log m`` points, however large it is.

Signatures are banded; bags that share a band are candidates, and the overlap of their
whole bags is computed before they count as duplicates. Pairs of a bag and the least one of its bucket are verified by their texts;
those across the components of a bucket, of which there may be as many as the square of its bags, by products of matrices, to which
every bag is sent once for each block of its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import checkpointed, col, fresh, join_units, table, text_of, with_units
from .words import constants, mix, shingles, slices, words

SHINGLE = 2
BANDS = 32
BAND_ROWS = 4
#: Texts signed at a time.
SIGN_ROWS = 256
#: Least weighted Jaccard similarity of two near duplicates.
THRESHOLD = 0.55
#: Bags of a bucket that are compared with as many others in one group, bags of one product, and its columns at most.
BLOCK, TILE, COLUMNS = 2048, 256, 16_384
_POINT, _WHERE, _NEXT = constants(3, 77)
_AGAIN = constants(1, 78)[0]
_LOW, _MASK = np.uint64(44), np.uint64((1 << 44) - 1)
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def bags(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and weight of every distinct shingle of every text, in this order."""
    s = shingles(words(texts), k)
    # one sort of the text's number and 44 bits of the shingle
    key = (s.doc().astype(np.uint64) << _LOW) | (s.hash & _MASK)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(key)))
    return (key[first] >> _LOW).astype(np.int64), key[first] & _MASK, weight


def _waits(h: np.ndarray) -> np.ndarray:
    """Standard exponential waiting times from hashes."""
    return -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(texts: pa.Array, m: int, k: int = SHINGLE, of: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts by ``m``, uint32) and whether each text has any shingle. of: the texts' bags, if they are there."""
    n = len(texts)
    doc, element, weight = of or bags(texts, k)
    total = np.bincount(doc, weights=weight, minlength=n)
    best = np.full(n * m, _UNSET)
    # every (element, octave) that its weight reaches
    octaves = np.frexp(weight.astype(np.float64) - 0.5)[1].clip(0) + 1
    row = np.repeat(np.arange(len(doc)), octaves)
    octave = np.arange(len(row)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(octave > 0, 1 << np.maximum(octave - 1, 0), 0)
    width = np.where(octave > 0, low, 1)
    doc, reach = doc[row], weight[row]
    seed = mix(element[row] + octave.astype(np.uint64) * _POINT)
    rate = m * width.astype(np.float64)
    time, drawn = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    # by horizon: once no component is empty at one, later points are later than all minima
    horizon = (np.log(m) + 4) / np.maximum(total, 1)
    now = np.arange(len(doc))
    while len(now):
        # the next points of every process, about as many as it has before its horizon
        ahead = rate[now] * (horizon[doc[now]] - time[now])
        many = np.ceil(ahead + np.sqrt(ahead) + 1).astype(np.int64)
        begin = np.cumsum(many) - many
        which = np.repeat(np.arange(len(now)), many)
        at = now[which]
        point = mix(seed[at] + (drawn[at] + np.arange(len(at)) - begin[which] + 1).astype(np.uint64) * _NEXT)
        passed = np.cumsum(_waits(point) / rate[at])
        passed += (time[now] - np.where(begin > 0, passed[begin - 1], 0.0))[which]
        time[now] = passed[begin + many - 1]
        drawn[now] += many
        soon = np.flatnonzero(passed <= horizon[doc[at]])
        at, point, passed = at[soon], point[soon], passed[soon]
        where = mix(point * _WHERE)
        level = low[at] + ((where >> np.uint64(32)) * width[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = doc[at] * m + ((where & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        key = (passed.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (point & np.uint64(0xFFFFFFFF))
        hit = level < reach[at]
        np.minimum.at(best, slot[hit], key[hit])
        now = now[time[now] < horizon[doc[now]]]
        if not len(now):
            empty = (best.reshape(n, m) == _UNSET).any(axis=1) & (total > 0)
            if empty.any():
                # a process beyond its old horizon kept its first point beyond as its time: draw that again
                horizon[empty] *= 2
                now = np.flatnonzero(empty[doc])
                time[now], drawn[now] = 0.0, 0
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, m), total > 0


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands don't share keys."""
    n, m = signature.shape
    rows = m // bands
    parts = signature.reshape(n, bands, rows).astype(np.uint64)
    factor = constants(rows, 5)
    total = (parts * factor).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * constants(1, 6)[0]
    return mix(total)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags given as sorted arrays with repetitions."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    tag = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
    _, where = np.unique(both, return_inverse=True)
    ca, cb = np.bincount(where[tag == 0], minlength=where.max() + 1), np.bincount(where[tag == 1], minlength=where.max() + 1)
    return float(np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum())


def _signed(units: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """uid, uhash, a 128-bit fingerprint of the bag, and the keys of its bands."""
    id_type = units.schema["uid"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column("text"), rows=SIGN_ROWS):
                doc, h, weight = found = bags(part, k)
                s, any_ = signatures(part, bands * rows, k, found)
                keys = band_keys(s, bands).view(np.int64)
                prints = []
                for seed in (11, 12):
                    x = mix(h + constants(1, seed)[0]) * weight.astype(np.uint64)
                    total = np.zeros(len(part), np.uint64)
                    np.add.at(total, doc, x)
                    prints.append(total.view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(part) + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
                full = pa.RecordBatch.from_arrays(
                    [batch.column("uid").slice(start, len(part)), batch.column("uhash").slice(start, len(part)), pa.array(prints[0]), pa.array(prints[1]), lists], names=["uid", "uhash", "p1", "p2", "bands"]
                )
                yield full.filter(pa.array(any_))

    return units.mapInArrow(sign, f"uid {id_type}, uhash long, p1 long, p2 long, bands array<long>")


def _similar(left: DataFrame, threshold: float, k: int) -> DataFrame:
    """Of pairs (a, b, text_a, text_b) those whose bags are similar enough: a, b, similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for batch in batches:
            out: list = []
            for t in range(0, batch.num_rows, 64):
                part = batch.slice(t, 64)
                own = words_bags(part.column("text_a"), k)
                others = part.column("text_b").to_pylist()
                for i, text in enumerate(others):
                    if text != last[0]:
                        last = (text, words_bags(pa.array([text], pa.string()), k)[0])
                    out.append(similarity(own[i], last[1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return left.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def words_bags(texts: pa.Array, k: int) -> list[np.ndarray]:
    out = []
    for _, part in slices(texts):
        s = shingles(words(part), k)
        out += [np.sort(s.hash[s.first[i] : s.first[i + 1]]) for i in range(len(part))]
    return out


def elements(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The bag of each text as a set: a shingle that occurs w times gives w elements, the same ones in every text, so that sets overlap as bags do."""
    out = []
    for bag in words_bags(texts, k):
        first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]])) if len(bag) else np.zeros(0, np.int64)
        again = (np.arange(len(bag)) - np.repeat(first, np.diff(np.append(first, len(bag))))).astype(np.uint64)
        out.append(np.where(again > 0, mix(bag + again * _AGAIN), bag))
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of all sets of a with all of b."""
    m, n = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
    item, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.concatenate([np.repeat(np.arange(len(a)), m), np.repeat(np.arange(len(b)), n)])
    right = np.arange(len(at)) >= m.sum()
    # only what both sides have can be common
    shared = (np.bincount(at[~right], minlength=len(item)) > 0) & (np.bincount(at[right], minlength=len(item)) > 0)
    kept = np.flatnonzero(shared[at])
    kept = kept[np.argsort(at[kept], kind="stable")]
    column, row, right = (np.cumsum(shared) - 1)[at[kept]], row[kept], right[kept]
    common = np.zeros((len(a), len(b)))
    for begin in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [begin, begin + COLUMNS]))
        c, r, side = column[part] - begin, row[part], right[part]
        x, y = np.zeros((len(a), int(c[-1]) + 1), np.float32), np.zeros((len(b), int(c[-1]) + 1), np.float32)
        x[r[~side], c[~side]] = 1
        y[r[side], c[side]] = 1
        common += x @ y.T
    return common / np.maximum(m[:, None] + n[None, :] - common, 1)


def _across(buckets: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (a, b) of roots, of a forest for each two blocks, that connect the components of every bucket (key, node, root) as all its similar pairs do; texts: (node, text)."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in elements(batch.column("text"), k)], pa.binary())], names=["node", "bag"])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        block, root = group.column("block").to_numpy(), group.column("root").to_numpy()
        order = np.lexsort((root, block))
        block, root = block[order], root[order]
        bag = [np.frombuffer(x, np.uint64) for x in group.column("bag").take(pa.array(order)).to_pylist()]
        low, high = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        to: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := to.get(x, x)) != x:
                to[x] = x = to.get(up, up)
            return x

        out = []
        for i in range(0, len(low), TILE):
            mine = low[i : i + TILE]
            for j in range(i if key[1] == key[2] else 0, len(high), TILE):
                other = high[j : j + TILE]
                # by root within a block, so a tile has one root if its ends do
                if root[mine[0]] == root[mine[-1]] == root[other[0]] == root[other[-1]]:
                    continue
                x, y = np.nonzero(overlaps([bag[r] for r in mine], [bag[r] for r in other]) >= threshold)
                both = np.sort(np.stack([root[mine[x]], root[other[y]]], axis=1), axis=1)
                for a, b in np.unique(both[both[:, 0] != both[:, 1]], axis=0).tolist():
                    if (a_ := top(a)) != (b_ := top(b)):
                        to[b_] = a_
                        out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    left = checkpointed(buckets.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("key").orderBy("root", "node")) - 1) / BLOCK)))
    spans = left.groupBy("key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    met = spans.alias("x").join(spans.alias("y"), "key").where("x.block <= y.block AND x.low <> y.high").select("key", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sent = met.withColumn("block", F.explode(F.array_distinct(F.array("i", "j")))).join(left, ["key", "block"])
    own = checkpointed(texts.join(left.select("node").distinct(), "node").select("node", "text").mapInArrow(coded, "node long, bag binary"))
    return checkpointed(sent.join(own, "node").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of edges (a, b). Nodes without edges aren't listed.

    Each round points every node at the least root next to it and then at that root's own
    root, until nothing changes; each round is written to the checkpoint folder.
    """
    both = checkpointed(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", "root", F.least("root", "near").alias("least"))
        # roots of trees that touch a lesser root are hooked to it
        hooks = step.groupBy(F.col("root").alias("h")).agg(F.min("least").alias("to"))
        moved = step.join(hooks, step.root == hooks.h).select("node", F.col("root").alias("was"), F.least("least", "to").alias("mid"))
        jump = label.select(F.col("node").alias("j"), F.col("root").alias("beyond"))
        new = checkpointed(moved.join(jump, moved.mid == jump.j, "left").select("node", "was", F.least("mid", F.coalesce("beyond", "mid")).alias("root")))
        changed = new.where("was <> root").limit(1).count()
        label = new.select("node", "root")
        if not changed:
            return label


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, band_rows: int = BAND_ROWS, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """Units that aren't kept: uid, uhash, and kept_id and kept_hash of the unit that stays of their group.

    A group is a connected component of near duplicates; the unit with the least (id, hash)
    stays, nulls first. Equal bags are one node from the start. In each bucket (bags that share
    a band) every bag is verified against the least one; then, where a bucket still holds bags of several
    components, all pairs across components are verified too, so that the components
    are those of all candidate pairs, while a bucket of many copies costs linear work.

    Null, empty and wordless texts are nobody's duplicates. Repeated rows are one unit. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    units = docs.select(col(id_col).alias("uid"), F.xxhash64(text_of(docs, text_col), col(text_col).isNull()).alias("uhash"), text_of(docs, text_col).alias("text"))
    signed = checkpointed(_signed(units.where(F.col("text").isNotNull()), bands, band_rows, k))
    # nodes are distinct bags, numbered by a hash of the fingerprint
    node = F.xxhash64("p1", "p2")
    members = signed.select("uid", "uhash", node.alias("node"))
    one = signed.groupBy(node.alias("node")).agg(F.min_by(F.struct("uid", "uhash", "bands"), F.struct("uid", "uhash")).alias("u"))
    one = checkpointed(one.select("node", "u.uid", "u.uhash", "u.bands"))
    keyed = one.select("node", F.explode("bands").alias("key"))
    sized = keyed.withColumns({"least": F.min("node").over(Window.partitionBy("key")), "n": F.count(F.lit(1)).over(Window.partitionBy("key"))})
    buckets = checkpointed(sized.where("n > 1").select("key", "node", "least"))

    wanted = buckets.select("node").distinct()
    texts = units.join(one.join(wanted, "node").select("node", "uid", "uhash"), (units.uhash == one.uhash) & units.uid.eqNullSafe(one.uid)).groupBy("node").agg(F.first("text").alias("text"))
    texts = checkpointed(texts)

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return checkpointed(_similar(pairs.join(a, "a").join(b, "b"), threshold, k))

    edges = verified(buckets.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    label = components(spark, edges)
    rooted = buckets.join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    more = _across(rooted.join(mixed, "key"), texts, threshold, k)
    if more.limit(1).count():
        label = components(spark, edges.select("a", "b").unionAll(more))

    grouped = members.join(label, "node", "left").select("uid", "uhash", F.coalesce("root", "node").alias("root")).distinct()
    stays = grouped.groupBy("root").agg(F.min(F.struct("uid", "uhash")).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = grouped.join(stays, "root").select("uid", "uhash", F.col("s.uid").alias("kept_id"), F.col("s.uhash").alias("kept_hash"))
    return checkpointed(out.where(~(F.col("uid").eqNullSafe(F.col("kept_id")) & (F.col("uhash") == F.col("kept_hash")))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, kept_id): a document that a near duplicate stands for, and the one that stays. See ``groups``."""
    return groups(docs, id_col, text_col, threshold=threshold).select(F.col("uid").alias("doc_id"), "kept_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, and one of each repeated unit; columns unchanged.

    Texts without words all stay, but for repetitions of the same id and text.
    """
    losers = groups(docs, id_col, text_col)
    left = join_units(docs, losers, id_col, text_col, "left_anti")
    tagged, uid, uhash = with_units(docs, id_col, text_col)
    counts = tagged.groupBy(uid, uhash).count().where("count > 1").select(F.col(uid).alias("uid"), F.col(uhash).alias("uhash"))
    repeated = checkpointed(counts)
    if not repeated.limit(1).count():
        return left
    again, a, b = with_units(join_units(left, repeated, id_col, text_col, "left_semi"), id_col, text_col)
    return join_units(left, repeated, id_col, text_col, "left_anti").unionAll(again.dropDuplicates([a, b]).drop(a, b))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
