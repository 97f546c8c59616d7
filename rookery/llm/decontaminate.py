"""Benchmark decontamination by spaced seeds.

A seed is a hash of the words that a fixed mask selects from a window, so a substituted
word at an ignored place doesn't matter. All
windows of the corpus are joined with all windows of the benchmark on their seeds. Around
every hit the document and the item are aligned without gaps, and the best stretches
of the alignment, where a match counts 1 and a substitution -2, are the verified overlap.

No stretch is missed: one that scores 4 begins with a run of three matches at least, or its score is spent by the
first substitution; after a run of just three a match must follow the substitution. So ``1111`` or ``11101`` hits it.

The benchmark's seeds are broadcast, in indexes of ``CHUNK_BYTES`` at most; a
larger benchmark takes further passes over the corpus, so no executor ever holds more of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import col, fresh, table, text_of
from .words import Words, constants, count_words, mix, slices, words

#: Every stretch of MIN_STRETCH holds a window of one of these.
MASKS = ("1111", "11101")
#: Bytes of an index at most, but for what a single longer item takes, and the bytes that a word of the benchmark takes in it.
CHUNK_BYTES = 64 << 20
WORD_BYTES = 8 + len(MASKS) * (8 + 4 + 4)
#: A stretch of so many matching words is a leak of itself.
LONG_RUN = 13
#: So is any overlap that covers this share of an item, and MIN_COVERED of its words.
MIN_SHARE = 0.5
MIN_COVERED = 8
#: Items of fewer words can't be told from common phrases and are not looked for.
MIN_ITEM = 5
#: Least score of a stretch that counts.
MIN_STRETCH = 4
#: Bits of the filter for each seed, at least.
_BLOOM_BITS = 16


def _seeds(w: Words, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose windows lie within their text, and their seeds."""
    taken = [j for j, c in enumerate(mask) if c == "1"]
    span, n = len(mask), len(w.hash)
    at = np.arange(n)
    inside = at + span <= np.repeat(w.first[1:], w.counts())
    m = n - span + 1
    if m <= 0:
        return at[:0], w.hash[:0]
    total = np.zeros(m, np.uint64)
    for j, f in zip(taken, constants(len(taken), 100 + number)):
        total += w.hash[j : j + m] * f
    keep = inside[:m]
    return at[:m][keep], mix(total[keep])


class Index:
    """The seeds of benchmark items of MIN_ITEM words at least."""

    def __init__(self, ids: list, texts: list[str | None]):
        w = words(pa.array(texts, pa.string()))
        self.ids, self.all, self.first, length = ids, w.hash, w.first, w.counts()
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for number, mask in enumerate(MASKS):
            at, h = _seeds(w, mask, number)
            keep = length[np.searchsorted(w.first, at, "right") - 1] >= MIN_ITEM
            hashes.append(h[keep])
            places.append(at[keep].astype(np.int32))
        h = np.concatenate(hashes)
        del hashes
        order = np.argsort(h, kind="stable")
        #: the seeds in order, and where in ``all`` their windows begin
        self.hash, self.place = h[order], np.concatenate(places)[order]
        self.bits = max(10, int(len(h) * _BLOOM_BITS - 1).bit_length())
        self.bloom = np.zeros(1 << (self.bits - 3), np.uint8)
        name = self.hash >> np.uint64(64 - self.bits)
        np.bitwise_or.at(self.bloom, (name >> np.uint64(3)).astype(np.int64), np.uint8(1) << (name & np.uint64(7)).astype(np.uint8))

    def item_words(self, i: int) -> np.ndarray:
        return self.all[self.first[i] : self.first[i + 1]]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.all, self.first, self.hash, self.place, self.bloom))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and diagonal (the text's place less the item's) of all hits, distinct."""
        found = []
        for number, mask in enumerate(MASKS):
            at, h = _seeds(w, mask, number)
            name = h >> np.uint64(64 - self.bits)
            near = (self.bloom[(name >> np.uint64(3)).astype(np.int64)] >> (name & np.uint64(7)).astype(np.uint8)) & 1 > 0
            at, h = at[near], h[near]
            a, b = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            times = b - a
            at, a = np.repeat(at, times), np.repeat(a, times)
            which = a + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
            doc = np.searchsorted(w.first, at, "right") - 1
            place = self.place[which].astype(np.int64)
            item = np.searchsorted(self.first, place, "right") - 1
            found.append(np.stack([doc, item, at - w.first[doc] - (place - self.first[item])]))
        hit = np.concatenate(found, axis=1)
        hit = hit[:, np.lexsort(hit[::-1])]
        new = np.ones(hit.shape[1], bool)
        new[1:] = (hit[:, 1:] != hit[:, :-1]).any(axis=0)
        return tuple(hit[:, new])

    def likely(self, w: Words, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Whether the matches on all diagonals of a hit's text and item are as many as the least leak needs."""
        size, text = np.diff(self.first)[item], np.diff(w.first)[doc]
        low, high = np.maximum(0, -diagonal), np.minimum(size, text - diagonal)
        matches = np.zeros(len(doc), np.int64)
        edges = np.cumsum(high - low)
        begin = 0
        while begin < len(doc):
            # about a million words at once
            end = max(begin + 1, int(np.searchsorted(edges, (edges[begin - 1] if begin else 0) + (1 << 20), "right")))
            n = (high - low)[begin:end]
            which = np.repeat(np.arange(begin, end), n)
            j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
            same = self.all[self.first[item[which]] + j] == w.hash[w.first[doc[which]] + diagonal[which] + j]
            matches[begin:end] = np.bincount(which[same] - begin, minlength=end - begin)
            begin = end
        pair = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]).astype(np.int64))
        total = np.bincount(pair, weights=matches)[pair]
        return total >= np.minimum(LONG_RUN, np.maximum(np.minimum(MIN_COVERED, size), MIN_SHARE * size))


def stretches(same: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches [a, b) of an alignment of scores 1 and -2, best first found from the left, of MIN_STRETCH at least."""
    out, score, start, best, at = [], 0, 0, 0, 0
    # by runs of matches and of substitutions
    edges = np.flatnonzero(same[1:] != same[:-1]) + 1 if len(same) else np.zeros(0, np.int64)
    begins = [0, *edges.tolist()] if len(same) else []
    for a, b, hit in zip(begins, [*begins[1:], len(same)], same[begins].tolist() if begins else []):
        if hit:
            if score <= 0:
                score, start, best = 0, a, 0
            score += b - a
            if score > best:
                best, at = score, b
        elif score > 0:
            # after so many substitutions the stretch is over
            if b - a >= min(-(-score // 2), (score - best + 6) // 2 + 1):
                if best >= MIN_STRETCH:
                    out.append((start, at))
                score = best = 0
            else:
                score -= 2 * (b - a)
    if best >= MIN_STRETCH:
        out.append((start, at))
    return out


def overlap(text: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int]:
    """Words of the item that verified stretches cover with a match, and the most matches in one stretch."""
    covered, longest = np.zeros(len(item), bool), 0
    for d in diagonals:
        low, high = max(0, -d), min(len(item), len(text) - d)
        same = item[low:high] == text[low + d : high + d]
        for a, b in stretches(same):
            covered[low + a : low + b] |= same[a:b]
            longest = max(longest, int(same[a:b].sum()))
    return int(covered.sum()), longest


def leaks(w: Words, index: Index) -> list[list[tuple]]:
    """For each text the items that it contains: (id, share of its words covered, most matches in a stretch)."""
    out: list[list[tuple]] = [[] for _ in range(len(w.first) - 1)]
    doc, item, diagonal = index.hits(w)
    if len(doc):
        keep = index.likely(w, doc, item, diagonal)
        doc, item, diagonal = doc[keep], item[keep], diagonal[keep]
    if not len(doc):
        return out
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(first, np.append(first[1:], len(doc))):
        d, i = int(doc[a]), int(item[a])
        own = index.item_words(i)
        n = len(own)
        covered, longest = overlap(w.hash[w.first[d] : w.first[d + 1]], own, diagonal[a:b].tolist())
        if longest >= LONG_RUN or covered >= max(min(MIN_COVERED, n), MIN_SHARE * n):
            out[d].append((index.ids[i], covered / n, float(longest)))
    return out


def chunks(benchmark: DataFrame, id_col: str, text_col: str, most: int = CHUNK_BYTES) -> Iterator[Index]:
    """Indexes of parts of the benchmark, of about ``most`` bytes each; a longer item is a part by itself."""
    @F.arrow_udf(returnType="long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(count_words(batch), pa.int64())

    slim = benchmark.select(col(id_col).cast("string").alias("i"), text_of(benchmark, text_col).alias("t")).where(F.length(F.trim("t")) > 0).distinct()
    parts = max(1, -(-int(slim.agg(F.sum(count("t"))).first()[0] or 0) * WORD_BYTES // most))
    for k in range(parts):
        rows = slim.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()
        if rows:
            rows.sort(key=lambda r: (r.i is not None, r.i or "", r.t))
            yield Index([r.i for r in rows], [r.t for r in rows])


def with_leaks(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a list column of structs (item, share, longest), whose name is returned too; empty lists for clean texts."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(returnType="array<struct<item:string,share:double,longest:double>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item", pa.string()), ("share", pa.float64()), ("longest", pa.float64())]))
        for batch in batches:
            out = [x for _, part in slices(batch) for x in leaks(words(part), shared.value)]
            yield pa.array([[{"item": i, "share": s, "longest": n} for i, s, n in x] for x in out], kind)

    name = fresh(docs, "leaks")
    return docs.withColumn(name, find(text_of(docs, text_col))), name


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """A row (doc_id, item, share, longest) for every document and benchmark item whose overlap is a leak.

    Null, empty and wordless texts, on either side, leak nothing; nor do items under
    ``MIN_ITEM`` words. A document shorter than an item is searched too: what counts is the share of the item that it has. Repeated documents give repeated rows, repeated items one. An empty benchmark
    or corpus gives no rows. Other columns are left out. Whole texts are searched.
    """
    slim = docs.select(col(id_col).alias("doc_id"), text_of(docs, text_col).alias("text"))
    out = slim.limit(0).select("doc_id", F.lit("").alias("item"), F.lit(0.0).alias("share"), F.lit(0.0).alias("longest"))
    for index in chunks(benchmark, item_id_col, item_text_col, most):
        found, name = with_leaks(slim, index)
        out = out.unionAll(found.select("doc_id", F.inline(col(name))))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` without the rows that leak an item; null and empty texts stay; columns unchanged."""
    for index in chunks(benchmark, item_id_col, item_text_col, most):
        found, name = with_leaks(docs, index, text_col)
        docs = found.where(F.size(col(name)) == 0).drop(name)
    return docs


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
