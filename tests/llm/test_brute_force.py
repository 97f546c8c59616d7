"""Mixing and the whole pipeline beside plain versions of themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import decontaminate as D
from rookery.llm import language as L
from rookery.llm import mixing as M
from rookery.llm import neardup as N
from rookery.llm import sharding as SH
from rookery.llm.queries import QUERIES

from .test_other_operators import SF, brute_capacity
from .test_text_operators import DE, EN, SCHEMA, brute_overlap, brute_profile, brute_similarity, plain_words, prose

BITS = (1 << 64) - 1


def draws(hashes, level):
    out = []
    for h in hashes:
        x = (h + (level + 1) * 0x9E3779B97F4A7C15) & BITS
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & BITS
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & BITS
        out.append(((x ^ (x >> 31)) >> 11) / 2**53)
    return out


def dense_flight(p, sizes, chances):
    """The flight step by step: the null space by a singular value decomposition, the invariants after every step."""
    p, chances = np.array(p, float), iter(chances)
    limits = np.stack([np.ones(len(p)), np.array(sizes, float)])
    want = limits @ p
    active, rest = [], [i for i in range(len(p)) if 0 < p[i] < 1]
    while True:
        active = [i for i in active if 0 < p[i] < 1]
        while len(active) < 3 and rest:
            active.append(rest.pop(0))
        if not active:
            return p
        a = limits[:, active]
        _, s, vt = np.linalg.svd(a / np.abs(a).max(axis=1, keepdims=True).clip(1e-300))
        null = vt[(s > 1e-9).sum() :]
        if not len(null):
            return p
        same = len(set(a[1])) == 1
        # of a plane of directions the one that leaves the third alone
        u = np.array([1.0, -1.0, 0.0][: len(active)]) if same else null[0]
        if not same and np.linalg.det(np.vstack([a, u])) < 0:
            u = -u
        assert np.abs(a @ u).max() < 1e-6 * np.abs(a).max()
        with np.errstate(divide="ignore"):
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u) if abs(x) > 1e-12)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u) if abs(x) > 1e-12)
        p[active] += (up if next(chances) * (up + down) < down else -down) * u
        p[p < 1e-9], p[p > 1 - 1e-9] = 0, 1
        assert np.allclose(limits @ p, want, rtol=1e-6, atol=1e-6) and (0 <= p).all() and (p <= 1).all()


def dense_landing(p, chances):
    p, chances = list(p), iter(chances)
    while len(open_ := [i for i, x in enumerate(p) if 0 < x < 1]) > 1:
        i, j = open_[:2]
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
        step = up if next(chances) * (up + down) < down else -down
        p[i], p[j] = (0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in (p[i] + step, p[j] - step))
    for i in open_:
        p[i] = float(next(chances) < p[i])
    return p


def brute_mix(units):
    """The units taken of (h, words, source), one block a source."""
    total = {}
    for _, n, s in units:
        total[s] = total.get(s, 0) + n
    share = {s: n**M.POWER for s, n in total.items()}
    size = sum(total.values()) / max(1e-300, sum(share[s] for s, n in total.items() if n))
    rate = {s: min(1.0, size * share[s] / n) if n else 1.0 for s, n in total.items()}
    p = {}
    for s in total:
        own = sorted(u for u in units if u[2] == s)
        p |= zip(own, dense_flight([rate[s]] * len(own), [n for _, n, _ in own], draws([h for h, _, _ in own], 0)))
    left = sorted((u for u in units if 0 < p[u] < 1), key=lambda u: u[:2])
    hashes = [h for h, _, _ in left]
    p |= zip(left, dense_landing(dense_flight([p[u] for u in left], [n for _, n, _ in left], draws(hashes, 1)), draws(hashes, 2)))
    return {u for u in units if p[u] > 0.5}, rate


def hashes(df):
    """Of every unit the hash that draws go by."""
    return {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("doc_id", F.xxhash64("text", F.col("text").isNull())).alias("h")).collect()}


@pytest.mark.parametrize("seed", range(8))
def test_flights_by_brute_force(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 60))
    p, t = r.random(n).round(3).clip(0.001, 0.999).tolist(), r.integers(0, 4 if seed % 2 else 500, n).astype(float).tolist()
    chances = r.random(2 * n + 2).tolist()
    assert np.allclose(M.flight(p, t, chances), dense_flight(p, t, chances), atol=1e-6)
    assert M.landing(p, chances) == dense_landing(p, chances)


def test_mixing_query_by_brute_force(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    h = hashes(docs)
    units = {(h[r.doc_id, r.text], len(plain_words(r.text)), r.source): r.doc_id for r in docs.collect()}
    taken, rate = brute_mix(list(units))
    got = QUERIES["op6_mixing"](spark, str(SF)).collect()
    assert len(got) == len(units) and {r.doc_id for r in got if r.selected} == {units[u] for u in taken}
    for r in got:
        assert abs(r.probability - rate[r.source]) < 1e-12


def brute_pipeline(spark, rows, items):
    """Rows (doc_id, text, lang, source) with their shard."""
    # language
    by = {}
    for _, t, lang, _ in rows:
        if t is not None and lang is not None:
            by.setdefault(lang, []).append(t)
    ranks = {lang: {g: k for k, g in enumerate(p, 1)} for lang, texts in by.items() if (p := brute_profile(texts, L.TOP))}

    def speaks(t, lang):
        mine = brute_profile([t or ""], L.TOP)
        far = {x: sum(abs(p[g] - k) if g in p else L.TOP for k, g in enumerate(mine, 1)) / max(1, len(mine)) for x, p in ranks.items()}
        return bool(mine) and (lang not in far or far[lang] - min(far.values()) <= L.MARGIN * L.TOP)

    rows = [r for r in rows if speaks(r[1], r[2])]
    # near duplicates: of a group the least id stays, nulls first, once
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda u: (u[0] is not None, u[0] or 0, u[1]))
    root = {u: u for u in order}
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if brute_similarity(a[1], b[1]) >= N.THRESHOLD:
                x, y = sorted((root[a], root[b]), key=order.index)
                root = {u: x if v == y else v for u, v in root.items()}
    rows = [next(r for r in rows if r[:2] == u) for u in order if root[u] == u]

    # decontamination
    def leaks(t):
        for q in items:
            if q and (n := len(plain_words(q))) >= D.MIN_ITEM:
                covered, longest = brute_overlap(t, q)
                if longest >= D.LONG_RUN or covered >= max(min(D.MIN_COVERED, n), D.MIN_SHARE * n):
                    return True
        return False

    rows = [r for r in rows if not leaks(r[1])]
    # mixing
    h = hashes(spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], SCHEMA))
    units = {(h[r[:2]], len(plain_words(r[1])), r[3]): r for r in rows}
    rows = [units[u] for u in brute_mix(list(units))[0]]
    # sharding
    sizes = {}
    for i, t, _, _ in rows:
        sizes[i] = sizes.get(i, 0) + len(t.encode())
    keys = sorted(sizes, key=lambda i: (i is not None, i or 0))
    most = brute_capacity([sizes[k] for k in keys], SH.SHARDS)
    shard, number, load = {}, 0, 0
    for k in keys:
        if load + sizes[k] > most:
            number, load = number + 1, 0
        load += sizes[k]
        shard[k] = number
    return sorted(((*r, shard[r[0]]) for r in rows), key=str)


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline as CP

    item = prose(70, 24, 5000)
    r = np.random.default_rng(1)
    rows = []
    for i in range(60):
        own, lang = (EN, "en") if i % 3 else (DE, "de")
        words = own.split() * 3
        r.shuffle(words)
        rows.append((i, " ".join(words) + " " + prose(i, 40, 10**5), lang, ["a", "b", None][i % 3 if i % 7 else 1]))
    rows += [
        (100, None, "en", "a"), (101, "", "en", "a"), (102, "12 -- !!", "de", "b"), (None, rows[5][1], "en", "a"), (103, rows[6][1] + " more", "de", "b"), (104, rows[7][1], "en", "a"), (104, rows[7][1], "en", "a"),
        (105, EN + " " + item + " " + EN, "en", "a"), (106, EN + prose(5, 30, 900), "de", "b"), (107, "the cat " * 5000 + prose(6, 20), "en", None), (108, DE, None, "c"), (109, EN + " once more", "xx", "c"),
    ]
    spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = CP.run(spark, str(tmp_path))
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "shard"]
    want = brute_pipeline(spark, rows, [item, None, "short"])
    assert sorted(((x.doc_id, x.text, x.lang, x.source, x.shard) for x in got.collect()), key=str) == want
    assert 20 < len(want) < 60 and {105, 106, 100, 101, 102}.isdisjoint({x[0] for x in want})
