"""Operators on documents: odd inputs with a defined result, and brute-force versions of what SQL can't express."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rookery.llm import decontaminate as D
from rookery.llm import language as L
from rookery.llm import neardup as N
from rookery.llm import substrings as S
from rookery.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat sat on the mat and the dog ran after the ball while the sun was high over the hills and the wind blew through the trees of the old town"
DE = "der hund lief durch den garten und die katze schlief auf dem dach während der wind durch die alten bäume wehte und die kinder im hof spielten"


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def table(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)
    # columns named like those that the operators make for themselves
    if extra:
        for c in ("unit_id", "unit_hash", "uid", "uhash", "language", "leaks", "shard", "node", "root", "key", "a.b"):
            df = df.withColumn(c, F.lit(c))
    return df


ODD = [(1, None, "en", "s"), (2, "", "en", None), (3, " \n ", None, "s"), (4, "12 -- !!", "en", "s"), (5, "word", "xx", "s"), (None, EN, "en", "s"), (7, EN, "en", "s"), (7, EN, "en", "s"), (8, "a " * 300_000, "en", "s"), (9, EN.replace("cat", "cow"), "de", "t")]


def ids(df, *c):
    return sorted(map(tuple, df.select(*c).collect()), key=str)


# words


def plain_words(text):
    import re

    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def test_words_agree_with_a_regular_expression():
    texts = ["Hello, héllo wörld-hello 12a", None, "", "x", "ÀB c", "...", "a" * 3000, " lead", "trail "]
    w = W.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        own = w.hash[w.first[i] : w.first[i + 1]].tolist()
        assert len(own) == len(plain_words(t))
        for token, h in zip(plain_words(t), own):
            assert seen.setdefault(token, h) == h
    assert len(set(seen.values())) == len(seen)
    assert W.count_words(pa.array(texts, pa.string())).tolist() == [len(plain_words(t)) for t in texts]
    assert W.windows(W.words(pa.array(["q a b c d e f g"])), 7, 3)[1] == W.windows(W.words(pa.array(["a b c d e f g"])), 7, 3)[0]
    assert [len(x) for _, x in W.slices(pa.array(["ab"] * 10), 4, 2)] == [2] * 5 and not list(W.slices(pa.array([], pa.string())))


# 8: language


def brute_profile(texts, top):
    import unicodedata

    count = Counter()
    for t in texts:
        t = " " + "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()) + " "
        t = " " + " ".join(t.split()) + " " if t.split() else " "
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                g = t[i : i + n]
                if g != " " and " " not in g[1:-1] and g.strip():
                    count[g] += 1
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:top]]


def test_out_of_place_distance_by_brute_force():
    texts = [EN, DE, "straße ÉTÉ naïve", "the the", "", "12"]
    profiles = {"en": [EN], "de": [DE]}
    fitted = [L._profile(p, 60) for p in profiles.values()]
    got, size = L.distances(texts, fitted, 60)
    for i, t in enumerate(texts):
        mine = brute_profile([t], 60)
        assert size[i] == len(mine)
        for k, p in enumerate(profiles.values()):
            ranks = {g: r for r, g in enumerate(brute_profile(p, 60), 1)}
            want = sum(abs(ranks[g] - r) if g in ranks else 60 for r, g in enumerate(mine, 1)) / max(len(mine), 1)
            assert abs(got[i, k] - want) < 1e-9


def test_language_odd_rows(spark):
    rows = [(100 + i, EN + f" number {i} of the day", "en", "s") for i in range(20)] + [(200 + i, DE + f" und der tag {i}", "de", "s") for i in range(20)]
    df = table(spark, rows + ODD)
    got = {(r.doc_id, r.lang): (r.predicted, r.kept) for r in L.language_id(df).collect()}
    assert got[1, "en"] == got[2, "en"] == got[3, None] == got[4, "en"] == (None, False)
    assert got[5, "xx"][1] or got[5, "xx"][0] == "xx"
    assert got[None, "en"] == got[7, "en"] == ("en", True) and got[9, "de"] == ("en", False)
    kept = L.stage(spark, df, "")
    assert kept.columns == df.columns and kept.where("doc_id = 7").count() == 2
    empty = L.language_id(table(spark, []))
    assert empty.count() == 0 and L.stage(spark, table(spark, []), "").count() == 0
    assert L.fit_profiles(table(spark, [])) == {}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = L.fit_profiles(docs.where("doc_id % 2 = 0"), rows=50)
    judged, name = L.identify(docs.where("doc_id % 2 = 1"), profiles)
    assert judged.agg(F.avg((F.col(name)["predicted"] == F.col("lang")).cast("double"))).first()[0] >= 0.97


# 2: near duplicates


def brute_similarity(a, b, k=2):
    bag = lambda t: Counter(tuple(w[i : i + k]) for w in [plain_words(t)] for i in range(max(min(len(w), 1), len(w) - k + 1)))
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def near_corpus():
    r = random.Random(5)
    docs = []
    for g in range(12):
        base = prose(g, 60 + 40 * g).split()
        docs.append(" ".join(base))
        for c in range(g % 5):
            copy = list(base)
            for _ in range(1 + len(base) // 40):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            docs.append(" ".join(copy))
    docs += [docs[0]] * 30 + ["tiny text", "tiny text", "tiny other"]
    return docs


def brute_groups(docs):
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if plain_words(docs[i]) and plain_words(docs[j]) and brute_similarity(docs[i], docs[j]) >= N.THRESHOLD:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {(i, find(i)) for i in range(len(docs)) if find(i) != i}


def test_near_duplicates_by_brute_force(spark):
    docs = near_corpus()
    df = table(spark, [(i, t, "en", "s") for i, t in enumerate(docs)])
    assert set(ids(N.near_duplicates(df), "doc_id", "kept_id")) == brute_groups(docs)
    left = N.stage(spark, df, "")
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(docs))) - {a for a, _ in brute_groups(docs)}


def test_near_duplicates_odd_rows(spark):
    df = table(spark, ODD)
    got = set(ids(N.near_duplicates(df), "doc_id", "kept_id"))
    assert got == {(7, None), (9, None)} or got == {(7, None)}
    left = sorted((str(r.doc_id) for r in N.stage(spark, df, "").collect()))
    assert left.count("7") == 0 and left.count("1") == left.count("2") == left.count("3") == left.count("8") == left.count("None") == 1
    # the two short prose texts differ by one word of 33, so all are of one group
    assert got == {(7, None), (9, None)} == {(ODD[i][0], ODD[j][0]) for i, j in brute_groups([t for _, t, _, _ in ODD]) if ODD[i][0] != ODD[j][0] or i < j} - {(7, 7)}
    twice = table(spark, [(1, None, "en", "s"), (1, None, "en", "s"), (2, "x y z", "en", "s"), (2, "x y z", "en", "s"), (2, "other words here", "en", "s")])
    assert ids(N.stage(spark, twice, ""), "doc_id", "text") == sorted([(1, None), (2, "x y z"), (2, "other words here")], key=str)
    assert N.near_duplicates(table(spark, [])).count() == 0 and N.stage(spark, table(spark, []), "").count() == 0


def test_signatures_estimate_weighted_similarity():
    r, errors = np.random.default_rng(0), []
    for _ in range(40):
        x = r.integers(0, 12, 200)
        y = x.copy()
        y[: r.integers(0, 100)] = r.integers(0, 15)
        texts = pa.array([" ".join(map(str, x)), " ".join(map(str, y))])
        s, _ = N.signatures(texts, 512)
        errors.append((s[0] == s[1]).mean() - brute_similarity(*texts.to_pylist()))
        assert (N.signatures(texts.slice(1), 512)[0][0] == s[1]).all()
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.035


def test_signature_weights_matter_and_are_cheap():
    s, _ = N.signatures(pa.array(["a b " * 5000, "a b " * 2500, "a b " * 5000 + "c"]), 256)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.12 and (s[0] == s[2]).mean() > 0.97


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 150)]
    got = {r.node: r.root for r in N.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 150, 150: 150}


def test_overlaps_by_brute_force(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcd") for _ in range(r.choice([0, 1, 2, 9, 60]))) for _ in range(40)]
    sets = N.elements(pa.array(texts))
    for columns in (N.COLUMNS, 7):
        monkeypatch.setattr(N, "COLUMNS", columns)
        got = N.overlaps(sets[:25], sets[25:])
        assert all(got[i, j] == (brute_similarity(texts[i], texts[25 + j]) if texts[i] and texts[25 + j] else 0) for i in range(25) for j in range(15))


def test_components_of_a_bucket_by_brute_force(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(prose(g % 12, 30).split()[: 14 + r.randrange(16)]) for g in range(60)]
    # some are of one component already
    rows = [(key, i, i % 24 if key else i) for key in (0, 1, 2) for i in range(60) if key < 2 or i % 2]
    buckets, df = spark.createDataFrame(rows, "key long, node long, root long"), spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = [(i, j) for i, j in itertools.combinations(range(60), 2) if brute_similarity(texts[i], texts[j]) >= N.THRESHOLD]

    def classes(edges):
        parent = list(range(60))
        for _ in range(60):
            for a, b in edges:
                parent[a] = parent[b] = min(parent[a], parent[b])
        return parent

    known = [(i % 24, i) for i in range(60)]
    want = classes(known + pairs)
    assert 1 < len(set(want)) < 24
    for block, tile in ((N.BLOCK, N.TILE), (7, 3), (1, 1)):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "TILE", tile)
        assert classes(known + [tuple(x) for x in N._across(buckets, df, N.THRESHOLD, N.SHINGLE).collect()]) == want


def test_a_bucket_of_unlike_texts_sends_no_text_for_each_pair(spark, monkeypatch):
    # a shingle that repeats gives all these a band in common; each is like its own copy alone
    docs = [" ".join(["round"] * 60 + [f"w{i}x{k}" for k in range(70)] + ["again"] * (i >= 150)) for i in [*range(150), *(150 + i for i in range(150))]]
    docs[150:] = [d.replace(f"w{150 + i}x", f"w{i}x") for i, d in enumerate(docs[150:])]
    sent = []
    own = N._similar
    monkeypatch.setattr(N, "_similar", lambda left, *a: sent.append(left.count()) or own(left, *a))
    df = table(spark, [(i, t, "en", "s") for i, t in enumerate(docs)])
    assert set(ids(N.near_duplicates(df), "doc_id", "kept_id")) == {(150 + i, i) for i in range(150)}
    assert sum(sent) <= N.BANDS * len(docs)


# 4: decontamination


def brute_overlap(text, item):
    """Best stretch scores over every alignment, without seeds."""
    t, q = W.words(pa.array([text])).hash, W.words(pa.array([item])).hash
    return D.overlap(t, q, list(range(-len(q) + 1, len(t))))


def test_every_leak_is_hit_at_any_length_and_substitution_rate():
    r = random.Random(12)
    kinds = {}
    for n in [*range(5, 25), 30, 45, 59]:
        for rate in (0, 0.01, 0.05, 0.1, 0.2):
            for k in range(12):
                item = [f"i{n}x{j}" for j in range(n)]
                # never fewer than one where the rate isn't 0
                places = set(r.sample(range(n), max(rate > 0, round(rate * n))))
                changed = [f"z{k}y{j}" if j in places else x for j, x in enumerate(item)]
                text = prose(13 + k, 20).split() + changed + prose(14 + k, 20).split()
                t = W.words(pa.array([" ".join(text)]))
                covered, longest = brute_overlap(" ".join(text), " ".join(item))
                want = longest >= D.LONG_RUN or covered >= max(min(D.MIN_COVERED, n), D.MIN_SHARE * n)
                got = D.leaks(t, D.Index(["q"], [" ".join(item)]))[0]
                assert got == ([("q", covered / n, float(longest))] if want else []), (n, rate, sorted(places))
                kinds.setdefault((n, rate > 0), set()).add(want)
    assert True in kinds[9, True] and True in kinds[12, True] and True in kinds[5, False]


def test_leaks_by_brute_force():
    r = random.Random(3)
    items = [prose(100 + i, n, 3000) for i, n in enumerate((6, 9, 14, 25, 40, 60))]
    texts = []
    for k in range(80):
        body = prose(1000 + k, 120, 3000).split()
        if k % 2:
            q = items[k % len(items)].split()
            for _ in range(len(q) // 14):
                q[r.randrange(len(q))] = "changed"
            if k % 3 == 0:
                q = q[: max(len(q) * 2 // 3, 6)]
            at = r.randrange(100)
            body[at:at] = q
        texts.append(" ".join(body))
    index = D.Index([str(i) for i in range(len(items))], items)
    got = D.leaks(W.words(pa.array(texts)), index)
    missed = extra = total = 0
    for t, found in zip(texts, got):
        for i, q in enumerate(items):
            covered, longest = brute_overlap(t, q)
            n = len(q.split())
            want = longest >= D.LONG_RUN or covered >= max(min(D.MIN_COVERED, n), D.MIN_SHARE * n)
            have = str(i) in {x for x, _, _ in found}
            total += want
            missed += want and not have
            extra += have and not want
    assert total >= 25 and missed <= total * 0.05 and not extra


def test_substitutions_are_tolerated():
    item = prose(7, 40, 5000).split()
    index = D.Index(["q"], [" ".join(item)])
    for every in (6, 8, 11):
        changed = [f"sub{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
        assert D.leaks(W.words(pa.array([prose(8, 50) + " " + " ".join(changed) + " " + prose(9, 50)])), index)[0]
    assert D.leaks(W.words(pa.array([prose(8, 500)])), index) == [[]]


def test_contamination_odd_rows(spark):
    item = prose(50, 30, 5000)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "too short"), (None, prose(51, 20, 5000))], "item_id long, text string").withColumn("leaks", F.lit(1)).withColumn("doc_id", F.lit(5))
    df = table(spark, ODD + [(20, "x y " + item + " z", "en", "s"), (21, prose(51, 20, 5000), "en", "s"), (20, "x y " + item + " z", "en", "s"), (22, "b " * 200_000 + item.upper(), "en", "s")])
    want = [(20, "1"), (20, "1"), (21, None), (22, "1")]
    for most in (D.CHUNK_BYTES, 100):
        assert ids(D.contaminated(df, bench, most=most), "doc_id", "item") == sorted(want, key=str)
        left = D.decontaminated(df, bench, most=most)
        assert left.columns == df.columns and left.count() == len(ODD) and {r.doc_id for r in left.collect()} == {r[0] for r in ODD}
    assert D.contaminated(table(spark, []), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0 and D.decontaminated(df, bench.limit(0)).count() == len(ODD) + 4


def test_stretches_word_by_word():
    def plain(same):
        out, score, start, best, at = [], 0, 0, 0, 0
        for i, hit in enumerate(same):
            if score <= 0:
                score, start, best, at = 0, i, 0, i
            score += 1 if hit else -2
            if score > best:
                best, at = score, i + 1
            if (score <= 0 or score < best - 6) and best >= D.MIN_STRETCH:
                out.append((start, at))
                score = best = 0
        if best >= D.MIN_STRETCH:
            out.append((start, at))
        return out

    r = np.random.default_rng(1)
    for _ in range(3000):
        same = r.random(r.integers(0, 60)) < r.choice([0.3, 0.6, 0.75, 0.9, 1.0])
        assert D.stretches(same) == plain(same)


def test_short_documents_and_the_size_of_an_index(spark):
    item = prose(77, 12, 5000)
    df = table(spark, [(1, " ".join(item.split()[:10]), "en", "s"), (2, " ".join(item.split()[:7]), "en", "s"), (3, item, "en", "s")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert ids(D.contaminated(df, bench), "doc_id", "item") == [(1, "1"), (3, "1")]
    words = 40_000
    index = D.Index(list(range(100)), [prose(i, words // 100, 10**6) for i in range(100)])
    assert index.nbytes() <= words * (D.WORD_BYTES + 4) + 10_000


# 5: passages


def brute_spans(rows, length):
    places = {}
    units = sorted({(i, t) for i, t in rows if t is not None}, key=str)
    for u, (_, t) in enumerate(units):
        w = plain_words(t)
        for k in range(len(w) - length + 1):
            places.setdefault(tuple(w[k : k + length]), []).append((u, k))
    hit = {}
    for p in places.values():
        if len({u for u, _ in p}) > 1:
            for u, k in p:
                hit.setdefault(u, set()).add(k)
    out = []
    for u, ks in hit.items():
        start = end = None
        for k in sorted(ks):
            if end is None or k > end:
                if end is not None:
                    out.append((units[u][0], start, end))
                start = k
            end = k + length
        out.append((units[u][0], start, end))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [31, 50])
def test_passages_by_brute_force(spark, length):
    r = random.Random(length)
    shared = [prose(900 + i, n, 10**6) for i, n in enumerate((length - 1, length, length + 1, length + 30, 200))]
    rows = []
    for i in range(30):
        t = prose(i, r.randrange(0, 150), 10**6)
        for _ in range(r.randrange(3)):
            t += " " + r.choice(shared) + " " + prose(500 + i, r.randrange(40), 10**6)
        rows.append((i, t))
    rows += [(40, rows[3][1]), (41, None), (42, ""), (None, shared[4]), (43, shared[4] + " " + shared[4]), (44, "z " * 100_000), (3, rows[3][1]), (45, shared[3].upper().replace(" ", ", "))]
    df = table(spark, [(i, t, "en", "s") for i, t in rows])
    assert ids(S.repeated(df, length=length), "uid", "start", "end") == brute_spans(rows, length)


def test_hot_passages_go_to_no_single_key(spark):
    line = prose(3, 60, 10**6)
    rows = [(i, prose(i, 5, 10**6) + " " + line + " " + prose(1000 + i, 5, 10**6)) for i in range(3000)] + [(9000, prose(3, 59, 10**6) + " end"), (9001, line), (9001, line)]
    df = table(spark, [(i, t, "en", "s") for i, t in rows], extra=False).repartition(4)
    assert ids(S.repeated(df), "uid", "start", "end") == brute_spans(rows, S.LENGTH)
    known = S.Known()
    a, b, unit = np.array([5, 5, 7, 9, 9], np.uint64), np.array([1, 1, 1, 2, 3], np.uint64), np.array([0, 1, 2, 3, 4])
    assert [x.tolist() for x in known.settle(a, b, unit)] == [[True, True, False, False, False], [0]]
    # what is known is settled by one unit, and marked once
    assert [x.tolist() for x in known.settle(a[1:3], b[1:3], unit[1:3])] == [[True, False], []]


def test_texts_without_a_shared_anchor_are_not_shuffled(spark, monkeypatch):
    r = random.Random(8)
    long = lambda n: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(n))
    line = long(60)
    rows = [(i, long(2000)) for i in range(40)] + [(50, line + " " + long(20)), (None, long(9) + " " + line), (None, None)]
    df = table(spark, [(i, t, "en", "s") for i, t in rows], extra=False)
    sc = spark.sparkContext
    sc.setJobGroup("passages", "")
    try:
        found = ids(S.repeated(df), "uid", "start", "end")
    finally:
        sc._jsc.clearJobGroup()
    assert found == brute_spans(rows, S.LENGTH)
    stages = {k for j in sc.statusTracker().getJobIdsForGroup("passages") for k in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    written = sum(x.shuffleWriteBytes() for x in map(store.lastStageAttempt, stages) if x.status().toString() == "COMPLETE")
    # anchors and windows are; the texts were, twice
    assert 0 < written < sum(len(t or "") for _, t in rows) / 2
    # a filter that is too small lets more through to the join, and loses nothing
    monkeypatch.setattr(S, "FILTER_BITS", 64)
    units = df.select(F.col("doc_id").alias("uid"), F.lit(5).cast("long").alias("uhash")).where("uid = 50 OR uid IS NULL")
    assert [x[0] for x in S._among(spark.createDataFrame([(4,), (5,), (69,)], "uhash long"), units).collect()] == [5, 69]
    assert ids(S.repeated(df), "uid", "start", "end") == found


def test_passages_odd_tables(spark):
    assert S.repeated(table(spark, [])).count() == 0
    one = prose(1, 80, 10**6)
    assert S.repeated(table(spark, [(1, one + " " + one, "en", "s"), (1, one + " " + one, "en", "s")])).count() == 0
    with pytest.raises(ValueError):
        S.repeated(table(spark, []), length=30)


def test_cover_takes_any_two_places_into_an_anchor():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
