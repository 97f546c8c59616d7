"""Sharding, mixing, web and vector operators, the language model, and the pipeline."""

import base64
import gzip
import hashlib
import io
import itertools
import json
import math
import random
import re
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rookery.llm import mixing as M
from rookery.llm import neighbours as NN
from rookery.llm import perplexity as P
from rookery.llm import sharding as SH
from rookery.llm import urls as U
from rookery.llm import warc as WA
from rookery.llm.frames import ensure_checkpoint_dir
from rookery.llm.queries import ORACLE_SQL, QUERIES

from .test_text_operators import ODD, ids, prose, table

SF = Path("/root/testdata/sf0.001")


# 1: sharding


def brute_capacity(sizes, shards):
    def enough(c):
        n = load = 0
        for s in sizes:
            if s > c:
                return False
            if n == 0 or load + s > c:
                n, load = n + 1, 0
            load += s
        return n <= shards

    return next(c for c in itertools.count(max(sizes, default=0)) if enough(c))


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 0, 1, 3, 7, 20, 150 if seed % 2 else 5]) for _ in range(r.choice([1, 30, 300]))]
    rows = [(k, s) for k, s in enumerate(sizes)]
    shards = r.choice([1, 2, 5, 16])
    df = spark.createDataFrame(rows, "g long, size long").repartition(5)
    out, name = SH.with_shard(df, "g", F.col("size"), shards, detail=4)
    got = sorted((r.g, r[name], r["size"]) for r in out.collect())
    numbers = [n for _, n, _ in got]
    assert numbers == sorted(numbers) and (not numbers or numbers[-1] < shards)
    loads = {}
    for _, n, s in got:
        loads[n] = loads.get(n, 0) + s
    assert max(loads.values()) == brute_capacity(sizes, shards)


def test_shards_odd_tables(spark):
    df = table(spark, ODD)
    out = SH.stage(spark, df, "")
    assert out.columns == df.columns + ["shard_"] and out.count() == len(ODD)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, set()).add(r.shard_)
    assert all(len(s) == 1 for s in by.values()) and by[None] == {0}
    for empty in (table(spark, []), table(spark, [(1, None, None, None), (2, "", None, None)])):
        assert SH.stage(spark, empty, "").select("shard_").distinct().count() <= 1
    text = spark.createDataFrame([("b", 5), ("a", 5), (None, 1), ("c", None)], "g string, n int")
    got, name = SH.with_shard(text, "g", F.col("n"), 2)
    assert {r.g: r[name] for r in got.collect()} == {None: 0, "a": 0, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        SH.with_shard(text, "g", F.col("n"), 0)


@pytest.mark.parametrize("kind", ["long", "string", "date", "timestamp", "decimal(9,2)", "double"])
def test_shards_of_keys_of_any_kind(spark, kind):
    key = {"string": F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")), "date": F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")), "timestamp": F.timestamp_seconds(F.col("id") * 7)}.get(kind, F.col("id").cast(kind))
    df = spark.range(200).select(F.when(F.col("id") != 77, key).alias("g"), (F.col("id") % 9).alias("n"), "id").repartition(4)
    out, name = SH.with_shard(df, "g", F.col("n"), 12)
    order = sorted(out.collect(), key=lambda r: (r.g is not None, r.id))
    numbers = [r[name] for r in order]
    assert numbers == sorted(numbers) and numbers[0] == 0
    loads = {}
    for r in order:
        loads[r[name]] = loads.get(r[name], 0) + r.n
    assert max(loads.values()) == brute_capacity([r.n for r in order], 12)


# 6: mixing


def test_flight_keeps_totals_and_lands():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 50, 400):
        p, t = [r.choice([0.0, 0.3, 0.7, 1.0]) for _ in range(n)], [float(r.choice([0, 5, 5, 9, 100])) for _ in range(n)]
        draws = [r.random() for _ in range(n)]
        q = M.flight(p, t, draws)
        assert sum(0 < x < 1 for x in q) <= 2 and abs(sum(q) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(q, t)) - sum(a * b for a, b in zip(p, t))) < 1e-4
        landed = M.landing(q, draws)
        assert set(landed) <= {0.0, 1.0} and abs(sum(landed) - sum(p)) < 1 + 1e-6


def test_flight_has_no_drift():
    r, n = random.Random(2), 7
    p, t = [0.2, 0.5, 0.9, 0.4, 0.6, 0.3, 0.1], [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    mean = np.mean([M.landing(M.flight(p, t, [r.random() for _ in range(n)]), [r.random() for _ in range(n)]) for _ in range(20000)], axis=0)
    assert np.abs(mean - p).max() < 0.02


@pytest.mark.parametrize("block", [40, 5000])
def test_mix_meets_its_targets(spark, block):
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(1, 60)), "en", r.choice("aaaabbc")) for i in range(900)]
    weights = {"a": 1.0, "b": 1.0, "c": 1.0}
    got = M.sampled(table(spark, rows), weights, block=block).collect()
    assert len(got) == 900
    for s in "abc":
        mine = [x for x in got if x.source == s]
        words, want = sum(x.words for x in mine if x.selected), sum(x.words * x.probability for x in mine)
        assert abs(words - want) <= 120 and abs(sum(x.selected for x in mine) - sum(x.probability for x in mine)) <= 2
    assert abs(sum(x.selected for x in got) - sum(x.probability for x in got)) <= 1 + 1e-6
    per = [sum(x.words * x.probability for x in got if x.source == s) for s in "abc"]
    assert max(per) - min(per) < 1e-6 * max(per) and max(x.probability for x in got) == 1.0


def test_a_tiny_source_does_not_shrink_the_others():
    large = {f"s{i}": 50_000_000 for i in range(20)}
    for stray in ({"t": 100}, {None: 1}, {f"t{i}": 100 for i in range(50)}):
        p = M.probabilities({**large, **stray}, None, M.POWER)
        assert all(p[s] == 1 for s in stray) and min(p[s] for s in large) > 0.99
    skewed = {"a": 1_000_000_000, "b": 1_000_000, "c": 10_000, "d": 0}
    p = M.probabilities(skewed, None, M.POWER)
    # the whole ones have no more than their part; of the others all parts are of one level
    level = p["a"] * skewed["a"] / skewed["a"] ** M.POWER
    assert 0.5 < p["a"] < 1 and all(abs(p[s] - min(1, level * n**M.POWER / n)) < 1e-9 for s, n in skewed.items() if n) and p["d"] == 1
    assert all(x == 1 for x in M.probabilities(large, None, M.POWER).values())


def test_mix_odd_rows(spark):
    df = table(spark, ODD)
    out = M.stage(spark, df, "")
    assert out.columns == df.columns and 0 < out.count() <= len(ODD)
    got = M.sampled(df)
    assert got.count() == len(ODD) - 1 and ids(got, "uid", "selected") == ids(M.sampled(df.repartition(3)), "uid", "selected")
    assert {(r.uid, r.words) for r in got.collect()} >= {(1, 0), (2, 0), (8, 300_000)}
    assert M.sampled(table(spark, [])).count() == 0 and M.stage(spark, table(spark, []), "").count() == 0
    clash = df
    for c in ("probability", "selected", "words", "block", "blocks", "h", "p", "b_source", "all"):
        clash = clash.withColumn(c, F.lit(c))
    assert ids(M.sampled(clash), "uid", "selected") == ids(got, "uid", "selected") and M.stage(spark, clash, "").columns == clash.columns
    none = M.sampled(df, {"t": 1.0})
    assert {r.uid for r in none.where("selected").collect()} == {9}


# 3: WARC


def test_warc_links_and_digests(spark, tmp_path):
    html = '<html><head><title>A &amp; B</title><script>var x="<p>no</p>";</script></head><body><!-- gone --><p>One&nbsp;two</p><div>x &lt;y&gt;<br>z</div><a class="k" href="/l1">l</a><a href="/l2">m</a></body></html>'
    pages = spark.createDataFrame([(1, "http://x.test/", html), (2, None, None), (None, "http://y.test/é", "plain é"), (1, "http://x.test/", html), (3, "u", "<p>" * 100_000 + "deep")], "page_id long, url string, html string").withColumn("record_id", F.lit(9)).withColumn("content", F.lit("c"))
    got = WA.derivatives(WA.responses(pages)).collect()
    assert len(got) == 10
    source = {(r.source_id, r.target_uri): r for r in WA.responses(pages).collect()}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in got:
        s = source[r.source_id, r.target_uri]
        assert r.refers_to == s.record_id and r.source_headers == s.http_headers and r.source_digest == s.payload_digest == sha(s.payload.encode())
        assert r.block_digest == sha(r.content.encode()) and r.content_length == len(r.content.encode()) and r.record_id != r.refers_to
    text = {r.source_id: r.content for r in got if r.warc_type == "conversion"}
    assert text["1"] == "A & B\nOne two\nx <y>\nz\nlm" and text["2"] == "" and text[None] == "plain é" and text["3"] == "deep"
    meta = {r.source_id: json.loads(r.content) for r in got if r.warc_type == "metadata"}
    assert meta["1"]["Title"] == "A & B" and meta["1"]["Links"] == ["/l1", "/l2"] and meta["2"]["Title"] is None and meta["2"]["Links"] == []
    assert WA.derivatives(WA.responses(pages.limit(0))).count() == 0


def test_all_references_are_decoded_once(spark):
    html = "<title>caf&eacute; &#8217;</title><p>&copy;&nbsp;2024 &middot; a&#x2014;b &#xE9;&#160;&hearts; &amp;lt; &amp;copy; AT&T &nosuch; &CounterClockwiseContourIntegral; &lt;b&gt;</p>"
    got = {r.warc_type: r.content for r in WA.derivatives(WA.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).collect()}
    assert json.loads(got["metadata"])["Title"] == "café ’"
    assert got["conversion"] == "café ’\n© 2024 · a—b é ♥ &lt; &copy; AT&T &nosuch; ∳ <b>"
    pages = QUERIES["op3_warc"](spark, str(SF)).where("warc_type = 'conversion'")
    assert pages.where("content rlike '&(copy|middot);'").count() == 0 < pages.where("content like '%©%·%'").count()


def test_references_are_all_that_differs_from_the_sql(spark, tmp_path, monkeypatch):
    import duckdb
    import pyarrow.parquet as pq

    def seven(x):
        for name, to in WA._ENTITIES:
            x = F.replace(x, F.lit(name), F.lit(to))
        return x

    monkeypatch.setattr(WA, "_decoded", seven)
    odd = [f"<title>t {c}</title><p>a {c}</p><p> b {c}" for c in "\u2028\u2029\x85\x0b\xa0\r\x01\t\U0001f600"] + [None, "", "a < b > c <p", "<script>a</style>b</script>c", "&amp;lt; &copy;", '<A\nHREF="">e</a>\n']
    (tmp_path / "odd").mkdir()
    pq.write_table(pa.table({"page_id": pa.array([None, *range(1, len(odd))], pa.int64()), "url": ["u", None, *["http://é/\"\\"] * (len(odd) - 2)], "html": odd}), tmp_path / "odd/pages.parquet")
    for at in (SF, tmp_path / "odd"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet'")
        want = con.sql(WA.SQL)
        assert sorted(tuple(map(str, r)) for r in WA.op3_warc(spark, str(at)).select(want.columns).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_warc_round_trip(spark, tmp_path):
    body = "<title>é</title>hällo".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a.test/\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: %d\r\n\r\n" % len(http + body)
    other = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(other) + gzip.compress(head + http + body + b"\r\n\r\n"))
    (tmp_path / "b.warc").write_bytes(other + head + http + body + b"\r\n\r\n")
    read = WA.read_responses(spark, str(tmp_path))
    assert {tuple(r)[1:] for r in read.collect()} == {("<urn:uuid:1>", "http://a.test/", "2020-01-02T03:04:05Z", http.decode(), body.decode(), "sha1:X")}
    made = WA.derivatives(read)
    for blob, r in zip([bytes(x.warc) for x in WA.to_warc(made).collect()], made.collect()):
        ((h, block),) = WA.parse_records(blob)
        assert h["warc-refers-to"] == "<urn:uuid:1>" and h["warc-date"] == "2020-01-02T03:04:05Z" and block.decode() == r.content and h["warc-block-digest"] == r.block_digest


def test_warc_reader_survives_damage(spark, tmp_path):
    def record(i, http, body, kind="response", length=None):
        block = http + body
        return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <%d>\r\nWARC-IP-Address: 1.2.3.4\r\nWARC-Truncated: length\r\nContent-Length: %s\r\n\r\n" % (kind.encode(), i, str(len(block)).encode() if length is None else length) + block + b"\r\n\r\n"

    plain = b"HTTP/1.1 200 OK\r\n\r\n"
    zipped = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: deflate\r\n\r\n"
    flat = zlib.compress(b"deflated " * 50)
    chunks = b"%x;x=y\r\n" % 10 + flat[:10] + b"\r\n%X\r\n" % len(flat[10:]) + flat[10:] + b"\r\n0\r\n\r\n"
    good = [record(1, plain, b"one"), record(2, zipped, gzip.compress("zwei ä".encode("latin-1"))), record(3, chunked, chunks), record(4, b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\n", b"?"), record(5, plain, b"big " * 700_000)]
    want = {"<1>": "one", "<2>": "zwei ä", "<3>": "deflated " * 50, "<4>": "", "<5>": "big " * 700_000}
    cases = {
        "whole.warc": (b"".join(good), want, {"encoding br"}),
        "number.warc": (good[0] + record(7, plain, b"x", length=b"many") + good[1], {k: want[k] for k in ("<1>", "<2>")}, {"length that is no number", "bytes between records"}),
        "header.warc": (good[0] + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Le", {"<1>": "one"}, {"header without an end", "bytes between records"}),
        "cut.warc": (good[0] + record(8, plain, b"longer", length=b"99999"), {"<1>": "one"}, {"cut block", "bytes between records"}),
        "cut.warc.gz": (gzip.compress(good[0]) + gzip.compress(good[1])[:-20], {"<1>": "one"}, {"cut gzip", "cut block", "header without an end", "bytes between records"}),
        "damaged.warc.gz": (gzip.compress(good[0]) + gzip.compress(good[1])[:60] + b"\xff" * 40 + gzip.compress(good[2]) + gzip.compress(good[4]), {k: want[k] for k in ("<1>", "<3>", "<5>")}, {"damaged gzip", "cut block", "header without an end", "bytes between records"}),
        "noise.warc": (b"no archive at all", {}, {"bytes between records"}),
        "empty.warc": (b"", {}, set()),
    }
    for name, (data, _, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    got, faults = {}, {}
    for r in WA.read_responses(spark, str(tmp_path), all_headers=True).collect():
        got.setdefault(r.source_id.rpartition("/")[2], {})[r.record_id] = r.payload
        assert r.warc_headers["warc-ip-address"] == "1.2.3.4" and r.warc_headers["warc-truncated"] == "length" and r.payload_digest.startswith("sha1:")
    for r in WA.malformed(spark, str(tmp_path)).collect():
        faults.setdefault(r.source_id.rpartition("/")[2], set()).add(r.fault)
    for name, (_, records, allowed) in cases.items():
        assert got.get(name, {}) == records and faults.get(name, set()) <= allowed and bool(allowed) == bool(faults.get(name)), name
    meta = WA.derivatives(WA.read_responses(spark, str(tmp_path / "whole.warc"), all_headers=True).where("record_id = '<1>'")).where("warc_type = 'metadata'").first()
    assert json.loads(meta.content)["WARC-Headers"]["warc-truncated"] == "length"
    # at any size of the reads the same records
    for size in (1, 7, 64):
        source = io.BytesIO(gzip.compress(good[0]) + gzip.compress(good[1]) + gzip.compress(good[2]))
        slow = SimpleNamespace(read=lambda n, source=source, size=size: source.read(min(n, size)))
        assert [h["warc-record-id"] for h, _ in WA.parse_records(slow)] == ["<1>", "<2>", "<3>"]


# 7: URLs


def test_rules_by_brute_force(spark):
    r = random.Random(4)
    hosts, paths = ["example.com", "m.a.example.com", "www.b.example.net", "example.org"], ["/en/7", "/de/5?page=2&ref=x", "/fr/8?page=2#top", "/login", "", "/Tag/a/feed"]
    rows = [(i, r.choice(["http://", "https://"]) + r.choice(hosts) + r.choice(paths)) for i in range(200)] + [(900, None), (901, ""), (902, "no url"), (1, "http://example.com/en/7"), (903, "http://example.com/" + "a/" * 50_000 + "login")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("r")).withColumn("token", F.lit("t"))
    rules = [*U.RULES, "", "/login", "*", "|"]
    want = []
    for i, u in rows:
        hit = sorted({x for x in U.RULES if u is not None and re.search(U.compile_rule(x)[0], u.lower())})
        want.append((i, u, " ".join(hit), bool(hit) and not any(x.startswith("@@") for x in hit)))
    assert ids(U.filtered(pages, rules), "page_id", "url", "rules", "blocked") == sorted(want, key=str)
    assert U.filtered(pages.limit(0)).count() == 0


def test_rule_syntax():
    match = lambda rule, url: bool(re.search(U.compile_rule(rule)[0], url))
    assert match("||example.com^", "http://a.example.com/x") and match("||example.com^", "https://example.com") and not match("||example.com^", "http://notexample.com/")
    assert match("|http://x", "http://x.y") and not match("|x", "http://x") and match("end|", "the end") and not match("end|", "ended") and match("a*b", "a-z-b") and match("a.b", "a.b") and not match("a.b", "axb")
    assert U.compile_rule("||ads.example.com^*/banner/img*")[1] == ["ads", "banner", "com", "example"]


# 10: neighbours


def test_neighbours_recall_and_odd_rows(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((600, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 20), (1003, [1.0] * 7), (1004, [float("nan")] * 20), (1005, [None] + [1.0] * 19), (None, [1.0] * 20), (5, x[5].tolist()), (1006, (x[0] * 1e30).tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("neighbour", F.lit(3))
    got = NN.nearest(df, k=5).collect()
    e = np.vstack([x, x[0] * 1e30 / np.float32(1e30)])
    names = [*range(600), 1006]
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    near = {}
    for g in got:
        near.setdefault(g.vec_id, set()).add(g.neighbour)
        assert abs(g.similarity - s[names.index(g.vec_id), names.index(g.neighbour)]) < 1e-4
    assert set(near) == set(names) and all(len(v) == 5 for v in near.values()) and 1006 in near[0]
    assert np.mean([len(near[n] & {names[j] for j in np.argsort(-s[i])[:5]}) / 5 for i, n in enumerate(names)]) >= 0.9
    assert NN.nearest(df.limit(0)).count() == 0 and NN.nearest(df.where("vec_id < 2"), k=5).count() == 2 and NN.nearest(df.where("vec_id = 3")).count() == 0


def test_query_is_an_exact_search(spark, tmp_path, monkeypatch):
    import duckdb
    import pyarrow.parquet as pq

    monkeypatch.setattr(NN, "true_pairs", None)  # nothing is measured on a sample
    r = np.random.default_rng(6)
    x = r.standard_normal((900, 12)).astype(np.float32)
    x[100:160] = x[0]  # more ties than neighbours
    x[200], x[201] = x[50] * np.float32(1e30), -x[50]
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(1800) - 300, x)] + [(50 * i, x[i].tolist()) for i in range(100, 104)]
    rows += [(7000, None), (7050, []), (7100, [0.0] * 12), (7150, [math.nan] * 12), (7200, [None] + [1.0] * 11), (None, [1.0] * 12), (7250, [math.inf] * 12), (8000, [1.0, 2.0]), (8050, [2.0, 1.0]), (8051, [0.0, -3.0]), (9000, [1.0] * 3)]
    pq.write_table(pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32())), "label": pa.array([0] * len(rows))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted(con.sql(NN.SQL).fetchall())
    assert len({i for i, _, _ in want}) > 15 and all(i % 50 == 0 for i, _, _ in want) and {j for i, j, _ in want if i == 8000} == {8050, 8051}
    for rows_, tile in ((NN.HELD_ROWS, NN.TILE), (100, 30), (1, 5)):
        monkeypatch.setattr(NN, "HELD_ROWS", rows_)
        monkeypatch.setattr(NN, "TILE", tile)
        assert sorted(map(tuple, NN.op10_neighbours(spark, str(tmp_path)).collect())) == want
    df = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert NN.search(df.limit(0)).count() == NN.search(df.where("vec_id % 50 > 0")).count() == NN.search(df.where("vec_id = 9000")).count() == 0


def test_neighbours_ties_and_dimensions(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40, 0, -1)] + [(100 + i, [float(i == j) for j in range(300)]) for i in range(3)] + [(200, [0.0] * 299 + [2.0])]
    got = {}
    for g in NN.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), k=4).orderBy("vec_id", F.desc("similarity"), "neighbour").collect():
        got.setdefault(g.vec_id, []).append(g.neighbour)
    # of many equal ones those with the least ids
    assert got[30] == [1, 2, 3, 4] and got[2] == [1, 3, 4, 5]
    # vectors of another dimension are searched among themselves
    assert got[100] == [101, 102, 200] and set(got) == {*range(1, 41), 100, 101, 102, 200}


def test_groups_of_cells_and_parts_agree(spark, monkeypatch):
    r = np.random.default_rng(8)
    middle = r.standard_normal((40, 24))
    x = middle[r.integers(0, 40, 2000)] + 0.4 * r.standard_normal((2000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q = np.repeat(u[:50], 10, axis=0)
    near = u[np.argsort(-(u[:50] @ u.T), axis=1)[:, 1:11].ravel()]
    # near neighbours need fewer probes than those of random vectors, and a larger table finer cells
    tables, functions, count = NN.choice(q, near, 2000, 16)
    assert NN.choice(q, near, 10**9, 16)[1] > functions and (NN.ranks(q, near, tables, functions).min(axis=0) <= count).mean() >= NN.RECALL
    for chosen in ((3, 1, 4), (2, 2, 5)):
        monkeypatch.setattr(NN, "choice", lambda *a, chosen=chosen: chosen)
        want = None
        for group, task in ((25_000, 250_000), (100, 250_000), (20, 10)):
            monkeypatch.setattr(NN, "GROUP_ROWS", group)
            monkeypatch.setattr(NN, "TASK_ROWS", task)
            found = {(g.vec_id, g.neighbour): g.similarity for g in NN.nearest(df).collect()}
            assert want is None or found == want
            want = found


def test_recall_with_finer_cells(spark, monkeypatch):
    monkeypatch.setattr(NN, "CELL_ROWS", 40)
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    near = {}
    for g in NN.nearest(df).collect():
        near.setdefault(g.vec_id, set()).add(g.neighbour)
    assert np.mean([len(near[i] & set(np.argsort(-s[i])[:10].tolist())) / 10 for i in range(3000)]) >= 0.9


def test_recall_is_kept_at_64_dimensions_in_any_cells(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, axis=1)[:, :10]
    for rows in (NN.CELL_ROWS, 10):
        monkeypatch.setattr(NN, "CELL_ROWS", rows)
        near = {}
        for g in NN.nearest(df).collect():
            near.setdefault(g.vec_id, set()).add(g.neighbour)
        assert np.mean([len(near[i] & set(true[i].tolist())) / 10 for i in range(1500)]) >= 0.96
    q, n = np.repeat(u[:200], 10, axis=0), u[true[:200].ravel()]
    need = NN.needed(q, n, 1, 2)
    for c in (3, 12):
        probed = NN.probes(q, 0, 2, c) == NN.probes(n, 0, 2, 1)
        assert (probed.any(axis=1) == (need <= c)).all()


def test_rotations_keep_lengths_and_finer_cells_agree():
    x = np.random.default_rng(1).standard_normal((50, 48)).astype(np.float32)
    assert np.allclose(np.linalg.norm(NN.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)
    h = NN.hadamard(np.eye(8, dtype=np.float32))
    assert np.allclose(h @ h.T, np.eye(8), atol=1e-6)
    for functions in (1, 2):
        p = NN.probes(x, 0, functions, 6)
        assert p.shape == (50, 6**functions) and all(len(set(row)) == 6**functions for row in p.tolist()) and (p[:, 0] == NN.probes(x, 0, functions, 1)[:, 0]).all()
    for f in range(2):
        y = NN.rotate(x, f)
        assert (NN.probes(x, 0, 2, 1)[:, 0] // (128 if f == 0 else 1) % 128 == np.argmax(np.concatenate([y, -y], axis=1), axis=1)).all()


# 9: language model


def test_gradients_are_right():
    m = P.start(classes=8, embedded=30, d=8, hidden=8, window=9)
    r = np.random.default_rng(0)
    rows, kinds, real = r.integers(0, 31, (3, 9)).astype(np.int32), r.integers(0, 8, (3, 9)), np.ones((3, 9), bool)
    real[1, 5:] = False
    g, _ = P.gradients(m, rows, kinds, real)
    for k in m:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, loss = m[k][i], []
        for h in (0.01, -0.01):
            m[k][i] = old + h
            loss.append(P.gradients(m, rows, kinds, real)[1])
        m[k][i] = old
        assert abs((loss[0] - loss[1]) / 0.02 - g[k][i]) < 0.05 * abs(g[k][i]) + 1e-3


def test_numbers_that_cannot_overflow_are_not_cut():
    x = np.array([[90.0, -3.0], [100.0, 2.0]], np.float32)
    assert np.isfinite(P._exp(x.copy())).all() and np.isfinite(P._exp(x.copy(), 100.0)).all() and np.isfinite(P._exp(x.copy(), np.nan)).all()
    low = x - np.float32(50)
    assert (P._exp(low.copy(), 50.0) == P._exp(low.copy())).all()
    # the bound holds for any rows, and scores stay finite beyond it
    r = np.random.default_rng(3)
    a, b = (r.standard_normal((40, 16)).astype(np.float32) * 9 for _ in range(2))
    assert (a @ b.T).max() <= P._longest(a) * P._longest(b) and P._longest(a[:0]) == 0
    counts = np.zeros(300, np.int64)
    counts[:200] = np.arange(200, 0, -1)
    v = P.Vocabulary(counts, classes=4)
    m = P.cut(P.start(4), v)
    m["i"] += r.standard_normal(m["i"].shape).astype(np.float32) * 100
    m["u"] *= 100
    ids = r.integers(0, 200, 90).astype(np.int32)
    assert np.isfinite(P.score(m, v, ids, np.array([0, 70, 90]))).all()


def test_each_id_is_scored_once_under_a_causal_mask():
    ids_ = np.random.default_rng(0).integers(0, 200, 150).astype(np.int32)
    first = np.array([0, 0, 1, 33, 150])
    v, m = P.Vocabulary(np.bincount(ids_, minlength=200), 64, 8), P.start(classes=8, embedded=64)
    got = P.score(m, v, ids_, first)
    for t, (a, b) in enumerate(zip(first, first[1:])):
        want = 0.0
        for i in range(a, b):
            k = i - a
            start = 0 if k < P.WINDOW else P.STRIDE * (-(-(k + 1 - P.WINDOW) // P.STRIDE))
            rows = np.array([[64, *v.row[ids_[a + start : i]]]], np.int32)
            logits = P.forward(m, rows)[-1].astype(np.float64)
            want += logits[v.kind[ids_[i]]] - math.log(np.exp(logits).sum()) + v.share[ids_[i]]
        assert abs(got[t] - want) < 1e-3 * max(1, abs(want))
    total = sum(math.exp(v.share[i]) for i in range(200))
    assert abs(total - 8) < 1e-3


def test_places_scored_before_are_not_computed_again(monkeypatch):
    r = np.random.default_rng(9)
    v = P.Vocabulary(np.bincount(r.integers(0, 50, 400), minlength=60), 60, 6)
    m = P.start(classes=6, embedded=v.rows)
    ids_, first = r.integers(0, 50, 2000).astype(np.int32), np.array([0, 1700, 1700, 1720, 1760, 2000])
    rows = r.integers(0, v.rows, (5, P.WINDOW))
    z = P.hidden(m, rows)[-1].reshape(5, P.WINDOW, -1)
    assert np.allclose(P.hidden(m, rows, 8)[-1], z[:, 8:].reshape(-1, z.shape[2]), atol=1e-5)
    places = []
    monkeypatch.setattr(P, "CHUNK", 4)
    monkeypatch.setattr(P, "hidden", lambda *a, own=P.hidden: places.append(own(*a)) or places[-1])
    got = P.score(m, v, ids_, first)
    # few more than are scored: those of the chunk in which first and later windows meet, and padding
    assert len(ids_) <= sum(len(x[-1]) for x in places) < len(ids_) * 1.25
    assert np.allclose(P.score(m, v, ids_, first, batch=1), got, rtol=1e-5)


def test_encoder_is_lossless_and_remembers():
    e = P.tokenizer(P.VOCABULARY)
    texts = ["Hello  wörld\n\n x 12ab!!", "", None, " lead and trail ", "日本語 text", "a" * 5000, "Hello  wörld\n\n x 12ab!!"]
    got, first = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert b"".join(e.own.decode_single_token_bytes(int(x)) for x in got[first[i] : first[i + 1]]) == (t or "").encode()
    assert (got[first[0] : first[1]] == got[first[6] : first[7]]).all()


def test_model_learns_and_odd_rows(spark):
    r = random.Random(6)
    regular = [(i, " ".join(["one two three four five six seven"] * r.randrange(5, 30)), "en", "s") for i in range(150)]
    df = table(spark, regular + [(900, None, "en", "s"), (901, "", "en", "s"), (902, "zebra quickly " * 20_000, "en", "s"), (902, "zebra quickly " * 20_000, "en", "s"), (903, "seven five two six one four three " * 8, "en", "s")])
    m, v = P.fit(df, every=1, trainer_windows=64)
    got = {}
    for x in P.scores(df, m, v).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert len(got[902]) == 2 and got[900][0].nll is None and got[901][0].tokens == 0 and got[902][0].tokens > 40_000
    assert got[0][0].nll < got[903][0].nll and abs(math.exp(got[0][0].nll) - got[0][0].perplexity) < 1e-6
    m0, v0 = P.fit(table(spark, []))
    assert P.scores(table(spark, []), m0, v0).count() == 0


@pytest.mark.parametrize("n", [1, 6])
def test_every_window_trains(spark, monkeypatch, n):
    seen = []
    monkeypatch.setattr(P, "pack", lambda m, own=P.pack: seen.append(m) or own(m))
    m, _ = P.fit(table(spark, [(i, f"word number {i} of a small corpus", "en", "s") for i in range(n)]))
    begin = P.start()
    assert any((m[k] != begin[k]).any() for k in m) and len(seen) == P.ROUNDS
    # copies under many ids are dealt to several trainers
    copies = table(spark, [(i, "the very same words in each of the documents", "en", "s") for i in range(64)])
    one, _ = P.fit(copies, trainer_windows=1000)
    many, _ = P.fit(copies, trainer_windows=4)
    assert any((one[k] != many[k]).any() for k in one)


def test_model_beats_counts_on_held_out_text(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet")).limit(200)
    m, v = P.fit(docs.where("doc_id % 4 > 0"), every=2, trainer_windows=2048)
    held = docs.where("doc_id % 4 = 0").toPandas().text
    ids_, first = P.encode(pa.array(held), P.VOCABULARY)
    mass = np.bincount(v.kind, weights=np.exp(v.share.astype(float)), minlength=P.CLASSES)
    plain = sum(v.share[ids_]) - len(ids_) * math.log(P.CLASSES)  # all classes alike
    assert mass.max() < 1.001 and P.score(m, v, ids_, first).sum() > plain + 0.3 * len(ids_)


def test_gradients_within_classes_are_right():
    r = np.random.default_rng(3)
    ids_ = r.integers(0, 40, (4, 9))
    v = P.Vocabulary(np.where(np.arange(60) < 40, np.arange(60) % 7 + 1, 0), 60, 5)
    m = P.start(classes=5, embedded=v.rows, d=8, hidden=8, window=9)
    m["i"] = (r.standard_normal(m["i"].shape) * 0.5).astype(np.float32)
    ids_[0, :3] = [45, 59, 41]  # ids that don't occur
    rows, real = P._inputs(v, ids_, np.ones((4, 9), bool), v.rows), np.ones((4, 9), bool)
    real[2, 6:] = False
    g, _ = P.gradients(m, rows, v.kind[ids_], real, v, ids_)
    for k in m:
        for i in [np.unravel_index(j, g[k].shape) for j in np.argsort(-np.abs(g[k]), axis=None)[:3]]:
            old, loss = m[k][i], []
            for h in (0.005, -0.005):
                m[k][i] = old + h
                loss.append(P.gradients(m, rows, v.kind[ids_], real, v, ids_)[1])
            m[k][i] = old
            assert abs((loss[0] - loss[1]) / 0.01 - g[k][i]) < 0.1 * abs(g[k][i]) + 1e-3


@pytest.mark.parametrize("counts, embedded", [(np.arange(400, 0, -1), 500), (np.array([9000, 300, 20, 9, 5, 3, 2, 1]), 500), (np.arange(90, 0, -1), 50)])
def test_training_and_scores_agree_with_a_plain_version(counts, embedded):
    # classes of one row, and of rows that several classes share, are among them
    r = np.random.default_rng(11)
    v = P.Vocabulary(np.append(counts, np.zeros(20, np.int64)), embedded, 6)
    m = P.cut(P.start(6), v)
    m |= {"i": r.standard_normal(m["i"].shape).astype(np.float32), "c": (r.standard_normal(6) * 3 - 40).astype(np.float32)}
    ids_, real = r.integers(0, len(counts) + 20, (70, P.WINDOW)).astype(np.int32), np.ones((70, P.WINDOW), bool)
    real[3, 9:] = False
    rows, kinds, w = P._inputs(v, ids_, real, len(m["e"]) - 1), v.kind[ids_], real.ravel() / real.sum()
    g, loss = P.gradients(m, rows, kinds, real, v, ids_)
    z, kinds, at = P.hidden(m, rows)[-1].astype(np.float64), kinds.ravel(), np.arange(ids_.size)
    p = np.exp(z @ m["u"] + m["c"])
    p /= p.sum(axis=1, keepdims=True)
    log, du, di, dz = np.log(p[at, kinds]), p.copy(), np.zeros(m["i"].shape), np.zeros_like(z)
    du[at, kinds] -= 1
    du *= w[:, None]
    for x, (kind, row) in enumerate(zip(kinds, v.row[ids_.ravel()])):
        own = slice(v.low[kind], v.high[kind])
        q = np.exp(m["i"][own] @ z[x] + v.mass[kind])
        q /= q.sum()
        log[x] += np.log(q[row - v.low[kind]]) - v.mass[kind][row - v.low[kind]] + v.share[ids_.ravel()[x]]
        q[row - v.low[kind]] -= 1
        di[own] += w[x] * q[:, None] * z[x]
        dz[x] = w[x] * q @ m["i"][own]
    assert abs(loss + (log * w).sum()) < 1e-3
    got, want = P.inside(m, v, z.astype(np.float32), ids_.ravel(), w.astype(np.float32), {"i": np.zeros_like(m["i"])}, inner := np.zeros(z.shape, np.float32)), dz
    assert np.isfinite(got).all() and np.allclose(inner, want, atol=1e-6)
    for key, right in {"i": di, "u": z.T @ du, "c": du.sum(axis=0)}.items():
        assert np.allclose(g[key], right, atol=1e-5 + 1e-3 * np.abs(right).max()), key
    flat = ids_[real]
    first = np.append(0, np.cumsum(real.sum(axis=1)))
    assert np.allclose(P.score(m, v, flat, first), np.where(real, log.reshape(real.shape), 0).sum(axis=1), rtol=1e-4)


def test_few_steps_go_class_by_class():
    import sys

    r = np.random.default_rng(5)
    v = P.Vocabulary(np.arange(900, 0, -1), classes=90)
    m = P.cut(P.start(90), v)
    ids_ = r.permutation(np.repeat(np.arange(900), 3)).astype(np.int32)
    z, lines = r.standard_normal((len(ids_), P.WIDTH)).astype(np.float32), [0]

    def tracer(frame, event, arg):
        if frame.f_code is not P.inside.__code__:
            return None
        lines[0] += event == "line"
        return tracer

    before = sys.gettrace()
    sys.settrace(tracer)
    try:
        P.inside(m, v, z, ids_, np.ones(len(ids_), np.float32), {"i": np.zeros_like(m["i"])}, np.zeros_like(z))
    finally:
        sys.settrace(before)
    assert lines[0] < 90 * 10


def test_sums_by_blocks():
    r = np.random.default_rng(6)
    for n in (0, 1, P.SUMMED, 3 * P.SUMMED + 7):
        x, y = r.standard_normal((n, 5)).astype(np.float32), r.standard_normal((n, 8)).astype(np.float32)
        assert np.allclose(P._summed(x, y), x.astype(np.float64).T @ y, atol=1e-3)


def test_probabilities_of_all_ids_sum_to_one():
    r = np.random.default_rng(4)
    v = P.Vocabulary(np.where(np.arange(90) < 70, r.integers(1, 30, 90), 0), 50, 6)
    m = P.start(classes=6, embedded=50)
    m["i"] = r.standard_normal(m["i"].shape).astype(np.float32)
    context = r.integers(0, 90, 5).astype(np.int32)
    total = 0.0
    for x in range(90):
        both = P.score(m, v, np.append(context, x).astype(np.int32), np.array([0, 6])) - P.score(m, v, context, np.array([0, 5]))
        total += math.exp(both[0])
    assert abs(total - 1) < 1e-3


def test_model_beats_a_bigram_on_held_out_text(spark):
    docs = spark.read.parquet(str(SF.parent / "sf0.01/documents.parquet"))
    m, v = P.fit(docs.where("doc_id % 5 > 0"))
    parts = [P.encode(pa.array(docs.where(f"doc_id % 5 {op} 0").toPandas().text), P.VOCABULARY) for op in (">", "=")]
    size = len(v.row)
    pairs = [np.stack([np.where(np.isin(np.arange(len(x)), first), size, np.append(size, x[:-1])), x]) for x, first in parts]
    seen, seen_pairs = np.bincount(parts[0][0], minlength=size), {}
    for a, b in pairs[0].T.tolist():
        seen_pairs[a, b] = seen_pairs.get((a, b), 0) + 1
    after, kinds = np.bincount(pairs[0][0], minlength=size + 1), np.bincount([a for a, _ in seen_pairs], minlength=size + 1)
    a, b = pairs[1]
    both = np.array([seen_pairs.get(x, 0) for x in zip(a.tolist(), b.tolist())])
    plain = (seen[b] + 1) / (seen.sum() + size)
    bigram = np.log((both + kinds[a] * plain + 1e-9) / (after[a] + kinds[a] + 1e-9 / plain)).mean()
    mine = P.score(m, v, *parts[1]).sum() / len(parts[1][0])
    assert mine > bigram > np.log(plain).mean() + 1


# all


def test_checkpoints_follow_the_session(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents pages benchmark embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert sorted([tuple(map(str, r)) for r in df.select(columns).collect()]) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as CP

    assert [n for n, _ in CP.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    for name, stage in CP.STAGES[:-1]:
        assert stage(spark, docs, str(SF)).columns == docs.columns
    out = CP.run(spark, str(SF))
    assert out.columns == docs.columns + ["shard"] and 0 < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
    empty = docs.limit(0)
    for _, stage in CP.STAGES:
        assert stage(spark, empty, str(SF)).count() == 0
