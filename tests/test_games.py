"""The golden game at both documented levels, through the column functions and through SQL."""

import pytest
from pyspark.sql import functions as F

from rookery.operators import columns as C

LOW = bytes.fromhex("0C1C3424051A392A0615312904073E2D0A123D229A35BC351526353E03112D2391233E3D233500")
MEDIUM = bytes.fromhex("3C5D932E0D543FE2ECDEEF6146529733DB0376")
HIGH = bytes.fromhex("9F2D841C1A9D3ABDB3B8")
BAD_LOW = bytes.fromhex("0C1C3424051A392A0615312940073E2D0A123D229A35BC355126353E03112D2391233E3D233500")
BAD_MEDIUM = bytes.fromhex("3C5D932E0D543FE2CEDEEF6146529734DB0376")
INVALID = b"invalid"
UCI = "e2e4 e7e5 f1c4 b8c6 g1f3 b7b6 e1g1 g8f6 c2c3 f8c5 c4f7 e8f7 f3g5 f7g8 d1b3 f6d5 b3d5 g8f8 d5f7"
PGN = "1. e4 e5 2. Bc4 Nc6 3. Nf3 b6 4. O-O Nf6 5. c3 Bc5 6. Bxf7+ Kxf7 7. Ng5+ Kg8 8. Qb3+ Nd5 9. Qxd5+ Kf8 10. Qf7#"


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame([(1, LOW), (2, MEDIUM), (3, None)], "id int, m binary").cache()


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("id").select(*columns).collect()]


def test_text(games):
    got = values(games, C.to_uci("m"), C.to_pgn("m"), C.moved_pieces("m"), F.array_join(C.moved_pieces_list("m"), ""))
    row = (UCI, PGN, "PpBnNpKnPbBkNkQnQkQ", "PpBnNpKnPbBkNkQnQkQ")
    assert got == [row, row, (None,) * 4]


@pytest.mark.parametrize("pos, fen", [
    (0, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"), (1, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1"), (3, "rnbqkbnr/pppp1ppp/8/4p3/2B1P3/8/PPPP1PPP/RNBQK1NR b KQkq - 1 2"),
    (-2, "r1bq1k1r/p1pp2pp/1pn5/2bQp1N1/4P3/2P5/PP1P1PPP/RNB2RK1 w - - 1 10"), (-19, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1"), (-20, None), (50, None), (-50, None),
])
def test_fen_at_position(games, pos, fen):
    assert values(games, C.fen_at_position("m", pos)) == [(fen,), (fen,), (None,)]


def test_boards_and_pieces(games):
    b3, b2 = C.board_at_position("m", 3), C.board_at_position("m", -2)
    assert values(games, b3["c4"], b2["f8"], b3["e4"], b3["e2"]) == [("B", "k", "P", "")] * 2 + [(None,) * 4]
    p = games.orderBy("id").select(C.pieces_at_position("m", -1).alias("p")).first().p.asDict()
    assert p == {
        "wK": "g1", "wQ": ["f7"], "wR": ["a1", "f1"], "wB": ["c1"], "wN": ["b1", "g5"], "wP": ["a2", "b2", "c3", "d2", "e4", "f2", "g2", "h2"],
        "bK": "f8", "bQ": ["d8"], "bR": ["a8", "h8"], "bB": ["c5", "c8"], "bN": ["c6"], "bP": ["a7", "b6", "c7", "d7", "e5", "g7", "h7"],
    }
    assert values(games, C.piece_counts_at_position("m", -1).alias("c"))[0][0].asDict() == dict(wQ=1, wR=2, wB=1, wN=2, wP=8, bQ=1, bR=2, bB=2, bN=1, bP=7)
    assert values(games.where("id < 3"), C.piece_counts_at_position("m", 50)) == [(None,), (None,)]


def test_move_details(games):
    d = [x.asDict() for x in games.orderBy("id").select(C.move_details_ext("m").alias("d")).first().d]
    assert len(d) == 19 and d[6] == {"ply": 6, "role": "k", "from": "e1", "to": "g1", "promotion": "", "capture": "", "is_castle": True, "is_en_passant": False, "is_check": False, "is_checkmate": False, "is_stalemate": False, "legal_response_move_count": 32}
    assert d[0]["legal_response_move_count"] == 20 and d[18]["is_checkmate"] and d[18]["legal_response_move_count"] == 0 and d[10]["capture"] == "p" and d[10]["is_check"]
    for n in (6, -13):
        assert [r[0].asDict() for r in values(games.where("id < 3"), C.move_details_ext_at("m", n))] == [d[6]] * 2
    plain = values(games, C.move_details_at("m", 6).alias("x"))
    assert plain[0][0].asDict() == {k: v for k, v in d[6].items() if k not in ("is_stalemate", "legal_response_move_count")}
    assert values(games, C.move_details_at("m", 30)) == [(None,)] * 3
    assert [x.asDict() for x in values(games, C.move_details("m").alias("x"))[1][0]] == [{k: v for k, v in y.items() if k not in ("is_stalemate", "legal_response_move_count")} for y in d]


def test_search(games):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"
    assert values(games, C.matches_fen("m", start), C.matches_fen_ply("m", start)) == [(True, 0)] * 2 + [(None, None)]
    assert values(games, C.matches_fen("m", start.replace(" w ", " b ")), C.matches_fen_ply("m", start.replace("KQkq", "Kkq"))) == [(False, None)] * 2 + [(None, None)]
    third = "rnbqkbnr/pppp1ppp/8/4p3/2B1P3/8/PPPP1PPP/RNBQK1NR b KQkq - 1 2"
    assert values(games, C.matches_fen_ply("m", third)) == [(3,), (3,), (None,)]
    sub = "r1bq2kr/p1pp2pp/1pn2n2/2b1p1N1/4P3/1QP5/PP1P1PPP/RNB2RK1"
    assert values(games, C.matches_subfen("m", sub), C.matches_subfen("m", sub.replace("1N1/4P3", "1n1/4P3"))) == [(True, False)] * 2 + [(None, None)]
    # the starting position isn't searched for parts
    assert values(games, C.matches_subfen("m", start.split()[0])) == [(False,), (False,), (None,)]


@pytest.mark.parametrize("pattern, plies", [
    ('{"imbalance":"PNvB"}', True), ('{"imbalance":"PBvN"}', False), ('{"imbalance":"NvB"}', False), ('{"white-move":"O-O"}', [6]), ('{"black-move":"O-O"}', False),
    ('{"moved":"B","captured":"P"}', [10]), ('{"moved":"QN","captured":"P"}', False), ('{"moved":"B","captured":"P","stm":"white"}', True), ('{"moved":"B","captured":"P","stm":"black"}', False),
    ('{"sequence":[{"white-move":"O-O"},{"moved":"B","captured":"P"}]}', [6, 10]), ('{"streak":[{"white-move":"O-O"},{"moved":"B","captured":"P"}]}', False),
    ('{"streak":[{"white-move":"O-O"},{"moved":"N"}]}', [6, 7]), ('{"sequence":[{"streak":[{"white-move":"O-O"},{"moved":"N"}]},{"moved":"B","captured":"P"}]}', [6, 7, 10]),
    ('{"sequence":[{"streak":[{"white-move":"O-O"},{"moved":"P"}]},{"moved":"B","captured":"P"}]}', False),
    ("{}", [0]), ('{"pass":""}', [0]), ('{"captured":""}', False), ('{"white-move":"e4","black-move":"e5"}', False), ('{"stm":null,"moved":"K"}', [6]),
    ('{"white-move":["Nc3","Bxf7"]}', [10]), ('{"white-move":"Bf7"}', False),
])
def test_patterns(games, pattern, plies):
    got = values(games, C.scoutfish_query("m", pattern), C.scoutfish_query_plies("m", pattern))
    assert got[2] == (None, None) and got[0] == got[1] and got[0][0] == bool(plies)
    if plies is not True:
        assert got[0][1] == (plies or [])


def test_streak_stays_armed(spark):
    df = spark.createDataFrame([(1, "e2e4 e7e5 f1c4 b8c6 c4f7".split())], "id int, u array<string>").withColumn("m", C.encode_moves("u"))
    streak = '{"streak":[{"white-move":"e4"},{"moved":"PBN"},{"captured":"P"}]}'
    assert values(df, C.scoutfish_query_plies("m", streak)) == [([2, 3, 4],)]


@pytest.mark.parametrize("pattern", ['{"x":1}', '{"moved":"X"}', '{"material":""}', '{"material":"KQ"}', '{"imbalance":"P"}', '{"imbalance":"KvP"}', '{"stm":"red"}', '{"white-move":"zz"}', '{"sequence":[]}', '{"streak":[]}', '{"moved":"P","moved":"N"}', "[", '{"sub-fen":"8/8"}'])
def test_pattern_errors(pattern):
    from rookery.functions.patterns import PatternError

    with pytest.raises(PatternError):
        C.scoutfish_query("m", pattern)


def test_levels_and_validity(spark, games):
    assert values(games, C.recompress("m", 0), C.recompress("m", 1), C.compression_level("m")) == [(LOW, MEDIUM, 0), (LOW, MEDIUM, 1), (None, None, None)]
    df = spark.createDataFrame(list(enumerate([LOW, MEDIUM, BAD_LOW, BAD_MEDIUM, INVALID, b"", b"\0", b"\xc0", bytes([12, 28, 52, 0]), bytes.fromhex("0C1CFFFE00"), bytes.fromhex("0C1CFFFF0B1B00"), None])), "id int, m binary")
    assert [r[0] for r in values(df, C.is_valid_movedata("m"))] == [True, True, False, False, False, False, True, False, False, False, False, None]
    assert [r[0] is not None for r in values(df, C.try_to_uci("m"))] == [True, True, False, False, False, False, True, False, False, False, False, False]
    assert [r[0] for r in values(df, C.try_fen_at_position("m", 6))][2:4] == [r[0] for r in values(games, C.fen_at_position("m", 6))][:2]
    with pytest.raises(Exception, match="error code 4"):
        values(df.where("id = 2"), C.fen_at_position("m", 7))
    with pytest.raises(Exception, match="error code 1"):
        values(df.where("id = 5"), C.to_uci("m"))
    with pytest.raises(Exception, match="error code 2"):
        values(df.where("id = 7"), C.to_uci("m"))
    assert values(df.where("id = 6"), C.to_uci("m"), C.to_pgn("m"), F.size(C.move_details("m"))) == [("", "", 0)]


def test_high_is_refused_not_misread(spark):
    df = spark.createDataFrame([(1, HIGH)], "id int, m binary")
    assert values(df, C.try_to_uci("m"), C.try_recompress("m", 0), C.compression_level("m")) == [(None, None, 2)]
    with pytest.raises(Exception, match="not supported"):
        values(df, C.is_valid_movedata("m"))


def test_variations(spark):
    e4, e5, d4, c4, d5, nf3 = b"\x0c\x1c", b"\x34\x24", b"\x0b\x1b", b"\x0a\x1a", b"\x33\x23", b"\x06\x15"
    a, z = b"\xff\xff", b"\xff\xfe"
    cases = {
        e4 + a + d4 + z + e5: "1. e4 (1. d4) 1... e5", e4 + a + d4 + a + c4 + z + z + e5 + nf3: "1. e4 (1. d4 (1. c4)) 1... e5 2. Nf3",
        e4 + e5 + a + d5 + z + nf3: "1. e4 e5 (1... d5) 2. Nf3", e4 + a + d4 + z + a + c4 + z + e5: "1. e4 (1. d4) (1. c4) 1... e5", e4 + z: None, a + d4 + z + e4: None,
    }
    df = spark.createDataFrame([(i, k + b"\0") for i, k in enumerate(cases)], "id int, m binary")
    assert [r[0] for r in values(df, C.try_to_pgn("m"))] == list(cases.values())
    assert [r[0] for r in values(df, C.try_to_uci("m"))][:3] == ["e2e4 e7e5", "e2e4 e7e5 g1f3", "e2e4 e7e5 g1f3"]


LINES = {
    "fool": ("f2f3 e7e5 g2g4 d8h4", "1. f3 e5 2. g4 Qh4#"),
    "passant": ("e2e4 a7a6 e4e5 d7d5 e5d6", "1. e4 a6 2. e5 d5 3. exd6"),
    "long": ("d2d4 d7d5 b1c3 b8c6 c1f4 c8f5 d1d2 d8d7 e1c1 e8c8", "1. d4 d5 2. Nc3 Nc6 3. Bf4 Bf5 4. Qd2 Qd7 5. O-O-O O-O-O"),
    "promotion": ("a2a4 b7b5 a4b5 a7a6 b5a6 c8b7 a6b7 d8c8 b7a8q", "1. a4 b5 2. axb5 a6 3. bxa6 Bb7 4. axb7 Qc8 5. bxa8=Q"),
    "stalemate": ("e2e3 a7a5 d1h5 a8a6 h5a5 h7h5 h2h4 a6h6 a5c7 f7f6 c7d7 e8f7 d7b7 d8d3 b7b8 d3h7 b8c8 f7g6 c8e6", None),
}


def test_hand_made_lines(spark):
    df = spark.createDataFrame([(i, k, v[0].split()) for i, (k, v) in enumerate(LINES.items())], "id int, name string, u array<string>").withColumn("m", C.encode_moves("u"))
    assert [r[0] for r in values(df, C.to_uci("m"))] == [v[0] for v in LINES.values()]
    assert [r[0] for r in values(df, C.to_pgn("m"))][:4] == [v[1] for v in list(LINES.values())[:4]]
    last = C.move_details_ext_at("m", -1)
    got = values(df, last["is_en_passant"], last["is_castle"], last["promotion"], last["is_checkmate"], last["is_stalemate"], last["legal_response_move_count"], last["to"])
    assert [g[:5] for g in got] == [(False, False, "", True, False), (True, False, "", False, False), (False, True, "", False, False), (False, False, "q", False, False), (False, False, "", False, True)]
    assert got[0][5] == got[4][5] == 0 and got[2][6] == "c8"
    medium = df.withColumn("m", C.recompress("m", 1))
    assert [r[0] for r in values(medium, C.to_uci("m"))] == [v[0] for v in LINES.values()]


def test_custom_start(spark):
    kings, black = "7k/8/8/8/8/8/8/K7 w - - 0 1", "4k3/4p3/8/8/8/8/4P3/4K3 b - - 0 1"
    df = spark.createDataFrame([(1, kings, "a1b1 h8g8 b1c1".split()), (2, black, "e7e5 e2e4".split()), (3, None, ["e2e4"]), (4, "nonsense", ["e2e4"])], "id int, fen string, u array<string>").withColumn("m", C.encode_moves("u"))
    assert [r[0] for r in values(df, C.try_to_uci("m", "fen"))] == ["a1b1 h8g8 b1c1", "e7e5 e2e4", "e2e4", None]
    assert values(df, C.try_fen_at_position("m", 1, "fen"))[1] == ("4k3/8/8/4p3/8/8/4P3/4K3 w - e6 0 2",)
    # case and numbers go by place, as if White had begun
    assert values(df, C.try_moved_pieces("m", "fen"), C.try_to_pgn("m", "fen"))[1] == ("Pp", "1. e5 e4")
    assert [r[0] for r in values(df, C.is_valid_movedata("m", "fen"), C.try_to_uci("m"))] == [True, True, True, False]
    assert values(df, C.try_matches_fen_ply("m", kings, "fen"), C.try_scoutfish_query("m", '{"material":"KK"}', "fen"))[0] == (0, True)


def test_filters_and_plies_share_one_decode(games):
    df = games.withColumn("p", C.plies("m"))
    got = df.select("id", F.explode("p").alias("p")).where("p.is_castle").select("id", "p.ply", "p.from", F.bit_count("p.wP").alias("pawns"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 6, "e1", 8), (2, 6, "e1", 8)]


def test_with_plies_decodes_once(spark, tmp_path):
    spark.createDataFrame([(1, LOW), (2, MEDIUM)], "id int, m binary").write.parquet(str(tmp_path / "g"))
    df = C.with_plies(spark.read.parquet(str(tmp_path / "g")), "m", where=F.col("id") < 2)
    out = df.where(F.exists("plies", lambda p: p["is_castle"])).select("id", F.size("plies").alias("n"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "LessThan(id,2)" in plan
    assert [tuple(r) for r in out.collect()] == [(1, 20)]


def test_sql(spark, games):
    C.register(spark)
    games.createOrReplaceTempView("games")
    row = spark.sql("""SELECT to_uci(m) u, fen_at_position(m, 3) f, fen_at_position(m, 3, CAST(NULL AS STRING)) f2, try_to_pgn(m) p, scoutfish_query(m, '{"white-move":"O-O"}') s, matches_fen_ply(m, 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -') y FROM games WHERE id = 1""").first()
    assert row.u == UCI and row.f == row.f2 and row.p == PGN and row.s is True and row.y == 0
    assert spark.sql("SELECT eval_to_mate(32766), winning_chances_lichess(-32768) < -0.99, time_control_lichess(60, 3), clocks_to_move_times(array(180,180,178), 1), list_eval_to_mate(array(32767, null, 0))").first()[:] == (2, True, "Blitz", [1, 3], [1, None, None])
