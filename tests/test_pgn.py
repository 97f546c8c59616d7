from datetime import datetime

import pytest

from rookery.operators import columns as C
from rookery.sources import pgn

OPERA = """[Event "Casual"]
[Site "Paris"]
[Date "1858.??.??"]
[White "Morphy \\"Paul\\""]
[Black "Allies"]
[Result "1-0"]
[WhiteElo "2690"]
[BlackElo "?"]

1. e4 {[%eval 0.17] [%clk 0:10:00]} e5 {[%clk 0:09:59]} 2. Nf3 {[%eval #-3]} d6 3. d4 Bg4 4. dxe5 Bxf3 5. Qxf3 dxe5 6. Bc4 Nf6 $1 7. Qb3! Qe7 8. Nc3 c6 9. Bg5 b5
10. Nxb5 cxb5 11. Bxb5+ Nbd7 12. O-O-O Rd8 13. Rxd7 Rxd7 14. Rd1 Qe6 15. Bxd7+ Nxd7 16. Qb8+ Nxb8 17. Rd8# 1-0
"""
OPERA_MOVES = "1. e4 e5 2. Nf3 d6 3. d4 Bg4 4. dxe5 Bxf3 5. Qxf3 dxe5 6. Bc4 Nf6 7. Qb3 Qe7 8. Nc3 c6 9. Bg5 b5 10. Nxb5 cxb5 11. Bxb5+ Nbd7 12. O-O-O Rd8 13. Rxd7 Rxd7 14. Rd1 Qe6 15. Bxd7+ Nxd7 16. Qb8+ Nxb8 17. Rd8#"
VARIED = """[Event "Lines"]
[UTCDate "2020.02.30"]

1. e4 (1. d4 d5 (1... Nf6 2. c4)) (1. c4) e5 2. Nf3 Nc6 ; a remark
*
"""
ODD = """[Event "Ends"]
[FEN "7k/8/8/8/8/8/8/K7 w - - 0 1"]
[SetUp "1"]
[UTCDate "2021.05.06"]
[UTCTime "07:??:09"]

1. Kb1 Kg8 2. Kh8 Kf8 1/2-1/2
"""
BROKEN = """[Event "Broken"]
[FEN "not a position"]

1. e4 *
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import zstandard

    d = tmp_path_factory.mktemp("pgn")
    text = "\n".join([OPERA, VARIED, ODD, BROKEN])
    (d / "a.pgn").write_text(text)
    (d / "b.pgn.zst").write_bytes(zstandard.compress(text.encode()))
    return d


@pytest.mark.parametrize("name", ["a.pgn", "b.pgn.zst"])
def test_import(spark, folder, name):
    df = pgn.read_pgn(spark, str(folder / name)).withColumn("text", C.try_to_pgn("movedata", "fen")).cache()
    rows = {r.event: r for r in df.collect()}
    opera = rows["Casual"]
    assert opera.text == OPERA_MOVES and opera.white == 'Morphy "Paul"' and opera.white_rating == 2690 and opera.black_rating is None and opera.ply_count == 33
    assert opera.utc_timestamp == datetime(1858, 1, 1) and opera.evals == [17, 17, -32766] and opera.clocks_white == [600] and opera.clocks_black == [599] and opera.error is None
    assert rows["Lines"].text == "1. e4 (1. d4 d5 (1... Nf6 2. c4)) (1. c4) 1... e5 2. Nf3 Nc6" and rows["Lines"].utc_timestamp is None
    ends = rows["Ends"]
    assert ends.text == "1. Kb1 Kg8" and ends.ply_count == 2 and ends.error == "illegal move at ply 3" and ends.utc_timestamp == datetime(2021, 5, 6, 7, 0, 9)
    assert rows["Broken"].movedata is None and rows["Broken"].error == "invalid FEN"


def test_plain_and_packed_files_side_by_side(spark, folder):
    both = pgn.read_pgn(spark, str(folder)).groupBy("event").count().collect()
    assert {r.event: r["count"] for r in both} == dict.fromkeys(("Casual", "Lines", "Ends", "Broken"), 2)


@pytest.mark.parametrize("level", [0, 1])
def test_one_game_as_a_column(spark, level):
    df = spark.createDataFrame([(1, OPERA), (2, None), (3, " \n"), (4, VARIED), (5, BROKEN), (6, "1. e4 e5 *"), (7, "no game")], "id int, text string")
    got = {r.id: r for r in df.select("id", pgn.pgn_to_movedata("text", level).alias("m")).select("id", C.compression_level("m").alias("level"), C.try_to_uci("m").alias("uci")).collect()}
    assert got[1].level == level and got[1].uci.startswith("e2e4 e7e5 g1f3") and got[6].uci == "e2e4 e7e5" and got[4].uci.startswith("e2e4 e7e5 g1f3")
    assert got[2].uci is None and got[3].uci is None and got[5].uci is None
    with pytest.raises(ValueError):
        pgn.pgn_to_movedata("text", 2)


def test_options(spark, folder):
    path = str(folder / "a.pgn")
    medium = {r.event: r for r in pgn.read_pgn(spark, path, level=1).select("event", C.compression_level("movedata").alias("level"), C.try_to_pgn("movedata").alias("text")).collect()}
    assert medium["Casual"][1:] == (1, OPERA_MOVES) and medium["Lines"].text == "1. e4 e5 2. Nf3 Nc6"
    assert {r.event for r in pgn.read_pgn(spark, path, min_timestamp=0).collect()} == {"Lines", "Ends", "Broken"}
    with pytest.raises(Exception, match="illegal move|invalid FEN"):
        pgn.read_pgn(spark, path, bad_moves="fail").collect()


def test_round_trip(spark, folder, tmp_path):
    games = pgn.read_pgn(spark, str(folder / "a.pgn")).where("error is null")
    pgn.write_games(games, str(tmp_path / "games"))
    back = spark.read.parquet(str(tmp_path / "games"))
    again = pgn.from_texts(pgn.to_pgn_text(back), "pgn")
    assert sorted(map(tuple, again.select("event", "movedata", "white").collect())) == sorted(map(tuple, games.select("event", "movedata", "white").collect()))


def test_disambiguation_and_odd_moves():
    text = '[Event "x"]\n[FEN "4k3/P7/8/8/8/8/4K3/R6R w - - 0 1"]\n\n1. Rad1 Kf7 2. Rhf1+ Kg6 3. a8=N *'
    (row,) = pgn.parse_games([text])
    assert row[-1] is None and row[15] == 5
    (pinned,) = pgn.parse_games(['[FEN "4k3/8/8/8/4r3/8/4N3/N3K3 w - - 0 1"]\n\n1. Nc2 Kd8 2. Nd4 *'])
    assert pinned[-1] == "illegal move at ply 3" or pinned[15] == 3
    assert pgn.parse_games([""])[0][15] == 0 and pgn.parse_games(["1. zz"])[0][-1].startswith("invalid SAN")
    assert pgn.parse_eval("#0") is None and pgn.parse_eval("-1.25") == -125 and pgn.parse_eval("#2") == 32766
