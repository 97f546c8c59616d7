"""Games that start elsewhere: studies with promotions to lesser men, stalemate, en passant and castling by either side, and their SQL.

An order has some first plies of a study. The SQL replays the bytes on lists of letters from the study's own board;
checks are read off the move text, and the numbers of replies come from a move generator that shares nothing with the decoder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import columns as C

from .book import REPLAY, SQL_FEN_BOARD, spread

#: FEN, moves in text, in bytes, and the legal replies to each.
STUDIES = [
    ("8/P6k/8/8/8/8/6K1/8 w - - 0 1", "a8=N Kg7 Nb6 Kf6", "70F837363829362D", (5, 10, 8, 14)),
    ("r3k2r/8/8/8/8/8/8/R3K2R b KQkq - 3 10", "O-O O-O-O Ra1+ Kb2 Rxd1 Rxd1", "3C3F04003800020900030703", (23, 24, 3, 24, 16, 16)),
    ("7k/8/5KQ1/8/8/8/8/8 w - - 0 1", "Kf7", "2D35", (0,)),
    ("4k3/8/8/8/4p3/8/3P4/4K3 w - - 0 1", "d4 exd3 Kd2", "0B1B1C13040B", (7, 4, 5)),
    ("1n2k3/P7/8/8/8/8/p7/1N2K3 w - - 0 1", "axb8=R+ Kd7 Rb7+ Kd6 Kd2 axb1=B", "70793C333931332B040B4881", (3, 21, 6, 21, 13, 20)),
    ("6k1/5ppp/8/8/8/8/5PPP/R5K1 b - - 7 30", "h6 Ra8+ Kh7", "372F00383E37", (20, 1, 22)),
]


def study_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, k (plies), movedata and fen of every order."""
    rows = [(i, fen, bytearray.fromhex(h), len(h) // 4) for i, (fen, _, h, _) in enumerate(STUDIES)]
    studies = spark.createDataFrame(rows, "number int, fen string, body binary, plies int")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").withColumn("number", (F.col("o_orderkey") % len(STUDIES)).cast("int"))
    # a handful of studies, whatever the orders
    g = spread(o).join(F.broadcast(studies), "number").withColumn("k", (F.col("o_custkey") % (F.col("plies") + 1)).cast("int"))
    return g.select("o_orderkey", "k", F.concat(F.substring("body", F.lit(1), F.col("k") * 2), F.unhex(F.lit("00"))).alias("movedata"), "fen")


def _cells(fen: str) -> str:
    rows = ["".join("." * int(c) if c.isdigit() else c for c in r) for r in fen.split()[0].split("/")]
    return "".join(reversed(rows))


def _replay() -> str:
    """As for the book, from boards of their own: book has besides the board, the rights and the counters that a study starts from."""
    rows = []
    for i, (fen, text, h, replies) in enumerate(STUDIES):
        _, turn, rights, _, half, full = fen.split()
        rows.append(f"({i}, '{h}', {len(h) // 4}, [{', '.join(repr(m) for m in text.split())}], '{_cells(fen)}', {int(turn == 'b')}, '{rights.replace('-', '')}', {half}, {full}, {list(replies)})")
    sql = REPLAY
    a, b = sql.index("WITH RECURSIVE book"), sql.index("raw AS (")
    sql = sql[:a] + f"\nWITH RECURSIVE book(number, hex, n, sans, cells, black, rights0, half0, full0, replies) AS (VALUES {', '.join(rows)}),\n" + sql[b:]
    begin = "string_split('RNBQKBNRPPPPPPPP................................pppppppprnbqkbnr', '') AS board, 'KQkq' AS rights, 0 AS half,"
    assert begin in sql
    sql = sql.replace(begin, "string_split(cells, '') AS board, rights0 AS rights, half0 AS half,")
    a = sql.index("games AS (")
    return sql[:a] + f"games AS (SELECT o_orderkey, (o_custkey % (b.n + 1))::INT AS k, b.* FROM orders JOIN book b ON o_orderkey % {len(STUDIES)} = b.number)\n"


_STUDIES = _replay()
_LINES = f"{_STUDIES}, line AS (SELECT b.number, c.k, {{}} FROM book b, (SELECT unnest(range(20)) AS k) c WHERE c.k <= b.n) SELECT g.o_orderkey, {{}} FROM games g JOIN line ON line.number = g.number AND line.k = g.k"
_FEN = f"{SQL_FEN_BOARD} || ' ' || CASE WHEN (p.ply + b.black) % 2 = 0 THEN 'w' ELSE 'b' END || ' ' || CASE WHEN rights = '' THEN '-' ELSE rights END || ' ' || CASE WHEN ep < 0 THEN '-' ELSE sq.name[ep + 1] END || ' ' || half || ' ' || (b.full0 + (p.ply + b.black) // 2)"

POSITIONS_SQL = f"{_STUDIES} SELECT g.o_orderkey, {_FEN.replace('b.', 'g.')} AS fen FROM games g JOIN pos p ON p.number = g.number AND p.ply = g.k CROSS JOIN sq"
DETAILS_SQL = f"""{_STUDIES}
SELECT g.o_orderkey, p.ply - 1 AS ply, p.role, sq.name[p.f + 1] AS from_square, sq.name[p.t + 1] AS to_square, p.pr AS promotion, p.capture, p.castle AS is_castle, p.passant AS is_en_passant,
  regexp_matches(g.sans[p.ply], '[+#]$') AS is_check, g.replies[p.ply] = 0 AND NOT regexp_matches(g.sans[p.ply], '[+#]$') AS is_stalemate, g.replies[p.ply]::SMALLINT AS replies
FROM games g JOIN pos p ON p.number = g.number AND p.ply BETWEEN 1 AND g.k CROSS JOIN sq
"""
TEXT_SQL = _LINES.format(
    "(SELECT coalesce(string_agg(sq.name[p.f + 1] || sq.name[p.t + 1] || p.pr, ' ' ORDER BY p.ply), '') FROM pos p CROSS JOIN sq WHERE p.number = b.number AND p.ply BETWEEN 1 AND c.k) AS uci, "
    "array_to_string(list_transform(range(c.k), lambda i: CASE WHEN i % 2 = 0 THEN (i // 2 + 1)::VARCHAR || '. ' ELSE '' END || b.sans[i::INT + 1]), ' ') AS pgn",
    "line.uci, line.pgn",
)
_FOUND = "(SELECT min(p.ply) FROM pos p WHERE p.number = b.number AND p.ply <= c.k AND {})"
SEARCHES_SQL = _LINES.format(
    _FOUND.format("p.ply > 0 AND board[64] = 'k'") + " IS NOT NULL AS subfen, "
    + _FOUND.format(f"{SQL_FEN_BOARD} = '4k3/8/8/8/3Pp3/8/8/4K3' AND (p.ply + b.black) % 2 = 1 AND ep = 19") + "::INT AS exact, "
    + "(SELECT min(q.ply) - 1 FROM pos q WHERE q.number = b.number AND q.ply BETWEEN 1 AND c.k AND (q.ply - 1 + b.black) % 2 = 1 AND b.sans[q.ply] = 'O-O')::INT AS black_castles, "
    + _FOUND.format("board[42] = 'N'") + "::INT AS knight_there",
    "line.subfen, line.exact, line.black_castles, line.knight_there",
)


def study_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_games(spark, sf_dir).select("o_orderkey", C.fen_at_position("movedata", F.col("k"), "fen").alias("fen"))


def study_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = study_games(spark, sf_dir).select("o_orderkey", F.explode(C.move_details_ext("movedata", "fen")).alias("d"))
    names = ("promotion", "capture", "is_castle", "is_en_passant", "is_check", "is_stalemate")
    return d.select("o_orderkey", "d.ply", "d.role", F.col("d.from").alias("from_square"), F.col("d.to").alias("to_square"), *[f"d.{c}" for c in names], F.col("d.legal_response_move_count").alias("replies"))


def study_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_games(spark, sf_dir).select("o_orderkey", C.to_uci("movedata", "fen").alias("uci"), C.to_pgn("movedata", "fen").alias("pgn"))


def study_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part and a whole position, and patterns with a move of Black's and a part of the board."""
    first = lambda pattern: F.get(C.scoutfish_query_plies("movedata", pattern, "fen"), F.lit(0))
    return study_games(spark, sf_dir).select(
        "o_orderkey", C.matches_subfen("movedata", "7k/8/8/8/8/8/8/8", "fen").alias("subfen"), C.matches_fen_ply("movedata", "4k3/8/8/8/3Pp3/8/8/4K3 b - d3 0 1", "fen").alias("exact"),
        first('{"black-move":"O-O"}').alias("black_castles"), first('{"sub-fen":"8/8/1N6/8/8/8/8/8"}').alias("knight_there"),
    )
