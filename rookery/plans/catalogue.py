"""Named queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.functions import scalars as S
from rookery.functions.fen import NAMES
from rookery.operators import columns as C

from . import studies
from .book import REPLAY, REPLIES, SQL_FEN_BOARD, order_games

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scalars and lists: no Python on rows.

_EVAL = "((event_id * 7919) % 65536 - 32768)"
_SQL_MATE = "CASE WHEN e >= 32256 THEN 32768 - e WHEN e <= -32257 THEN -32769 - e END"
_SQL_CP = "CASE WHEN e < 32256 AND e > -32257 THEN e END"
_SQL_X = "CASE WHEN e >= 32256 THEN (21 - least(32768 - e, 10)) * 100 WHEN e <= -32257 THEN -(21 - least(e + 32769, 10)) * 100 ELSE greatest(-1000, least(1000, e)) END"
_SQL_CHANCES = f"round(2.0 / (1.0 + exp(-0.00368208 * ({_SQL_X}))) - 1.0, 12)"


@query(f"SELECT event_id, ({_SQL_CP})::SMALLINT AS centipawns, ({_SQL_MATE})::SMALLINT AS mate, {_SQL_CHANCES} AS chances FROM (SELECT event_id, {_EVAL} AS e FROM events)")
def eval_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr(_EVAL).cast("short")
    return _read(spark, sf_dir, "events").select("event_id", S.eval_to_centipawns(e).alias("centipawns"), S.eval_to_mate(e).alias("mate"), F.round(S.winning_chances_lichess(e), 12).alias("chances"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN t < 30 THEN 'Ultrabullet' WHEN t < 180 THEN 'Bullet' WHEN t < 480 THEN 'Blitz' WHEN t < 1500 THEN 'Rapid' ELSE 'Classical' END AS control
FROM (SELECT l_orderkey, l_linenumber, (l_quantity * 30)::INT + 40 * (l_linenumber - 1) AS t FROM lineitem)
""")
def time_control_lichess(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _read(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", S.time_control_lichess((F.col("l_quantity") * 30).cast("int"), F.col("l_linenumber") - 1).alias("control"))


def _clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("c")))).alias("x"))
    return items.select("l_orderkey", F.transform("x", lambda s: s["c"]).alias("clocks"), (F.col("l_orderkey") % 5).cast("int").alias("inc"))


_SQL_CLOCKS = "SELECT l_orderkey, list(l_quantity::INT ORDER BY l_linenumber, l_quantity::INT) AS c, (l_orderkey % 5)::INT AS i FROM lineitem GROUP BY l_orderkey"
_SQL_TIMES = f"SELECT l_orderkey, array_to_string(list_transform(range(2, len(c) + 1), lambda k: greatest(0, c[k::INT - 1] - c[k::INT] + i)), ',') AS times FROM ({_SQL_CLOCKS})"


@query(_SQL_TIMES)
def clocks_to_move_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clocks(spark, sf_dir).select("l_orderkey", F.array_join(S.clocks_to_move_times("clocks", "inc"), ",").alias("times"))


@query(_SQL_TIMES)
def clocks_to_move_times__check_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clocks(spark, sf_dir).select("l_orderkey", F.array_join(S.clocks_to_move_times__check_nulls("clocks", "inc"), ",").alias("times"))


@query(f"""
SELECT user_id, array_to_string(list_transform(l, lambda e: coalesce(({_SQL_CP})::VARCHAR, '-')), ',') AS centipawns, array_to_string(list_transform(l, lambda e: coalesce(({_SQL_MATE})::VARCHAR, '-')), ',') AS mates,
  round(list_sum(list_transform(l, lambda e: {_SQL_CHANCES})), 9) AS chances
FROM (SELECT user_id, list({_EVAL} ORDER BY event_id) AS l FROM events GROUP BY user_id)
""")
def list_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.expr(_EVAL).cast("int").alias("e")))).alias("x"))
    l = F.transform("x", lambda s: s["e"])  # noqa: E741
    text = lambda c: F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",")
    total = F.aggregate(F.transform(S.list_winning_chances_lichess(l), lambda v: F.round(v, 12)), F.lit(0.0), lambda a, v: a + v)
    return by.select("user_id", text(S.list_eval_to_centipawns(l)).alias("centipawns"), text(S.list_eval_to_mate(l)).alias("mates"), F.round(total, 9).alias("chances"))


# Positions of games.

_AT = "JOIN pos p ON p.number = g.number AND p.ply = "
#: Index of the position asked for: from the start for even orders, from the end for odd ones; often out of range.
_SQL_INDEX = "CASE WHEN g.o_orderkey % 2 = 0 THEN g.o_orderkey % 13 ELSE -(g.o_orderkey % 11) END"
_SQL_PLY = f"CASE WHEN ({_SQL_INDEX}) >= 0 THEN ({_SQL_INDEX}) WHEN g.k + ({_SQL_INDEX}) >= 0 THEN g.k + ({_SQL_INDEX}) + 1 END"
_SQL_POSITIONS = f"{REPLAY} SELECT g.o_orderkey, {{}} FROM (SELECT *, {_SQL_PLY} AS want FROM games g) g LEFT JOIN pos p ON p.number = g.number AND p.ply = g.want AND g.want <= g.k CROSS JOIN sq"


def _index() -> Column:
    k = F.col("o_orderkey")
    return F.when(k % 2 == 0, k % 13).otherwise(-(k % 11)).cast("int")


@query(_SQL_POSITIONS.format(f"{SQL_FEN_BOARD} || ' ' || CASE WHEN p.ply % 2 = 0 THEN 'w' ELSE 'b' END || ' ' || CASE WHEN rights = '' THEN '-' ELSE rights END || ' ' || CASE WHEN ep < 0 THEN '-' ELSE sq.name[ep + 1] END || ' ' || half || ' ' || (p.ply // 2 + 1) AS fen"))
def fen_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", C.fen_at_position("movedata", _index()).alias("fen"))


@query(_SQL_POSITIONS.format("replace(array_to_string(board, ''), '.', '_') AS board"))
def board_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = order_games(spark, sf_dir).select("o_orderkey", C.board_at_position("movedata", _index()).alias("b"))
    cells = F.concat(*[F.when(F.col(f"b.{s}") == "", "_").otherwise(F.col(f"b.{s}")) for s in NAMES])
    return board.select("o_orderkey", F.when(F.col("b").isNotNull(), cells).alias("board"))


_SQL_PLACES = "CASE WHEN board IS NOT NULL THEN array_to_string(list_sort(list_transform(list_filter(range(64), lambda s: board[s::INT + 1] = '{}'), lambda s: sq.name[s::INT + 1])), ' ') END AS {}"


@query(_SQL_POSITIONS.format(", ".join(_SQL_PLACES.format(c, n) for c, n in (("K", "wk"), ("R", "wr"), ("P", "wp"), ("q", "bq"), ("b", "bb"), ("n", "bn")))))
def pieces_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_games(spark, sf_dir).select("o_orderkey", C.pieces_at_position("movedata", _index()).alias("p"))
    return p.select("o_orderkey", F.col("p.wK").alias("wk"), *[F.array_join(f"p.{a}", " ").alias(b) for a, b in (("wR", "wr"), ("wP", "wp"), ("bQ", "bq"), ("bB", "bb"), ("bN", "bn"))])


@query(_SQL_POSITIONS.format(", ".join(f"len(list_filter(board, lambda c: c = '{c}'))::SMALLINT AS {'w' if c.isupper() else 'b'}_{c.lower()}" for c in "QRBNPqrbnp")))
def piece_counts_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_games(spark, sf_dir).select("o_orderkey", C.piece_counts_at_position("movedata", _index()).alias("c"))
    return p.select("o_orderkey", *[F.col(f"c.{s}{r}").alias(f"{s}_{r.lower()}") for s in "wb" for r in "QRBNP"])


# Moves of games.

_SQL_UCI = "(SELECT coalesce(string_agg(sq.name[p.f + 1] || sq.name[p.t + 1] || p.pr, ' ' ORDER BY p.ply), '') FROM pos p CROSS JOIN sq WHERE p.number = b.number AND p.ply BETWEEN 1 AND c.k)"
#: Every length of every line, so that an order only has to look its own up.
_SQL_LINES = f"{REPLAY}, line AS (SELECT b.number, c.k, {{}} AS x FROM book b, (SELECT unnest(range(200)) AS k) c WHERE c.k <= b.n) SELECT g.o_orderkey, line.x AS {{}} FROM games g JOIN line ON line.number = g.number AND line.k = g.k"


@query(_SQL_LINES.format(_SQL_UCI, "uci"))
def to_uci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", C.to_uci("movedata").alias("uci"))


@query(_SQL_LINES.format("array_to_string(list_transform(range(c.k), lambda i: CASE WHEN i % 2 = 0 THEN (i // 2 + 1)::VARCHAR || '. ' ELSE '' END || b.sans[i::INT + 1]), ' ')", "pgn"))
def to_pgn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", C.to_pgn("movedata").alias("pgn"))


_SQL_MOVED = "(SELECT coalesce(string_agg(CASE WHEN p.ply % 2 = 1 THEN upper(p.role) ELSE p.role END, '' ORDER BY p.ply), '') FROM pos p WHERE p.number = b.number AND p.ply BETWEEN 1 AND c.k)"


@query(_SQL_LINES.format(_SQL_MOVED, "moved"))
def moved_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", C.moved_pieces("movedata").alias("moved"))


@query(_SQL_LINES.format(_SQL_MOVED, "moved"))
def moved_pieces_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", F.array_join(C.moved_pieces_list("movedata"), "").alias("moved"))


_SQL_DETAIL_COLUMNS = (
    "p.ply - 1 AS ply, p.role, sq.name[p.f + 1] AS from_square, sq.name[p.t + 1] AS to_square, p.pr AS promotion, p.capture, p.castle AS is_castle, p.passant AS is_en_passant, "
    "regexp_matches(g.sans[p.ply], '[+#]$') AS is_check, g.sans[p.ply] LIKE '%#' AS is_checkmate"
)
_SQL_DETAILS = f"{REPLAY} SELECT g.o_orderkey, {_SQL_DETAIL_COLUMNS}{{}} FROM games g {_AT}{{}} CROSS JOIN sq"
_PLAIN = [("ply", "ply"), ("role", "role"), ("from", "from_square"), ("to", "to_square"), *[(c, c) for c in ("promotion", "capture", "is_castle", "is_en_passant", "is_check", "is_checkmate")]]


def _flat(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return df.select("o_orderkey", *[F.col(f"d.{a}").alias(b) for a, b in _PLAIN], *[F.col(f"d.{c}").alias(c) for c in more])


@query(_SQL_DETAILS.format("", "p.ply AND p.ply BETWEEN 1 AND g.k"))
def move_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(order_games(spark, sf_dir).select("o_orderkey", F.explode(C.move_details("movedata")).alias("d")))


# The book's lines end in mate, or in positions that are no stalemate.
@query(_SQL_DETAILS.format(", false AS is_stalemate", "p.ply AND p.ply BETWEEN 1 AND g.k"))
def move_details_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(order_games(spark, sf_dir).select("o_orderkey", F.explode(C.move_details_ext("movedata")).alias("d")), ("is_stalemate",))


@query(f"{REPLAY}, replies(number, n) AS (VALUES {', '.join(f'({i}, {list(r)})' for i, r in enumerate(REPLIES))}) SELECT g.o_orderkey, (p.ply - 1)::INT AS ply, r.n[p.ply]::SMALLINT AS replies FROM games g {_AT}p.ply AND p.ply BETWEEN 1 AND g.k JOIN replies r ON r.number = g.number")
def legal_response_move_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has the numbers of replies from a plain move generator, see the tests."""
    return order_games(spark, sf_dir).select("o_orderkey", F.posexplode(C.move_details_ext("movedata")).alias("ply", "d")).select("o_orderkey", "ply", F.col("d.legal_response_move_count").alias("replies"))


_SQL_AT = "CASE WHEN ({0}) >= 0 AND ({0}) < g.k THEN ({0}) + 1 WHEN ({0}) < 0 AND g.k + ({0}) >= 0 THEN g.k + ({0}) + 1 ELSE -1 END".format(_SQL_INDEX)


@query(_SQL_DETAILS.format("", _SQL_AT))
def move_details_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(order_games(spark, sf_dir).select("o_orderkey", C.move_details_at("movedata", _index()).alias("d")).where("d is not null"))


@query(_SQL_DETAILS.format(", false AS is_stalemate", _SQL_AT))
def move_details_ext_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(order_games(spark, sf_dir).select("o_orderkey", C.move_details_ext_at("movedata", _index()).alias("d")).where("d is not null"), ("is_stalemate",))


# Searches.


def _sql_first(condition: str) -> str:
    return f"(SELECT min(p.ply) FROM pos p WHERE p.number = b.number AND p.ply <= c.k AND {condition})"


_SUBFEN = "8/8/2n5/8/2B1P3/8/8/4K3"
_SQL_SUBFEN = "board[43] = 'n' AND board[27] = 'B' AND board[29] = 'P' AND board[5] = 'K'"
_FEN = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"
_SQL_FEN = f"{SQL_FEN_BOARD} = '{_FEN.split()[0]}' AND p.ply % 2 = 0 AND rights = 'KQkq'"


@query(_SQL_LINES.format(f"{_sql_first(f'p.ply > 0 AND {_SQL_SUBFEN}')} IS NOT NULL", "found"))
def matches_subfen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", C.matches_subfen("movedata", _SUBFEN).alias("found"))


@query(_SQL_LINES.format(f"{_sql_first(_SQL_FEN)} IS NOT NULL", "found"))
def matches_fen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", C.matches_fen("movedata", _FEN).alias("found"))


@query(_SQL_LINES.format(f"{_sql_first(_SQL_FEN)}::INT", "ply"))
def matches_fen_ply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", C.matches_fen_ply("movedata", _FEN).alias("ply"))


# A rule tests the position before a move together with that move: in SQL, the row after.
_SQL_RULE = "(SELECT min(q.ply) - 1 FROM pos q JOIN pos p ON p.number = q.number AND p.ply = q.ply - 1 WHERE q.number = b.number AND q.ply BETWEEN 1 AND c.k AND {})"
_SQL_COUNT = lambda c: f"len(list_filter(p.board, lambda x: x = '{c}'))"


@query(_SQL_LINES.format(f"{_SQL_RULE.format(chr(39).join(['q.role = ', 'b', ' AND q.capture = ', 'p', ' AND q.ply % 2 = 1']))} IS NOT NULL", "found"))
def scoutfish_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", C.scoutfish_query("movedata", '{"moved":"B","captured":"P","stm":"white"}').alias("found"))


_SQL_IMBALANCE = " AND ".join(f"{_SQL_COUNT(a)} - {_SQL_COUNT(a.lower())} = {d}" for a, d in zip("PNBRQ", (1, 1, -1, 0, 0)))


@query(_SQL_LINES.format(_sql_first(_SQL_IMBALANCE) + "::INT", "ply"))
def scoutfish_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    plies = C.scoutfish_query_plies("movedata", '{"imbalance":"PNvB"}')
    return order_games(spark, sf_dir).select("o_orderkey", F.get(plies, F.lit(0)).alias("ply"))


_MATERIAL = "KQRRBBNNPPPPPPPPKQRRBBNNPPPPPPP"
_SQL_MATERIAL = " AND ".join(f"{_SQL_COUNT(c)} = {n}" for c, n in zip("QRBNPqrbnp", (1, 2, 2, 2, 8, 1, 2, 2, 2, 7)))


@query(_SQL_LINES.format(_sql_first(_SQL_MATERIAL) + "::INT", "ply"))
def scoutfish_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    plies = C.scoutfish_query_plies("movedata", '{"material":"%s"}' % _MATERIAL)
    return order_games(spark, sf_dir).select("o_orderkey", F.get(plies, F.lit(0)).alias("ply"))


_SQL_CASTLED = "(SELECT min(q.ply) FROM pos q WHERE q.number = b.number AND q.ply <= c.k AND q.castle AND q.ply % 2 = 1 AND q.t % 8 = 6)"


@query(_SQL_LINES.format(f"(SELECT ({_SQL_CASTLED} - 1)::VARCHAR || ',' || (min(q.ply) - 1) FROM pos q WHERE q.number = b.number AND q.ply <= c.k AND q.ply > {_SQL_CASTLED} AND q.capture <> '')", "plies"))
def scoutfish_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    plies = C.scoutfish_query_plies("movedata", '{"sequence":[{"white-move":"O-O"},{"captured":"KQRBNP"}]}')
    return order_games(spark, sf_dir).select("o_orderkey", F.when(F.size(plies) > 0, F.array_join(plies, ",")).alias("plies"))


@query(_SQL_LINES.format("(SELECT (min(q.ply) - 1)::VARCHAR || ',' || min(q.ply) FROM pos q JOIN pos r ON r.number = q.number AND r.ply = q.ply + 1 WHERE q.number = b.number AND r.ply <= c.k AND q.ply > 0 AND q.capture <> '' AND r.capture <> '')", "plies"))
def scoutfish_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    plies = C.scoutfish_query_plies("movedata", '{"streak":[{"captured":"KQRBNP"},{"captured":"KQRBNP"}]}')
    return order_games(spark, sf_dir).select("o_orderkey", F.when(F.size(plies) > 0, F.array_join(plies, ",")).alias("plies"))


# Encodings.


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of which some end in half a move, or in a move from an empty square."""
    tail = F.when(F.col("o_orderkey") % 3 == 0, F.unhex(F.lit("00"))).when(F.col("o_orderkey") % 3 == 1, F.unhex(F.lit("1C00"))).otherwise(F.unhex(F.lit("1B2300")))
    g = order_games(spark, sf_dir)
    return g.withColumn("movedata", F.concat(F.expr("substring(movedata, 1, 2 * k)"), tail))


@query(f"{REPLAY} SELECT g.o_orderkey, o_orderkey % 3 = 0 OR (o_orderkey % 3 = 2 AND p.board[28] <> '.') AS valid FROM games g {_AT}g.k")
def is_valid_movedata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damaged(spark, sf_dir).select("o_orderkey", C.is_valid_movedata("movedata").alias("valid"))


@query(_SQL_LINES.format("(SELECT upper(substr(b.hex, 1, 4 * c.k)) || '00')", "low"))
def recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the denser level and back; the result is compared with the bytes of the book."""
    return order_games(spark, sf_dir).select("o_orderkey", F.hex(C.recompress(C.recompress("movedata", 1), 0)).alias("low"))


@query(_SQL_LINES.format(_SQL_UCI, "uci"))
def to_uci_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_games(spark, sf_dir).select("o_orderkey", C.to_uci(C.recompress("movedata", 1)).alias("uci"))


@query(_SQL_LINES.format("(SELECT upper(substr(b.hex, 1, 4 * c.k)) || '00')", "low"))
def encode_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From UCI to bytes: castling in UCI is the king's own move, so it is normalised by a second pass."""
    uci = F.split(C.to_uci("movedata"), " ")
    moves = F.when(F.col("k") > 0, uci).otherwise(F.array().cast("array<string>"))
    return order_games(spark, sf_dir).select("o_orderkey", F.hex(C.recompress(C.encode_moves(moves), 0)).alias("low"))


# Relational work around the functions.


@query(f"""{REPLAY}
SELECT o_orderstatus, g.number, count(*) AS games, sum(g.k)::BIGINT AS plies, sum(len(list_filter(p.board, lambda c: c <> '.')))::BIGINT AS men, round(avg(o_totalprice), 2) AS price
FROM games g {_AT}g.k GROUP BY ALL
""")
def final_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Men left at the end, by status and line."""
    g = order_games(spark, sf_dir, "o_orderstatus", "o_totalprice").withColumn("c", C.piece_counts_at_position("movedata", F.when(F.col("k") > 0, -1).otherwise(0)))
    men = sum((F.col(f"c.{s}{r}").cast("long") for s in "wb" for r in "QRBNP"), F.lit(2).cast("long"))
    return g.groupBy("o_orderstatus", "number").agg(F.count(F.lit(1)).alias("games"), F.sum(F.col("k").cast("long")).alias("plies"), F.sum(men).alias("men"), F.round(F.avg("o_totalprice"), 2).alias("price"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_material(spark, sf_dir)


@query(f"""{REPLAY}
SELECT p.role, p.capture, count(*) AS n FROM games g {_AT}p.ply AND p.ply BETWEEN 1 AND g.k GROUP BY CUBE (p.role, p.capture)
""")
def captures_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = order_games(spark, sf_dir).select(F.explode(C.move_details("movedata")).alias("d")).select("d.role", "d.capture")
    return d.cube("role", "capture").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT o_orderkey, o_custkey, o_orderdate, o_custkey % 30 AS x FROM orders)
SELECT o_orderkey, row_number() OVER w AS place, lag(o_orderkey) OVER w AS before, count(*) OVER (PARTITION BY o_custkey) AS games FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def games_by_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window functions: a player's games in order of time."""
    w = Window.partitionBy("o_custkey")
    o = w.orderBy("o_orderdate", "o_orderkey")
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(o).alias("place"), F.lag("o_orderkey").over(o).alias("before"), F.count(F.lit(1)).over(w).alias("games"))


@query(f"""
SELECT e.event_id, max(o.o_orderkey) AS last_order FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts
  AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = e.user_id AND n.o_orderdate <= e.ts AND n.o_orderdate > o.o_orderdate) GROUP BY e.event_id
""")
def last_game_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by union and window: one shuffle by player, no range join."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("game"), F.lit(None).cast("long").alias("event_id"))
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("who"), F.col("ts").alias("at"), F.lit(None).cast("long").alias("game"), "event_id")
    w = Window.partitionBy("who").orderBy("at", F.col("event_id").isNotNull(), "game").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = o.unionAll(e).withColumn("last_order", F.last("game", True).over(w))
    return both.where("event_id is not null").select("event_id", "last_order")


@query("""
SELECT c_mktsegment, n_name, count(*) AS players FROM customer c JOIN nation n ON c_nationkey = n_nationkey
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderkey % 8 = 1) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderkey % 8 = 2) GROUP BY ROLLUP (c_mktsegment, n_name)
""")
def players_of_a_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti join, rollup."""
    c, n, o = (_read(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    played = lambda r: o.where(F.col("o_orderkey") % 8 == r).select(F.col("o_custkey").alias("c_custkey"))
    who = c.join(played(1), "c_custkey", "left_semi").join(played(2), "c_custkey", "left_anti").join(n, c.c_nationkey == n.n_nationkey)
    return who.rollup("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("players"))


# Games that start elsewhere.

for _f, _sql in ((studies.study_positions, studies.POSITIONS_SQL), (studies.study_details, studies.DETAILS_SQL), (studies.study_text, studies.TEXT_SQL), (studies.study_searches, studies.SEARCHES_SQL)):
    query(_sql)(_f)


# More relational work.


@query(f"{REPLAY} SELECT g.o_orderkey, g.number, p.half FROM games g {_AT}g.k ORDER BY p.half DESC, g.o_totalprice DESC, g.o_orderkey LIMIT 50")
def quietest_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort and limit: the ends longest without capture or pawn's move; a bounded heap a task, no full sort."""
    g = order_games(spark, sf_dir, "o_totalprice").withColumn("half", F.element_at(F.split(C.fen_at_position("movedata", F.col("k")), " "), 5).cast("int"))
    return g.orderBy(F.desc("half"), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "number", "half")


@query(f"""{REPLAY}
, played AS (SELECT g.o_orderkey, p.role FROM games g {_AT}p.ply AND p.ply BETWEEN 1 AND g.k), taken AS (SELECT g.o_orderkey, p.capture AS role FROM games g {_AT}p.ply AND p.ply BETWEEN 1 AND g.k AND p.capture <> '')
SELECT 'moved and taken' AS what, * FROM (SELECT * FROM played INTERSECT SELECT * FROM taken) UNION ALL SELECT 'moved only', * FROM (SELECT * FROM played EXCEPT SELECT * FROM taken)
UNION ALL SELECT 'either', * FROM (SELECT * FROM played UNION SELECT * FROM taken)
""")
def roles_as_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on the roles that moved, and that were taken, in each game."""
    d = order_games(spark, sf_dir).select("o_orderkey", F.explode(C.move_details("movedata")).alias("d"))
    played, taken = d.select("o_orderkey", F.col("d.role").alias("role")), d.where("d.capture <> ''").select("o_orderkey", F.col("d.capture").alias("role"))
    named = lambda name, df: df.select(F.lit(name).alias("what"), "o_orderkey", "role")
    return named("moved and taken", played.intersect(taken)).unionAll(named("moved only", played.subtract(taken))).unionAll(named("either", played.union(taken).distinct()))


@query("""
WITH g AS (SELECT o_custkey, count(*) AS games, max(o_totalprice) AS best FROM orders WHERE o_orderkey % 8 = 3 GROUP BY o_custkey), e AS (SELECT user_id, count(*) AS events FROM events WHERE event_id % 5 = 0 GROUP BY user_id)
SELECT coalesce(o_custkey, user_id) AS player, games, events, round(best, 2) AS best FROM g FULL JOIN e ON user_id = o_custkey
""")
def players_and_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of two aggregates: both sides are small rows by the time they are shuffled, already by the join's key."""
    g = _read(spark, sf_dir, "orders").where("o_orderkey % 8 = 3").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("games"), F.max("o_totalprice").alias("best"))
    e = _read(spark, sf_dir, "events").where("event_id % 5 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.join(e, g.o_custkey == e.user_id, "full").select(F.coalesce("o_custkey", "user_id").alias("player"), "games", "events", F.round("best", 2).alias("best"))


#: Ranges that an order of values is cut into; each is one task's work at most.
RANGES = 128


def _place(x: Column, cuts: list[float], first: int = 0) -> Column:
    """The number of cuts that aren't above a value, by halving."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(x < cuts[m], _place(x, cuts[:m], first)).otherwise(_place(x, cuts[m + 1 :], first + m + 1))


@query("""
WITH band AS (SELECT s_suppkey, s_nationkey, s_acctbal - 300 AS low, s_acctbal + 300 AS high FROM supplier)
SELECT c_custkey, count(s_suppkey) AS rivals FROM customer LEFT JOIN band ON c_acctbal > low AND c_acctbal < high AND c_nationkey <> s_nationkey GROUP BY c_custkey
""")
def rivals_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theta join that is only counted, so without pairs: who lies in (low, high) has passed low, and not yet high.

    All values go in order, with +1 at a low and -1 at a high; the sum so far over all suppliers, less that over those of the
    customer's own nation, is the count. The order is cut into ranges of like many rows, which start from the sums of the ranges before.
    """
    s = _read(spark, sf_dir, "supplier").where("s_suppkey is not null and s_nationkey is not null")
    s = s.select(F.col("s_nationkey").alias("n"), (F.col("s_acctbal") - 300).cast("double").alias("low"), (F.col("s_acctbal") + 300).cast("double").alias("high")).where("low < high")
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.col("c_acctbal").cast("double").alias("v"))
    # at one value: first who ends there, then customers, then who begins, as both ends are open
    edges = s.select("n", F.expr("inline(array(struct(high as v, 0 as o, -1L as w), struct(low as v, 2 as o, 1L as w)))"))
    values = c.select("v").unionAll(edges.select("v")).where("v is not null and not isnan(v)")
    cuts = sorted(set(values.agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)])).first()[0] or []))
    edges = edges.withColumn("r", _place(F.col("v"), cuts))
    before = edges.groupBy("r", "n").agg(F.sum("w").alias("w")).where(F.col("r") < len(cuts)).select(F.explode(F.sequence(F.col("r") + 1, F.lit(len(cuts)))).alias("r"), "n", "w")
    row = ["c_custkey", "n", "v", "o", "w", "r"]
    none = F.lit(None)
    rows = c.withColumns({"o": F.lit(1), "w": F.lit(0).cast("long"), "r": _place(F.col("v"), cuts)}).select(row)
    rows = rows.unionAll(edges.withColumn("c_custkey", none.cast("long")).select(row)).unionAll(before.withColumns({"c_custkey": none.cast("long"), "v": none.cast("double"), "o": F.lit(0)}).select(row))
    so_far = lambda *by: F.sum("w").over(Window.partitionBy(*by).orderBy("v", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = rows.withColumns({"all": so_far("r"), "own": so_far("r", "n")}).where("o = 1")
    rivals = F.when(F.col("v").isNotNull() & F.col("n").isNotNull(), F.col("all") - F.col("own")).otherwise(0)
    return counted.groupBy("c_custkey").agg(F.sum(rivals).alias("rivals"))
