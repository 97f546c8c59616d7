"""A small book of games, and a game for every order: some first plies of one of them.

The SQL replays the moves from their bytes by itself, on boards written as lists of 64 letters, so
it doesn't depend on the decoder that it is compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known games and lines as move text, and the same in bytes.
BOOK = [
    ("e4 e5 Bc4 Nc6 Nf3 b6 O-O Nf6 c3 Bc5 Bxf7+ Kxf7 Ng5+ Kg8 Qb3+ Nd5 Qxd5+ Kf8 Qf7#", "0C1C3424051A392A0615312904073E2D0A123D229A35BC351526353E03112D2391233E3D2335"),
    ("e4 e5 Nf3 d6 d4 Bg4 dxe5 Bxf3 Qxf3 dxe5 Bc4 Nf6 Qb3 Qe7 Nc3 c6 Bg5 b5 Nxb5 cxb5 Bxb5+ Nbd7 O-O-O Rd8 Rxd7 Rxd7 Rd1 Qe6 Bxd7+ Nxd7 Qb8+ Nxb8 Rd8#", "0C1C34240615332B0B1B3A1E9B249E158315AB24051A3E2D15113B340112322A022631219221AA219A2139330400383B8333BB330703342CA133AD331139B339033B"),
    ("f3 e5 g4 Qh4#", "0D1534240E1E3B1F"),
    ("e4 e5 Bc4 Nc6 Qh5 Nf6 Qxf7#", "0C1C3424051A392A03273E2DA735"),
    ("e4 a6 e5 d5 exd6 Qxd6 Nf3 Bg4 Be2 Nc6 O-O O-O-O", "0C1C30281C243323A42BBB2B06153A1E050C392A04073C38"),
    ("d4 d5 Nc3 Nc6 Bf4 Bf5 Qd2 Qd7 O-O-O O-O-O", "0B1B33230112392A021D3A25030B3B3304003C38"),
    ("a4 b5 axb5 a6 bxa6 Bb7 axb7 Qc8 bxa8=Q Qa6 Qxb8+", "0818312198213028A1283A31A8313B3AF1383A28B839"),
    ("d4 Nf6 c4 e6 Nc3 Bb4 e3 O-O Bd3 d5 Nf3 c5 O-O Nc6 a3 Bxc3 bxc3 dxc4 Bxc4 Qc7", "0B1B3E2D0A1A342C01123D190C143C3F05133323061532220407392A081099128912A31A931A3B32"),
]
#: Legal replies to each move of the lines, from a plain move generator.
REPLIES = [
    (20, 29, 29, 33, 31, 33, 32, 30, 30, 31, 3, 24, 5, 27, 3, 28, 1, 32, 0),
    (20, 29, 29, 27, 33, 35, 36, 35, 29, 40, 37, 45, 36, 44, 29, 41, 27, 43, 27, 44, 5, 49, 22, 51, 22, 42, 18, 47, 4, 46, 1, 33, 0),
    (20, 19, 30, 0),
    (20, 29, 29, 33, 28, 43, 0),
    (20, 30, 18, 31, 28, 29, 44, 26, 46, 27, 51, 25),
    (20, 27, 27, 28, 28, 34, 34, 35, 35, 30),
    (20, 22, 20, 25, 20, 24, 24, 33, 20, 31, 1),
    (20, 28, 22, 30, 28, 27, 33, 30, 30, 36, 33, 36, 32, 38, 35, 34, 33, 33, 35, 34),
]


def book(spark: SparkSession) -> DataFrame:
    """number, body (moves in bytes), plies."""
    rows = [(i, bytearray.fromhex(h), len(h) // 4) for i, (_, h) in enumerate(BOOK)]
    return spark.createDataFrame(rows, "number int, body binary, plies int")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than there are cores, dealt to all of them; others as they are. What follows costs far more than moving these rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    # only their number leaves the JVM
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def order_games(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """o_orderkey, number, k (plies), movedata of every order, and further columns of orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = orders.select("o_orderkey", "o_custkey", *columns).withColumn("number", (F.col("o_orderkey") % len(BOOK)).cast("int"))
    # the book has eight rows, whatever the orders
    g = spread(o).join(F.broadcast(book(spark)), "number").withColumn("k", (F.col("o_custkey") % (F.col("plies") + 1)).cast("int"))
    kept = [c for c in o.columns if c not in ("number", "o_custkey")]
    return g.select(*kept, "number", "k", F.concat(F.substring("body", F.lit(1), F.col("k") * 2), F.unhex(F.lit("00"))).alias("movedata"))


def _replay() -> str:
    """CTEs book, moves (with what each does), pos (board and rights after each ply), games (an order's line and length)."""
    rows = ", ".join(f"({i}, '{h}', {len(h) // 4}, [{', '.join(repr(m) for m in t.split())}])" for i, (t, h) in enumerate(BOOK))
    return f"""
WITH RECURSIVE book(number, hex, n, sans) AS (VALUES {rows}),
raw AS (
  SELECT number, i AS ply, ('0x' || substr(hex, 4 * i::INT + 1, 2))::INT AS a, ('0x' || substr(hex, 4 * i::INT + 3, 2))::INT AS b FROM (SELECT *, unnest(range(n)) AS i FROM book)
),
step AS (SELECT number, ply, a & 63 AS f, b & 63 AS t, CASE WHEN a & 64 > 0 THEN substr('qrbn', (b >> 6) + 1, 1) ELSE '' END AS pr FROM raw),
pos AS (
  SELECT number, 0 AS ply, string_split('RNBQKBNRPPPPPPPP................................pppppppprnbqkbnr', '') AS board, 'KQkq' AS rights, 0 AS half, -1 AS ep,
    '' AS role, '' AS capture, '' AS pr, -1 AS f, -1 AS t, false AS castle, false AS passant FROM book
  UNION ALL
  SELECT number, ply + 1,
    list_transform(range(64), lambda s: CASE
      WHEN castle AND s = kt THEN pc WHEN castle AND s = rt THEN tg WHEN castle AND (s = f OR s = to0) THEN '.'
      WHEN s = to0 THEN CASE WHEN pr = '' THEN pc WHEN white THEN upper(pr) ELSE pr END
      WHEN s = f OR (passant AND s = f - f % 8 + to0 % 8) THEN '.' ELSE board[s::INT + 1] END),
    CASE WHEN r = '' THEN '' ELSE r END, CASE WHEN lower(pc) = 'p' OR (tg <> '.' AND NOT castle) THEN 0 ELSE half + 1 END,
    CASE WHEN lower(pc) = 'p' AND abs(to0 - f) = 16 THEN (f + to0) // 2 ELSE -1 END, lower(pc), CASE WHEN castle OR (tg = '.' AND NOT passant) THEN '' WHEN passant THEN 'p' ELSE lower(tg) END,
    pr, f, CASE WHEN castle THEN kt ELSE to0 END, castle, passant
  FROM (
    SELECT *, CASE WHEN to0 > f THEN f - f % 8 + 6 ELSE f - f % 8 + 2 END AS kt, CASE WHEN to0 > f THEN f - f % 8 + 5 ELSE f - f % 8 + 3 END AS rt, pc = upper(pc) AS white,
      replace(replace(replace(replace(rights, CASE WHEN f = 4 OR f = 7 OR to0 = 7 THEN 'K' ELSE '#' END, ''), CASE WHEN f = 4 OR f = 0 OR to0 = 0 THEN 'Q' ELSE '#' END, ''),
        CASE WHEN f = 60 OR f = 63 OR to0 = 63 THEN 'k' ELSE '#' END, ''), CASE WHEN f = 60 OR f = 56 OR to0 = 56 THEN 'q' ELSE '#' END, '') AS r
    FROM (
      SELECT p.number, p.ply, p.board, p.rights, p.half, s.f AS f, s.t AS to0, s.pr AS pr, p.board[s.f + 1] AS pc, p.board[s.t + 1] AS tg,
        (p.board[s.f + 1] = 'K' AND p.board[s.t + 1] = 'R') OR (p.board[s.f + 1] = 'k' AND p.board[s.t + 1] = 'r') AS castle,
        lower(p.board[s.f + 1]) = 'p' AND s.f % 8 <> s.t % 8 AND p.board[s.t + 1] = '.' AS passant
      FROM pos p JOIN step s ON s.number = p.number AND s.ply = p.ply
    )
  )
),
sq AS (SELECT list_transform(range(64), lambda s: substr('abcdefgh', (s % 8)::INT + 1, 1) || (s // 8 + 1)::VARCHAR) AS name),
games AS (
  SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice, b.number, (o_custkey % (b.n + 1))::INT AS k, b.n, b.sans FROM orders JOIN book b ON o_orderkey % {len(BOOK)} = b.number
)
"""


REPLAY = _replay()
#: The board part of a FEN, from a list of 64 letters.
SQL_FEN_BOARD = "array_to_string(list_transform(range(8), lambda r: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(board[(57 - 8 * r)::INT : (64 - 8 * r)::INT], ''), '[.]{8}', '8', 'g'), '[.]{7}', '7', 'g'), '[.]{6}', '6', 'g'), '[.]{5}', '5', 'g'), '[.]{4}', '4', 'g'), '[.]{3}', '3', 'g'), '[.]{2}', '2', 'g'), '[.]', '1', 'g')), '/')"
