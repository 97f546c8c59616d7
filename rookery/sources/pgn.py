"""PGN files as a table of games.

Plain files are split between tasks wherever a game begins; zstd-compressed ones are unpacked by one task
each. Games are parsed in batches: all main lines of a batch advance together, then all variations of
the first depth, and so on, so that finding the move that a SAN means is array work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.bits import EDGE_ROWS, KING, NONE, ONE, PAWN, PAWN_FROM, QUEEN, ROOK, ZERO, Attacks, Positions, U, bit, has, lowest, piece_from
from rookery.functions.codec import recompress
from rookery.functions.fen import START, parse_fen, to_positions
from rookery.functions.games import LOW, MEDIUM, _Board

SCHEMA = (
    "event string, site string, round string, fen string, white string, black string, white_rating short, black_rating short, white_title string, black_title string, "
    "clocks_white array<int>, clocks_black array<int>, evals array<short>, result string, time_control string, ply_count int, utc_timestamp timestamp_ntz, movedata binary, error string"
)
_TAG = re.compile(r'^\s*\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]\s*$', re.M)
_TOKEN = re.compile(r"\{([^}]*)\}|;([^\n]*)|(\()|(\))|\$\d+|\d+\.+|(1-0|0-1|1/2-1/2|\*)|([^\s(){};$]+)")
_SAN = re.compile(r"(?:([NBRQK])?([a-h])?([1-8])?(x)?([a-h])([1-8])(?:=?([NBRQ]))?|([O0]-[O0](-[O0])?))[+#]?[!?]*$")
_EVAL = re.compile(r"\[%eval (-?\d+\.\d+|#-?\d+)\]")
_CLOCK = re.compile(r"\[%clk (\d+):(\d{2}):(\d{2})\]")
_ROLES = {"N": 1, "B": 2, "R": 3, "Q": 4, "K": 5}
_TAGS = {"Event": "event", "Site": "site", "Round": "round", "FEN": "fen", "White": "white", "Black": "black", "WhiteTitle": "white_title", "BlackTitle": "black_title", "Result": "result", "TimeControl": "time_control"}


@dataclass
class Line:
    """Moves as parsed; hanging: the variations that replace each of them."""

    sans: list[tuple] = field(default_factory=list)
    hanging: dict[int, list[Line]] = field(default_factory=dict)
    done: list[bytes] = field(default_factory=list)


def parse_eval(text: str) -> int | None:
    if text[0] == "#":
        mate = int(text[1:])
        return None if not mate or abs(mate) > 512 else 32768 - mate if mate > 0 else -32769 - mate
    value = round(float(text) * 100)
    return max(-32256, min(32255, value))


def parse_time(date: str | None, time: str | None) -> datetime | None:
    """Unknown months and days are 1, unknown times 0; without a year there is no time."""
    if date is None:
        return None
    parts = date.split("."), (time or "00:00:00").split(":")
    if any(len(p) != 3 for p in parts):
        return None
    numbers = []
    for text, default in zip([*parts[0], *parts[1]], (None, 1, 1, 0, 0, 0)):
        if not text.strip("?"):
            if default is None:
                return None
            numbers.append(default)
        elif text.isascii() and text.isdigit():
            numbers.append(int(text))
        else:
            return None
    try:
        return datetime(*numbers)
    except ValueError:
        return None


def _san(text: str) -> tuple | None:
    m = _SAN.match(text)
    if not m:
        return None
    role, file, rank, _, f, r, promotion, castle, long_ = m.groups()
    if castle:
        return (KING, NONE, NONE, NONE, NONE, 2 if long_ else 1)
    return (_ROLES.get(role, PAWN), ord(file) - 97 if file else NONE, int(rank) - 1 if rank else NONE, (int(r) - 1) * 8 + ord(f) - 97, _ROLES[promotion] if promotion else NONE, 0)


def parse_text(text: str, variations: bool = True) -> tuple[dict, Line, list, str | None]:
    """Tags, the tree of moves, comments of the main line as (ply, text), and what is wrong."""
    tags = {k: re.sub(r"\\(.)", r"\1", v) for k, v in _TAG.findall(text)}
    body = _TAG.sub("", re.sub(r"^%.*$", "", text, flags=re.M))
    main = line = Line()
    stack: list[Line] = []
    comments, skipping, wrong = [], 0, None
    broken: set[int] = set()
    for brace, semicolon, begin, end, result, word in _TOKEN.findall(body):
        if begin:
            if skipping or not line.sans or not variations or id(line) in broken:
                skipping += 1
                continue
            child = Line()
            line.hanging.setdefault(len(line.sans) - 1, []).append(child)
            stack.append(line)
            line = child
        elif end:
            if skipping:
                skipping -= 1
            elif stack:
                line = stack.pop()
        elif skipping:
            continue
        elif result:
            if not stack:
                break
        elif word:
            if id(line) in broken or not word.strip(".!?"):
                continue
            san = _san(word.lstrip("."))
            if san is None:
                broken.add(id(line))
                if line is main:
                    wrong = f"invalid SAN '{word}'"
            else:
                line.sans.append(san)
        elif line is main and (brace or semicolon):
            comments.append((len(main.sans), brace or semicolon))
    return tags, main, comments, wrong


def find_moves(p: Positions, cells: np.ndarray, want: np.ndarray):
    """start, to, role, promotion, capture, rook, en passant, and failures for one SAN in each position."""
    a = Attacks(p)
    n = len(p)
    role, file, rank, to, promotion, castle = want.T
    castling = castle > 0
    target = np.where(castling, 0, to)
    start, rook = np.zeros(n, np.int64), np.full(n, NONE, np.int64)
    mine = np.zeros(n, U)
    for r in range(1, 6):
        i = np.flatnonzero((role == r) & ~castling)
        if len(i):
            mine[i] = piece_from(r, a.occupied[i], target[i]) & np.where(p.turn[i] == 0, p.boards[r, i], p.boards[6 + r, i])
    i = np.flatnonzero((role == PAWN) & ~castling)
    passing = np.zeros(n, bool)
    if len(i):
        t, turn = target[i], p.turn[i]
        pawns = p.own(PAWN)[i]
        back = np.where(turn == 0, -8, 8)
        theirs, ep = has(a.theirs[i], t), p.ep[i] == t
        takes = theirs | (ep & ~has(a.occupied[i], t))
        one = np.where((t + back >= 0) & (t + back < 64), bit((t + back) & 63), ZERO)
        two = np.where((t >> 3) == np.where(turn == 0, 3, 4), bit((t + 2 * back) & 63), ZERO)
        steps = np.where(pawns & one != 0, one, np.where(a.occupied[i] & one == 0, two, ZERO)) & pawns
        slant = PAWN_FROM[1 - turn, t] & pawns
        # a file before the square means a capture, even if the sign is left out
        sideways = takes & ((file[i] == NONE) | (file[i] != (t & 7)))
        mine[i] = np.where(has(a.occupied[i], t) | sideways, np.where(takes, slant, ZERO), steps)
        mine[i] = np.where(sideways & ~theirs & (file[i] == NONE), steps | slant, mine[i])
    mine &= np.where(file != NONE, U(0x0101010101010101) << np.maximum(file, 0).astype(U), U(0xFFFFFFFFFFFFFFFF))
    mine &= np.where(rank != NONE, U(0xFF) << (8 * np.maximum(rank, 0)).astype(U), U(0xFFFFFFFFFFFFFFFF))
    mine = np.where(has(a.ours, target) & ~castling, ZERO, mine)
    found = np.zeros(n, np.int64)
    left = np.flatnonzero(mine)
    while len(left):
        s = a.sub(left)
        sq = lowest(mine[left])
        t = target[left]
        taking = (role[left] == PAWN) & ((sq & 7) != (t & 7)) & ~has(s.occupied, t)
        captured = np.where(taking, bit((sq & 56) | (t & 7)), np.where(has(s.theirs, t), bit(t), ZERO))
        after = ((s.occupied ^ bit(sq)) & ~captured) | bit(t)
        king = np.where(role[left] == KING, t, s.king)
        legal = s.attackers(king, after, captured) == 0
        start[left[legal]], passing[left[legal]] = sq[legal], taking[legal]
        found[left] += legal
        mine[left] &= mine[left] - ONE
        left = left[mine[left] != 0]
    if castling.any():
        i = np.flatnonzero(castling)
        s = a.sub(i)
        rooks = s.castles()
        side = np.where(castle[i] == 1, ~((bit(s.king) << ONE) - ONE), bit(s.king) - ONE)
        rooks &= side
        rook[i] = np.where(rooks != 0, lowest(rooks) & 63, NONE)
        start[i], found[i] = s.king, np.bitwise_count(rooks)
        target = np.where(castling, rook, target)
    last = (role == PAWN) & ((EDGE_ROWS >> np.maximum(target, 0).astype(U)) & ONE).astype(bool)
    failed = (found != 1) | (last != (promotion >= 0)) | (promotion == KING)
    code = cells[np.arange(n), np.maximum(target, 0)].astype(np.int64)
    capture = np.where(castling, NONE, np.where(passing, PAWN, np.where(code > 0, (code - 1) % 6, NONE)))
    return start, np.maximum(target, 0), role, promotion, capture, rook, passing, failed


_CODE = {QUEEN: 0, ROOK: 1, 2: 2, 1: 3}


def resolve(lines: list[Line], starts: Positions) -> list[bool]:
    """Plays lines from their positions, variations too; fills ``done`` up to the first illegal move. Returns which main lines are whole."""
    wave, p, whole = lines, starts, [True] * len(lines)
    first = True
    while wave:
        board = _Board(p.take(np.arange(len(wave))))
        who = np.arange(len(wave))
        later: list[Line] = []
        bases: list[Positions] = []
        t = 0
        while True:
            on = np.array([t < len(wave[g].sans) for g in who], bool)
            if not on.any():
                break
            if not on.all():
                board.keep(on)
                who = who[on]
            want = np.array([wave[g].sans[t] for g in who], np.int64)
            start, to, role, promotion, capture, rook, passing, failed = find_moves(board.p, board.cells, want)
            if failed.any():
                if first:
                    for g in who[failed]:
                        whole[g] = False
                good = ~failed
                board.keep(good)
                who, start, to, role, promotion, capture, rook, passing = (x[good] for x in (who, start, to, role, promotion, capture, rook, passing))
                if not len(who):
                    break
            branches = [(i, x) for i, g in enumerate(who) for x in wave[g].hanging.get(t, [])]
            if branches:
                later += [x for _, x in branches]
                bases.append(board.p.take(np.array([i for i, _ in branches])))
            for i, g in enumerate(who):
                a = int(start[i]) | (0x80 if capture[i] >= 0 else 0) | (0x40 if promotion[i] >= 0 else 0)
                wave[g].done.append(bytes([a, int(to[i]) | (_CODE[int(promotion[i])] << 6 if promotion[i] >= 0 else 0)]))
            board.play(start, to, promotion, rook, passing, role, capture)
            t += 1
        first = False
        wave = later
        if bases:
            p = Positions(np.concatenate([b.boards for b in bases], axis=1), *[np.concatenate([getattr(b, n) for b in bases]) for n in ("turn", "castling", "ep", "half", "full")])
    return whole


def encoded(line: Line) -> bytes:
    out = bytearray()
    for k, move in enumerate(line.done):
        out += move
        for child in line.hanging.get(k, []):
            if child.done:
                out += b"\xff\xff" + encoded(child) + b"\xff\xfe"
    return bytes(out)


def _filled(found: list[tuple[int, int]], step: int) -> list[int] | None:
    """Values by ply; gaps are filled with the value before, or 0."""
    out: list[int] = []
    index = 1
    for ply, value in found:
        gap = (ply - index) // step
        if gap < 0 or value is None:
            continue
        out += [out[-1] if out else 0] * gap + [value]
        index = ply + step
    return out or None


def parse_games(texts: list[str], level: int = LOW, bad_moves: str = "truncate") -> list[tuple]:
    """Rows of SCHEMA. A game with an invalid FEN has no moves and says so; so does one that an illegal move ends early."""
    parsed = [parse_text(t, level == LOW) for t in texts]
    states = [parse_fen(x[0]["FEN"]) if "FEN" in x[0] else START for x in parsed]
    whole = resolve([x[1] if s else Line() for x, s in zip(parsed, states)], to_positions([s or START for s in states])) if texts else []
    blobs: list[bytes | None] = [encoded(x[1]) + b"\0" if s else None for x, s in zip(parsed, states)]
    if level == MEDIUM:
        plain = [i for i, x in enumerate(parsed) if "FEN" not in x[0]]
        for i, b in zip(plain, recompress([blobs[i] for i in plain], MEDIUM)[0]):
            blobs[i] = b
    rows = []
    for (tags, main, comments, wrong), state, complete, blob in zip(parsed, states, whole, blobs):
        error = "invalid FEN" if state is None else wrong if wrong else None if complete else f"illegal move at ply {len(main.done) + 1}"
        if error and bad_moves == "fail":
            raise ValueError(error)
        evals, white, black = [], [], []
        for ply, text in comments:
            if not 0 < ply <= len(main.done):
                continue
            if m := _EVAL.search(text):
                evals.append((ply, parse_eval(m[1])))
            if m := _CLOCK.search(text):
                seconds = int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])
                (white if ply % 2 else black).append((ply, seconds if seconds <= 65535 else None))
        rating = [int(tags[k]) if re.fullmatch(r"-?\d{1,5}", tags.get(k, "")) and abs(int(tags[k])) < 32768 else None for k in ("WhiteElo", "BlackElo")]
        get = {to: tags.get(k) for k, to in _TAGS.items()}
        when = parse_time(tags.get("UTCDate", tags.get("Date")), tags.get("UTCTime", tags.get("Time")))
        rows.append((
            get["event"], get["site"], get["round"], get["fen"], get["white"], get["black"], *rating, get["white_title"], get["black_title"], _filled(white, 2), _filled([(p - 1, v) for p, v in black], 2), _filled(evals, 1),
            get["result"], get["time_control"], len(main.done), when, blob, error,
        ))
    return rows


def from_texts(texts: DataFrame, column: str = "value", level: int = LOW, bad_moves: str = "truncate", batch: int = 1000) -> DataFrame:
    """Games of a column that holds the text of one game a row; rows without tags and moves are left out."""
    if level not in (LOW, MEDIUM) or bad_moves not in ("truncate", "fail"):
        raise ValueError("level must be 0 or 1, bad_moves truncate or fail")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [t for t in frame["value"] if isinstance(t, str) and t.strip()]
            for k in range(0, len(values), batch):
                rows = parse_games(values[k : k + batch], level, bad_moves)
                out = pd.DataFrame(rows, columns=names, dtype=object)
                out["utc_timestamp"] = pd.to_datetime(out["utc_timestamp"], errors="coerce")
                yield out

    return texts.select(F.col(column).alias("value")).mapInPandas(parse, SCHEMA)


def pgn_to_movedata(text: Column | str, level: int = LOW, bad_moves: str = "truncate") -> Column:
    """The compact moves of the one game in each text; null for null and blank texts and for games that can't be stored at this level."""
    if level not in (LOW, MEDIUM) or bad_moves not in ("truncate", "fail"):
        raise ValueError("level must be 0 or 1, bad_moves truncate or fail")
    at = [c.split()[0] for c in SCHEMA.split(", ")].index("movedata")

    @F.arrow_udf(returnType="binary")
    def convert(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        there = [i for i, t in enumerate(values) if t is not None and t.strip()]
        rows = parse_games([values[i] for i in there], level, bad_moves)
        if len(rows) < len(there):
            rows = [(parse_games([values[i]], level, bad_moves) or [None])[0] for i in there]
        out: list = [None] * len(values)
        for i, r in zip(there, rows):
            out[i] = r and r[at]
        return pa.array(out, pa.binary())

    return convert(F.col(text) if isinstance(text, str) else text)


def read_pgn(spark: SparkSession, path: str, level: int = LOW, bad_moves: str = "truncate", min_timestamp: int | None = None) -> DataFrame:
    """Games of the PGN files under ``path``, plain and ``.zst`` ones side by side. min_timestamp: seconds; older games are left out, undated ones stay.

    Plain files are split among tasks. A ``.zst`` file can't be split and is one task, which unpacks it as a stream from wherever the
    executors can read it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    packed = files.where(F.lower("path").endswith(".zst"))
    n = packed.count()
    texts = packed.repartition(max(1, min(n, 100_000))).mapInPandas(_unpack, "value string")
    plain = [path] if not n else [r.path for r in files.where(~F.lower("path").endswith(".zst")).collect()]
    if plain:
        mark = "\n[Event "
        lines = spark.read.option("lineSep", mark).text(plain)
        split = lines.select(F.when(F.ltrim("value").startswith("[") | (F.trim("value") == ""), F.col("value")).otherwise(F.concat(F.lit("[Event "), F.col("value"))).alias("value"))
        texts = texts.unionAll(split) if n else split
    games = from_texts(texts, level=level, bad_moves=bad_moves)
    if min_timestamp is not None:
        games = games.where(F.col("utc_timestamp").isNull() | (F.col("utc_timestamp") >= F.timestamp_seconds(F.lit(min_timestamp)).cast("timestamp_ntz")))
    return games


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io
    from urllib.parse import unquote, urlparse

    import zstandard
    from pyarrow import fs

    for frame in frames:
        for path in frame["path"]:
            where, name = (fs.LocalFileSystem(), unquote(urlparse(path).path)) if path.startswith("file:") else fs.FileSystem.from_uri(path)
            with where.open_input_stream(name, compression=None) as f:
                reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True), "utf-8", "replace")
                games: list[str] = []
                lines: list[str] = []
                for line in reader:
                    if line.startswith("[Event ") and lines:
                        games.append("".join(lines))
                        lines = []
                        if len(games) >= 1000:
                            yield pd.DataFrame({"value": games})
                            games = []
                    lines.append(line)
                if lines:
                    games.append("".join(lines))
                yield pd.DataFrame({"value": games})


def write_games(games: DataFrame, path: str, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Games as Parquet."""
    games.write.mode(mode).option("compression", compression).parquet(path)


def to_pgn_text(games: DataFrame) -> DataFrame:
    """A column ``pgn``: tags and numbered moves of each game of the importer's layout."""
    from rookery.operators.columns import call

    tag = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'[{name} "'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"]\n'))).otherwise(F.lit(""))
    head = F.concat(*[tag(k, v) for k, v in (("Event", "event"), ("Site", "site"), ("Round", "round"), ("White", "white"), ("Black", "black"), ("Result", "result"), ("WhiteElo", "white_rating"), ("BlackElo", "black_rating"), ("TimeControl", "time_control"), ("FEN", "fen"))])
    return games.select(F.concat(head, F.lit("\n"), call("to_pgn", "movedata", None, "fen"), F.lit(" "), F.coalesce("result", F.lit("*")), F.lit("\n\n")).alias("pgn"))
