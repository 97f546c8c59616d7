"""Functions over games as DataFrame columns.

Each takes a column of compact move strings and, where it says so, a FEN that the game
starts from. A batch of games is decoded together in one Arrow function; nothing else of the row
passes through Python. Nulls give nulls. A string that can't be decoded is an error; the ``try_`` form
of each function gives null instead.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rookery.functions import codec, notation, scalars
from rookery.functions.bits import Attacks, legal_ep
from rookery.functions.fen import LETTERS, NAMES, fens, parse_board, parse_fen
from rookery.functions.games import HIGH, NONE, OK, UNSUPPORTED, Games, decode
from rookery.functions.patterns import PatternError, Plies, parse_pattern, search, superset

_COUNTS = ["wQ", "wR", "wB", "wN", "wP", "bQ", "bR", "bB", "bN", "bP"]
_COUNT_BOARDS = [4, 3, 2, 1, 0, 10, 9, 8, 7, 6]
_DETAILS = "ply:int,role:string,`from`:string,`to`:string,promotion:string,capture:string,is_castle:boolean,is_en_passant:boolean,is_check:boolean,is_checkmate:boolean"
_DETAILS_EXT = _DETAILS + ",is_stalemate:boolean,legal_response_move_count:short"
_BY_FILE = sorted(range(64), key=lambda s: NAMES[s])
_CELLS = pa.array(["", *LETTERS])




def _fail(name: str, error: np.ndarray) -> None:
    code = int(error.max())
    what = "failed to decode movedata (error code %d)" % code if code != UNSUPPORTED else "movedata of compression level 2 is not supported"
    raise ValueError(f"{name} - {what}")


def _masked(array: pa.Array, null: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(~null), array, pa.nulls(len(array), array.type)) if null.any() else array


def _all_errors(games: Games) -> np.ndarray:
    return np.maximum(games.error, 0)


#: Bytes of decoded games that a worker keeps for the other functions of the same batch.
KEPT_BYTES = 192 << 20
_kept: OrderedDict[bytes, tuple[int, Games]] = OrderedDict()
#: The task, and which uses of functions in its projection have had the batch that is kept.
_task: int | None = None
_had: set[object] = set()


def _begin(use: object) -> None:
    """Lets the games of the batch before go: a function that is called again, or a new task, has another one."""
    global _task
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if use in _had or task != _task:
        _kept.clear()
        _had.clear()
        _task = task
    _had.add(use)


def _key(*columns: pa.Array) -> bytes:
    """A hash of the values of these columns."""
    h = blake2b(digest_size=16)
    for x in columns:
        h.update(np.array([len(x), x.null_count], np.int64))
        if not len(x) or x.null_count == len(x):
            continue
        if x.null_count:
            h.update(x.is_valid().to_numpy(zero_copy_only=False))
            x = pc.fill_null(x, b"" if pa.types.is_binary(x.type) else "")
        off = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        h.update(off - off[0])
        if off[-1] > off[0]:
            h.update(x.buffers()[2][int(off[0]) : int(off[-1])])
    return h.digest()


def _decoded(blobs: pa.Array, fens_: pa.Array, limit: int | None = None, until: Callable | None = None) -> Games:
    """The games of a batch; whole ones are kept, so that several functions of one batch decode it once."""
    key = _key(blobs, fens_) if all(x.type in (pa.binary(), pa.string()) for x in (blobs, fens_)) else None
    if key in _kept:
        _kept.move_to_end(key)
        return _kept[key][1]
    games = decode(blobs.to_pylist(), fens_.to_pylist() if fens_.null_count < len(fens_) else None, limit, until)
    if key is not None and limit is None and until is None:
        arrays = [*vars(games.positions).values(), *vars(games.moves).values(), games.plies, games.error, games.level]
        for x in arrays:
            x.flags.writeable = False
        _kept[key] = sum(x.nbytes for x in arrays), games
        while sum(n for n, _ in _kept.values()) > KEPT_BYTES:
            _kept.popitem(last=False)
    return games


def _at(blobs: pa.Array, positions: pa.Array, fens_: pa.Array) -> tuple[Games, np.ndarray, np.ndarray, np.ndarray]:
    """Games, the index of the position that each row asks for, which rows are null, and errors."""
    pos = pc.fill_null(positions, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    limit = int(pos.max(initial=0)) if (pos >= 0).all() else None
    games = _decoded(blobs, fens_, limit)
    null = positions.is_null().to_numpy(zero_copy_only=False) | (games.error == NONE)
    index = np.where(pos >= 0, pos, games.plies + pos + 1)
    failed = (games.error > OK) & ((pos < 0) | (index > games.plies) | (games.lacking & ~((games.error == UNSUPPORTED) & (pos == 0))))
    out_of_range = np.where(pos >= 0, index > games.plies, games.plies + pos < 0)
    error = np.where(failed & ~null, games.error, 0)
    null |= out_of_range | failed
    return games, np.where(null, 0, games.at + index), null, error


def _fen_at(blobs, positions, fens_):
    games, at, null, error = _at(blobs, positions, fens_)
    texts = iter(fens(games.positions.take(at[~null])))
    return pa.array([None if x else next(texts) for x in null], pa.string()), error


def _board_at(blobs, positions, fens_):
    games, at, null, error = _at(blobs, positions, fens_)
    cells = np.zeros((len(at), 64), np.int8)
    cells[~null] = games.positions.take(at[~null]).mailbox()
    return pa.StructArray.from_arrays([_CELLS.take(pa.array(cells[:, s])) for s in range(64)], names=NAMES, mask=pa.array(null)), error


def _pieces_at(blobs, positions, fens_):
    games, at, null, error = _at(blobs, positions, fens_)
    cells = np.zeros((len(at), 64), np.int8)
    cells[~null] = games.positions.take(at[~null]).mailbox()
    cells = cells[:, _BY_FILE]
    names = pa.array([NAMES[s] for s in _BY_FILE])
    arrays, labels = [], []
    for side in (0, 1):
        for role in (5, 4, 3, 2, 1, 0):
            hit = cells == 1 + 6 * side + role
            n = hit.sum(axis=1)
            found = names.take(pa.array(np.nonzero(hit)[1]))
            labels.append("wb"[side] + "PNBRQK"[role])
            if role == 5:
                first = np.where(n > 0, hit.argmax(axis=1), 64)
                arrays.append(pa.concat_arrays([names, pa.array([""])]).take(pa.array(first)))
            else:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), found))
    return pa.StructArray.from_arrays(arrays, names=labels, mask=pa.array(null)), error


def _counts_at(blobs, positions, fens_):
    games, at, null, error = _at(blobs, positions, fens_)
    counts = np.zeros((12, len(at)), np.int16)
    counts[:, ~null] = np.bitwise_count(games.positions.boards[:, at[~null]])
    return pa.StructArray.from_arrays([pa.array(counts[b]) for b in _COUNT_BOARDS], names=_COUNTS, mask=pa.array(null)), error


def _details(games: Games, ext: bool) -> pa.StructArray:
    mv = games.moves
    game = np.repeat(np.arange(len(games.plies)), games.plies)
    ply = (np.arange(len(game)) - games.move_at[game]).astype(np.int32)
    check, mate, count = notation.checks(games, ext)
    letters = pa.array([*notation.ROLE_LETTERS, ""])
    squares = pa.array(NAMES)
    arrays = [
        pa.array(ply), letters.take(pa.array(mv.role)), squares.take(pa.array(mv.start)), squares.take(pa.array(mv.to)),
        letters.take(pa.array(np.where(mv.promotion >= 0, mv.promotion, 6))), letters.take(pa.array(np.where(mv.capture >= 0, mv.capture, 6))),
        pa.array(mv.rook >= 0), pa.array(mv.ep), pa.array(check), pa.array(mate),
    ]
    names = ["ply", "role", "from", "to", "promotion", "capture", "is_castle", "is_en_passant", "is_check", "is_checkmate"]
    if ext:
        arrays += [pa.array(~check & (count == 0)), pa.array(count.astype(np.int16))]
        names += ["is_stalemate", "legal_response_move_count"]
    return pa.StructArray.from_arrays(arrays, names=names)


def _lists(values: pa.Array, games: Games, null: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(games.plies)]).astype(np.int32)
    if null.any():
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), values)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _whole(make: Callable[[Games], pa.Array]):
    """A function of whole games to lists, one value a move."""

    def run(blobs, fens_):
        games = _decoded(blobs, fens_)
        return _lists(make(games), games, games.error != OK), _all_errors(games)

    return run


def _details_at(ext: bool):
    def run(blobs, positions, fens_):
        pos = pc.fill_null(positions, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        limit = int(pos.max(initial=0)) + 1 if (pos >= 0).all() else None
        games = _decoded(blobs, fens_, limit)
        null = positions.is_null().to_numpy(zero_copy_only=False) | (games.error == NONE)
        index = np.where(pos >= 0, pos, games.plies + pos)
        failed = (games.error > OK) & ((pos < 0) | (index >= games.plies)) & ~null
        null |= failed | (index < 0) | (index >= games.plies)
        # keep only the moves asked for, and the positions around them
        at = games.move_at + index
        only = _picked(games, at, ~null)
        values = _details(only, ext)
        if len(values):
            values = pa.StructArray.from_arrays([pa.array(index[~null].astype(np.int32)), *[values.field(k) for k in range(1, values.type.num_fields)]], names=[f.name for f in values.type])
        where = np.where(null, 0, np.cumsum(~null) - 1)
        out = values.take(pa.array(where, mask=null)) if len(values) else pa.nulls(len(null), values.type)
        return out, np.where(failed, games.error, 0)

    return run


def _picked(games: Games, move: np.ndarray, rows: np.ndarray) -> Games:
    """Games of one move each: those of some rows."""
    m = move[rows]
    at = (games.at - games.move_at + move)[rows]
    n = len(m)
    both = np.stack([at, at + 1], axis=1).ravel()
    out = Games(games.positions.take(both), games.moves.take(m), np.ones(n, np.int64), np.zeros(n, np.int64), games.level[rows])
    return out


def _joined(make: Callable[[Games], pa.Array], separator: str):
    def run(blobs, fens_):
        games = _decoded(blobs, fens_)
        return pc.binary_join(_lists(make(games), games, games.error != OK), separator), _all_errors(games)

    return run


def _moved(games: Games) -> pa.Array:
    game = np.repeat(np.arange(len(games.plies)), games.plies)
    odd = (np.arange(len(game)) - games.move_at[game]) & 1
    return pa.array([*LETTERS]).take(pa.array(games.moves.role + 6 * odd))


def _pgn(blobs, fens_):
    raw = blobs.to_pylist()
    tree = [notation.has_variations(b) for b in raw]
    games = decode([None if t else b for b, t in zip(raw, tree)], fens_.to_pylist()) if any(tree) else _decoded(blobs, fens_)
    error = _all_errors(games)
    game = np.repeat(np.arange(len(games.plies)), games.plies)
    ply = np.arange(len(game)) - games.move_at[game]
    number = pc.if_else(pa.array(ply % 2 == 0), pc.binary_join_element_wise(pa.array(ply // 2 + 1).cast(pa.string()), pa.array([". "] * len(ply), pa.string()), ""), "")
    values = pc.binary_join_element_wise(number, notation.san_moves(games), "")
    out = pc.binary_join(_lists(values, games, games.error != OK), " ").to_pylist()
    for g in np.flatnonzero(tree):
        out[g], error[g] = notation.pgn_with_variations(raw[g], fens_[g].as_py())
    return pa.array(out, pa.string()), error


def _first(hit: np.ndarray, x: Plies, n: int) -> np.ndarray:
    """The first ply of each game that is hit, or a large number."""
    out = np.full(n, 1 << 40, np.int64)
    np.minimum.at(out, x.game[hit], x.ply[hit])
    return out


def _subfen(masks: list[int]):
    def run(blobs, fens_):
        games = _decoded(blobs, fens_, until=lambda p: superset(p, masks))
        x = Plies(games)
        found = _first(superset(games.positions, masks) & (x.ply > 0), x, len(games.plies)) < 1 << 40
        error = np.where(found, 0, _all_errors(games))
        return pa.array(found, mask=(games.error == NONE) | (error > 0)), error

    return run


def _exact(state: tuple | None, ply_wanted: bool):
    """Search for a whole position. A game whose pawns have left a home square that the target needs is given up there."""
    boards, turn, rights, ep = state[0], state[1], state[2], state[3]
    home = (np.uint64(boards[0] & 0xFF00), np.uint64(boards[6] & 0xFF000000000000))

    def same(p) -> np.ndarray:
        hit = (p.turn == turn) & (p.castling == np.uint64(rights))
        for k in range(12):
            hit &= p.boards[k] == np.uint64(boards[k])
        at = np.flatnonzero(hit)
        if len(at):
            hit[at] = legal_ep(Attacks(p.take(at))) == ep
        return hit

    def left(p) -> np.ndarray:
        return ((home[0] & ~p.boards[0]) | (home[1] & ~p.boards[6])) != 0

    def run(blobs, fens_):
        games = _decoded(blobs, fens_, until=lambda p: same(p) | left(p))
        n = len(games.plies)
        x = Plies(games)
        hit, lost = same(games.positions), left(games.positions) & (x.ply > 0)
        first, given_up = _first(hit, x, n), _first(lost, x, n)
        found = (first < 1 << 40) & (first <= given_up)
        error = np.where(found | (given_up < 1 << 40), 0, _all_errors(games))
        null = (games.error == NONE) | (error > 0)
        if ply_wanted:
            return pa.array(np.where(found, first, 0).astype(np.int32), mask=null | ~found), error
        return pa.array(found, mask=null), error

    return run


def _pattern(pattern, plies: bool):
    def run(blobs, fens_):
        games = _decoded(blobs, fens_)
        found = search(pattern, games)
        ok = np.array([x is not None for x in found], bool)
        error = np.where(ok, 0, _all_errors(games))
        null = (games.error == NONE) | (error > 0)
        if plies:
            return pa.array([None if z else x or [] for x, z in zip(found, null)], pa.list_(pa.int32())), error
        return pa.array(ok, mask=null), error

    return run


def _valid(blobs, fens_):
    games = _decoded(blobs, fens_)
    high = games.error == UNSUPPORTED
    return pa.array(games.error == OK, mask=(games.error == NONE) | high), np.where(high, UNSUPPORTED, 0)


def _recompress(blobs, levels, fens_):
    raw, want = blobs.to_pylist(), levels.to_pylist()
    out: list = [None] * len(raw)
    error = np.zeros(len(raw), np.int64)
    for level in sorted({x for x in want if x is not None}):
        rows = [i for i, x in enumerate(want) if x == level and raw[i] is not None]
        if not rows:
            continue
        if level not in (0, 1):
            if level != HIGH:
                raise ValueError("recompress - invalid compression level")
            error[rows] = UNSUPPORTED
            continue
        got, bad = codec.recompress([raw[i] for i in rows], level)
        for i, blob, e in zip(rows, got, bad):
            out[i], error[i] = blob, e
    return pa.array([None if e else b for b, e in zip(out, error)], pa.binary()), error


def _plies(blobs, fens_):
    """Every position with its outgoing move, for use by built-in expressions."""
    games = _decoded(blobs, fens_)
    x = Plies(games)
    p, mv = games.positions, games.moves
    letters, squares = pa.array([*notation.ROLE_LETTERS]), pa.array(NAMES)

    def move(name: str, table: pa.Array | None = None) -> pa.Array:
        values = x.move(name)
        if values.dtype == bool:
            return pa.array(values, mask=x.last)
        none = x.last | (values < 0)
        return table.take(pa.array(np.where(none, 0, values), mask=none))

    arrays = [pa.array(x.ply.astype(np.int32)), *[pa.array(b.view(np.int64)) for b in p.boards]]
    arrays += [pa.array(p.turn == 0), pa.array(p.castling.view(np.int64)), pa.array(p.ep.astype(np.int32)), pa.array(p.half.astype(np.int32)), pa.array(p.full.astype(np.int32))]
    arrays += [move("role", letters), move("start", squares), move("to", squares), move("promotion", letters), move("capture", letters), pa.array(x.move("rook") >= 0, mask=x.last), move("ep")]
    values = pa.StructArray.from_arrays(arrays, names=[c.split(":")[0].strip("`") for c in _PLY.split(",")])
    n = np.bincount(x.game, minlength=len(games.plies))
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    bad = games.error != OK
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(bad, False)) if bad.any() else pa.array(offsets), values), _all_errors(games)


_PLY = "ply:int," + ",".join(f"{s}{r}:long" for s in "wb" for r in "PNBRQK") + ",white_to_move:boolean,castling:long,ep:int,half:int,full:int,role:string,`from`:string,`to`:string,promotion:string,capture:string,is_castle:boolean,is_en_passant:boolean"
_BOARD = "struct<" + ",".join(f"{s}:string" for s in NAMES) + ">"
_PIECES = "struct<" + ",".join(f"{s}{r}:" + ("string" if r == "K" else "array<string>") for s in "wb" for r in "KQRBNP") + ">"

#: name: (result type, arguments besides the moves and the FEN, implementation)
_BLOB_FUNCTIONS: dict[str, tuple[str, int, Callable]] = {
    "fen_at_position": ("string", 1, _fen_at),
    "board_at_position": (_BOARD, 1, _board_at),
    "pieces_at_position": (_PIECES, 1, _pieces_at),
    "piece_counts_at_position": ("struct<" + ",".join(f"{c}:short" for c in _COUNTS) + ">", 1, _counts_at),
    "move_details": (f"array<struct<{_DETAILS}>>", 0, _whole(lambda g: _details(g, False))),
    "move_details_ext": (f"array<struct<{_DETAILS_EXT}>>", 0, _whole(lambda g: _details(g, True))),
    "move_details_at": (f"struct<{_DETAILS}>", 1, _details_at(False)),
    "move_details_ext_at": (f"struct<{_DETAILS_EXT}>", 1, _details_at(True)),
    "moved_pieces": ("string", 0, _joined(_moved, "")),
    "moved_pieces_list": ("array<string>", 0, _whole(_moved)),
    "to_uci": ("string", 0, _joined(notation.uci_moves, " ")),
    "to_pgn": ("string", 0, _pgn),
    "is_valid_movedata": ("boolean", 0, _valid),
    "recompress": ("binary", 1, _recompress),
    "plies": (f"array<struct<{_PLY}>>", 0, _plies),
}
_PATTERN_FUNCTIONS: dict[str, str] = {"matches_subfen": "boolean", "matches_fen": "boolean", "matches_fen_ply": "int", "scoutfish_query": "boolean", "scoutfish_query_plies": "array<int>"}


#: Games decoded at a time, which bounds a worker's memory whatever the batch.
GAMES_AT_A_TIME = 2000


def _run(name: str, tried: bool, run: Callable, use: object, *arguments: pa.Array) -> pa.Array:
    """The function's values of one batch; use: tells this use of the function in a plan from others."""
    _begin(use)
    out = []
    for k in range(0, max(1, len(arguments[0])), GAMES_AT_A_TIME):
        array, error = run(*[a.slice(k, GAMES_AT_A_TIME) for a in arguments])
        if not tried and (error > 0).any():
            _fail(name, error)
        out.append(array)
    return out[0] if len(out) == 1 else pa.concat_arrays(out)


def _udf(name: str, tried: bool):
    kind, extra, run = _BLOB_FUNCTIONS[name]
    use = object()
    if extra:

        def two(blobs: pa.Array, argument: pa.Array, fens_: pa.Array) -> pa.Array:
            return _run(name, tried, run, use, blobs, argument, fens_)

        return F.arrow_udf(two, returnType=kind)

    def one(blobs: pa.Array, fens_: pa.Array) -> pa.Array:
        return _run(name, tried, run, use, blobs, fens_)

    return F.arrow_udf(one, returnType=kind)


def _pattern_run(name: str, text: str) -> Callable:
    if name.startswith("scoutfish"):
        return _pattern(parse_pattern(text), name.endswith("plies"))
    if name == "matches_subfen":
        boards = parse_board(text.split(" ")[0])
        if boards is None:
            raise ValueError(f"{name} - invalid sub-FEN")
        return _subfen([sum(boards[:6]), sum(boards[6:]), *[boards[r] | boards[6 + r] for r in range(6)]])
    state = parse_fen(text, False)
    if state is None:
        raise ValueError(f"{name} - invalid FEN")
    if state[3] >= 0:
        # the target's en-passant square counts only if it can be taken
        from rookery.functions.fen import to_positions

        ep = int(legal_ep(Attacks(to_positions([state])))[0])
        state = (*state[:3], ep, *state[4:])
    return _exact(state, name.endswith("ply"))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fen(x: Column | str | None) -> Column:
    return F.lit(None).cast("string") if x is None else _col(x).cast("string")


def call(name: str, movedata: Column | str, argument=None, initial_fen: Column | str | None = None, tried: bool = False) -> Column:
    """Applies a function by name; the named functions below are short for it."""
    blob = _col(movedata).cast("binary")
    if name in _PATTERN_FUNCTIONS:
        kind = _PATTERN_FUNCTIONS[name]
        if argument is None:
            return F.lit(None).cast(kind)
        if not isinstance(argument, str):
            raise TypeError(f"{name} - the pattern must be a constant string")
        run, use = _pattern_run(name, argument), object()

        def match(blobs: pa.Array, fens_: pa.Array) -> pa.Array:
            return _run(name, tried, run, use, blobs, fens_)

        return F.arrow_udf(match, returnType=kind)(blob, _fen(initial_fen))
    extra = _BLOB_FUNCTIONS[name][1]
    if extra:
        value = F.lit(argument) if isinstance(argument, int) or argument is None else _col(argument)
        return _udf(name, tried)(blob, value.cast("int"), _fen(initial_fen))
    return _udf(name, tried)(blob, _fen(initial_fen))


def _public(name: str, tried: bool) -> Callable[..., Column]:
    extra = name in _PATTERN_FUNCTIONS or _BLOB_FUNCTIONS[name][1]
    if extra:

        def f(movedata: Column | str, argument, initial_fen: Column | str | None = None) -> Column:
            return call(name, movedata, argument, initial_fen, tried)

    else:

        def f(movedata: Column | str, initial_fen: Column | str | None = None) -> Column:
            return call(name, movedata, None, initial_fen, tried)

    f.__name__ = f.__qualname__ = ("try_" if tried else "") + name
    return f


for _name in (*_BLOB_FUNCTIONS, *_PATTERN_FUNCTIONS):
    for _tried in (False, True):
        globals()[("try_" if _tried else "") + _name] = _public(_name, _tried)
FUNCTION_NAMES = [*_BLOB_FUNCTIONS, *_PATTERN_FUNCTIONS]


def with_plies(games: DataFrame, movedata: str = "movedata", name: str = "plies", initial_fen: Column | str | None = None, where: Column | None = None) -> DataFrame:
    """``games`` with all plies of each game, decoded once whatever is then done with them.

    Filters on the plies aren't moved below the decoding, where they would decode a second time; nor are
    those on other columns, so these belong in ``where``, which is applied before and reaches the scan.
    """
    kept = games if where is None else games.where(where)
    run = _udf("plies", False).asNondeterministic()
    return kept.withColumn(name, run(_col(movedata).cast("binary"), _fen(initial_fen)))


@F.arrow_udf(returnType=BinaryType())
def _encode(moves: pa.Array) -> pa.Array:
    return pa.array([codec.moves_to_low(m) for m in moves.to_pylist()], pa.binary())


def encode_moves(moves: Column | str) -> Column:
    """A compact string of an array of moves in UCI; the moves are not checked. Malformed moves give null."""
    return _encode(_col(moves))


def compression_level(movedata: Column | str) -> Column:
    """0 to 2, null if there is none."""
    blob = _col(movedata).cast("binary")
    last = F.conv(F.hex(F.substring(blob, -1, 1)), 16, 10).cast("int")
    return F.when((F.length(blob) > 0) & (last < 192), F.shiftright(last, 6))


def register(spark: SparkSession) -> None:
    """Makes all functions callable from SQL, the scalar ones as SQL functions, those of games in both forms.

    A trailing FEN is optional. In SQL a pattern may be any expression, but must have one value in a batch.
    """
    for name in FUNCTION_NAMES:
        for tried in (False, True):
            spark.udf.register(("try_" if tried else "") + name, _sql_udf(name, tried))
    spark.udf.register("encode_moves", _encode)
    bodies = {n: b for n, (_, _, b) in scalars.SQL_FUNCTIONS.items()}
    for name, (parameters, kind, body) in scalars.SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body.format(**bodies) if '{' in body else body}")


def _sql_udf(name: str, tried: bool):
    use = object()
    if name in _PATTERN_FUNCTIONS:
        kind = _PATTERN_FUNCTIONS[name]

        def match(*arguments: pa.Array) -> pa.Array:
            blobs, texts = arguments[0], arguments[1]
            fens_ = arguments[2] if len(arguments) > 2 else pa.nulls(len(blobs), pa.string())
            distinct = texts.unique().to_pylist()
            if len(distinct) > 1:
                raise ValueError(f"{name} - the pattern must be constant")
            if not distinct or distinct[0] is None:
                return pa.nulls(len(blobs), {"boolean": pa.bool_(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}[kind])
            return _run(name, tried, _pattern_run(name, distinct[0]), use, blobs, fens_)

        return F.arrow_udf(match, returnType=kind)
    kind, extra, run = _BLOB_FUNCTIONS[name]

    def apply(*arguments: pa.Array) -> pa.Array:
        blobs = arguments[0]
        fens_ = arguments[1 + extra] if len(arguments) > 1 + extra else pa.nulls(len(blobs), pa.string())
        return _run(name, tried, run, use, blobs, arguments[1], fens_) if extra else _run(name, tried, run, use, blobs, fens_)

    return F.arrow_udf(apply, returnType=kind)
