"""Moves as text: UCI, SAN, and numbered move text with variations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bits import ALL, BISHOP, KING, KNIGHT, LINE, ONE, PAWN, QUEEN, ROOK, Attacks, bit, has, lowest, piece_from
from .fen import NAMES
from .games import BAD_DATA, LOW, OK, Games, decode

_SQUARES = pa.array([*NAMES, ""])
_FILES, _RANKS = pa.array([*"abcdefgh", ""]), pa.array([*"12345678", ""])
ROLE_LETTERS = "pnbrqk"
_UPPER = pa.array(["", "N", "B", "R", "Q", "K"])
_EMPTY = 64


def _pick(table: pa.Array, at: np.ndarray) -> pa.Array:
    return table.take(pa.array(at))


def _join(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def after(games: Games) -> np.ndarray:
    """The position that each move leads to."""
    return games.before() + 1


def checks(games: Games, replies: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each move: whether it gives check, whether mate, and the number of replies (-1 where it wasn't needed)."""
    a = Attacks(games.positions.take(after(games)))
    check = a.checkers != 0
    count = np.full(len(check), -1, np.int64)
    at = np.arange(len(check)) if replies else np.flatnonzero(check)
    if len(at):
        count[at] = a.sub(at).replies()
    return check, check & (count == 0), count


def uci_moves(games: Games) -> pa.Array:
    mv = games.moves
    promotion = _pick(pa.array([*ROLE_LETTERS, ""]), np.where(mv.promotion >= 0, mv.promotion, 6))
    return _join(_pick(_SQUARES, mv.start), _pick(_SQUARES, mv.to), promotion)


def san_moves(games: Games) -> pa.Array:
    mv = games.moves
    n = len(mv.start)
    if not n:
        return pa.array([], pa.string())
    before = games.positions.take(games.before())
    a = Attacks(before)
    file_needed, rank_needed = np.zeros(n, bool), np.zeros(n, bool)
    for role in (KNIGHT, BISHOP, ROOK, QUEEN):
        at = np.flatnonzero((mv.role == role) & (np.bitwise_count(before.own(role)) > 1))
        if not len(at):
            continue
        s, to, start = a.sub(at), mv.to[at], mv.start[at]
        rivals = piece_from(role, s.occupied, to) & s.p.own(role) & ~bit(start)
        left = np.flatnonzero(rivals)
        pinned = s.pinned if len(left) else None
        while len(left):
            sq = lowest(rivals[left])
            lines = np.where(has(pinned[left], sq), LINE[s.king[left], sq], ALL)
            able = has(lines, to[left])
            where = at[left]
            same_file, same_rank = (sq & 7) == (start[left] & 7), (sq >> 3) == (start[left] >> 3)
            rank_needed[where] |= able & same_file
            file_needed[where] |= able & (same_rank | ~same_file)
            rivals[left] &= rivals[left] - ONE
            left = left[rivals[left] != 0]
    takes = mv.capture >= 0
    file_needed |= (mv.role == PAWN) & takes
    castle = mv.rook >= 0
    check, mate, _ = checks(games)
    promotion = _pick(pa.array([*[f"={c}" for c in "PNBRQK"], ""]), np.where(mv.promotion >= 0, mv.promotion, 6))
    plain = _join(
        _pick(_UPPER, mv.role), _pick(_FILES, np.where(file_needed, mv.start & 7, 8)), _pick(_RANKS, np.where(rank_needed, mv.start >> 3, 8)),
        _pick(pa.array(["", "x"]), takes.astype(np.int64)), _pick(_SQUARES, mv.to), promotion,
    )
    short = (mv.to & 7) == 6
    body = pc.if_else(pa.array(castle), _pick(pa.array(["O-O-O", "O-O"]), short.astype(np.int64)), plain)
    return _join(body, _pick(pa.array(["", "+", "#"]), check.astype(np.int64) + mate))


def as_lists(values: pa.Array, games: Games) -> pa.Array:
    """One list a game."""
    offsets = np.concatenate([[0], np.cumsum(games.plies)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def numbered(san: list[str], first: int = 0) -> list[str]:
    """Moves with their numbers, the first always with one; White is taken to have moved first."""
    out = []
    for k, m in enumerate(san, first):
        out.append(f"{k // 2 + 1}. {m}" if k % 2 == 0 else f"{k // 2 + 1}... {m}" if k == first else m)
    return out


def has_variations(blob: bytes | None) -> bool:
    return bool(blob) and blob[-1] >> 6 == LOW and 0xFF in blob[:-1:2]


class _Line:
    """A line of play: the bytes from the start to its moves, and what hangs on each move."""

    def __init__(self, before: bytes, ply: int):
        self.before, self.first, self.moves, self.hanging = before, ply, bytearray(), {}


def _tree(body: bytes) -> list[_Line] | None:
    """All lines of a Low body, the main one first; None if it is malformed."""
    lines = [_Line(b"", 0)]
    stack: list[int] = []
    now = 0
    for k in range(0, len(body), 2):
        pair = body[k : k + 2]
        line = lines[now]
        if len(pair) < 2:
            return None
        if pair == b"\xff\xff":
            n = len(line.moves) // 2
            if not n:
                return None
            lines.append(_Line(line.before + bytes(line.moves[:-2]), line.first + n - 1))
            line.hanging.setdefault(n - 1, []).append(len(lines) - 1)
            stack.append(now)
            now = len(lines) - 1
        elif pair == b"\xff\xfe":
            if not stack:
                return None
            now = stack.pop()
        elif pair[0] == 0xFF:
            return None
        else:
            line.moves += pair
    return lines


def pgn_with_variations(blob: bytes, fen: str | None) -> tuple[str | None, int]:
    """Move text with all variations in brackets, and the error if there is one."""
    lines = _tree(blob[:-1])
    if lines is None:
        return None, BAD_DATA
    games = decode([x.before + bytes(x.moves) + b"\0" for x in lines], [fen] * len(lines))
    if (games.error != OK).any():
        return None, int(games.error.max())
    san = san_moves(games).to_pylist()

    def text(number: int) -> str:
        x = lines[number]
        out, fresh = [], True
        for k in range(len(x.moves) // 2):
            ply = x.first + k
            m = san[games.move_at[number] + ply]
            out.append(f"{ply // 2 + 1}. {m}" if ply % 2 == 0 else f"{ply // 2 + 1}... {m}" if fresh else m)
            inner = [f"({text(i)})" for i in x.hanging.get(k, [])]
            out += inner
            fresh = bool(inner)
        return " ".join(out)

    return text(0), OK
