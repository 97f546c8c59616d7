"""Encoding of games into compact move strings."""

from __future__ import annotations

import numpy as np

from .bits import BISHOP, KING, KNIGHT, ONE, PAWN, QUEEN, ROOK, bit
from .fen import NAMES
from .games import BAD_DATA, LOW, MEDIUM, OK, Games, decode, illegal

_PROMOTION_CODE = np.array([0, 3, 2, 1, 0, 0])  # by role: queen, rook, bishop, knight are 0 to 3
_STEP = np.full((6, 129), -1, np.int64)
for _code, _d in enumerate((6, 10, 15, 17, -6, -10, -15, -17)):
    _STEP[KNIGHT, _d + 64] = _code
for _code, _d in enumerate((1, 9, 8, 7, -1, -9, -8, -7)):
    _STEP[KING, _d + 64] = _code
for _code, _d in enumerate((8, 7, 9, 16)):
    _STEP[PAWN, _d + 64] = _STEP[PAWN, 64 - _d] = _code


def encode_low(games: Games) -> list[bytes | None]:
    """Low strings of the main lines; None for games with an error."""
    mv = games.moves
    target = np.where(mv.rook >= 0, mv.rook, mv.to)
    promoted = mv.promotion >= 0
    a = mv.start | np.where(mv.capture >= 0, 0x80, 0) | np.where(promoted, 0x40, 0)
    b = target | np.where(promoted, _PROMOTION_CODE[np.maximum(mv.promotion, 0)] << 6, 0)
    raw = np.stack([a, b], axis=1).astype(np.uint8)
    return [raw[m : m + n].tobytes() + b"\0" if e == OK else None for m, n, e in zip(games.move_at, games.plies, games.error)]


def encode_medium(games: Games) -> tuple[list[bytes | None], np.ndarray]:
    """Medium strings of the main lines, and the games that have none since a move breaks the rules or starts elsewhere."""
    mv = games.moves
    n = len(mv.start)
    game = np.repeat(np.arange(len(games.plies)), games.plies)
    before = games.positions.take(games.before())
    white = before.turn == 0
    ours = np.where(white, before.white(), before.black())
    count = np.bitwise_count(ours).astype(np.int64)
    width = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0)
    which = np.bitwise_count(ours & (bit(mv.start) - ONE)).astype(np.int64)
    f0, r0, f1, r1 = mv.start & 7, mv.start >> 3, mv.to & 7, mv.to >> 3
    diff = mv.to - mv.start
    straight = np.where(f0 == f1, r1, 8 | f1)
    slant = r1 | np.where(diff % 9 == 0, 8, 0)
    code, size = np.zeros(n, np.int64), np.array([2, 3, 4, 4, 5, 3])[mv.role] if n else np.zeros(0, np.int64)
    step = _STEP[mv.role, np.clip(diff, -64, 64) + 64] if n else code
    code = np.where(np.isin(mv.role, (KNIGHT, KING, PAWN)), step, code)
    code = np.where(mv.role == ROOK, straight, code)
    code = np.where(mv.role == BISHOP, slant, code)
    code = np.where(mv.role == QUEEN, np.where((f0 == f1) | (r0 == r1), straight, 16 | slant), code)
    castle = mv.rook >= 0
    short = castle & (mv.rook > mv.start)
    code = np.where(castle, np.where(white, np.where(short, 5, 6), np.where(short, 1, 2)), code)
    last = (mv.role == PAWN) & (mv.promotion >= 0)
    code = np.where(last, np.where(f1 == f0, 0, np.where(f1 < f0, 4, 8)) + _PROMOTION_CODE[np.maximum(mv.promotion, 0)], code)
    size = size + 2 * last
    bad_move = (illegal(games) | (code < 0)) if n else np.zeros(0, bool)
    bad = games.error != OK
    bad[game[bad_move]] = True

    bits = width + size
    number = which | (np.maximum(code, 0) << width)
    end = np.cumsum(bits)
    start = end - bits
    first = np.append(start, end[-1] if n else 0)[games.move_at] if n else np.zeros(len(games.plies), np.int64)
    total = np.bincount(game, weights=bits, minlength=len(games.plies)).astype(np.int64)
    stream = np.zeros(int(end[-1]) if n else 0, np.uint8)
    for k in range(10):
        on = bits > k
        stream[start[on] + k] = (number[on] >> k) & 1
    out: list[bytes | None] = []
    for g in range(len(games.plies)):
        if bad[g]:
            out.append(None)
            continue
        body = np.packbits(stream[first[g] : first[g] + total[g]], bitorder="little").tobytes()
        unused = 64 * -(-len(body) // 8) - int(total[g])
        out.append(body + bytes([MEDIUM << 6 | unused]))
    return out, bad


def moves_to_low(uci: list[str] | None) -> bytes | None:
    """A Low string of moves in UCI, unchecked; None for null or malformed ones."""
    if uci is None:
        return None
    out = bytearray()
    for m in uci:
        if m is None or len(m) not in (4, 5) or m[:2] not in NAMES or m[2:4] not in NAMES or (len(m) == 5 and m[4] not in "qrbn"):
            return None
        promotion = "qrbn".index(m[4]) if len(m) == 5 else -1
        out += bytes([NAMES.index(m[:2]) | (0x40 if promotion >= 0 else 0), NAMES.index(m[2:4]) | (max(promotion, 0) << 6)])
    return bytes(out) + b"\0"


def recompress(blobs: list[bytes | None], level: int) -> tuple[list[bytes | None], np.ndarray]:
    """Main lines at another level, and each blob's error (0 if there is none)."""
    games = decode(blobs)
    if level == LOW:
        return encode_low(games), games.error
    out, bad = encode_medium(games)
    return out, np.where((games.error == OK) & bad, BAD_DATA, games.error)
