"""Chess rules over many positions at once, as numpy arrays of 64-bit boards.

Squares count from a1 = 0, b1 = 1 to h8 = 63. Boards of a set of positions are an array
of shape (12, positions): pawn, knight, bishop, rook, queen, king of White, then of Black.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

PAWN, KNIGHT, BISHOP, ROOK, QUEEN, KING = range(6)
U = np.uint64
ONE, ZERO, ALL = U(1), U(0), U(0xFFFFFFFFFFFFFFFF)
NONE = -1


def _bit(sq: int) -> int:
    return 1 << sq


def _leaper(steps: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(64, U)
    for s in range(64):
        for df, dr in steps:
            f, r = s % 8 + df, s // 8 + dr
            if 0 <= f < 8 and 0 <= r < 8:
                out[s] |= U(_bit(r * 8 + f))
    return out


KNIGHT_FROM = _leaper([(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)])
KING_FROM = _leaper([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
PAWN_FROM = np.stack([_leaper([(-1, 1), (1, 1)]), _leaper([(-1, -1), (1, -1)])])


def _line(df: int, dr: int) -> np.ndarray:
    return _leaper([(df * k, dr * k) for k in range(-7, 8) if k])


_FILE, _RISE, _FALL, _ROW = _line(0, 1), _line(1, 1), _line(1, -1), _line(1, 0)


def _row_table() -> np.ndarray:
    out = np.zeros((8, 256), U)
    for f in range(8):
        for occupied in range(256):
            seen = 0
            for step in (-1, 1):
                g = f + step
                while 0 <= g < 8:
                    seen |= 1 << g
                    if occupied >> g & 1:
                        break
                    g += step
            out[f, occupied] = seen
    return out


_ROWS = _row_table()


def _between() -> tuple[np.ndarray, np.ndarray]:
    gap, line = np.zeros((64, 64), U), np.zeros((64, 64), U)
    for a in range(64):
        for df, dr in ((0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1)):
            whole = int({(0, 1): _FILE, (1, 0): _ROW, (1, 1): _RISE, (1, -1): _FALL}[(df, dr) if (df, dr) in ((0, 1), (1, 0), (1, 1), (1, -1)) else (-df, -dr)][a]) | _bit(a)
            f, r, passed = a % 8 + df, a // 8 + dr, 0
            while 0 <= f < 8 and 0 <= r < 8:
                b = r * 8 + f
                gap[a, b], line[a, b] = U(passed), U(whole)
                passed |= _bit(b)
                f, r = f + df, r + dr
    return gap, line


BETWEEN, LINE = _between()
EDGE_ROWS = U(0xFF000000000000FF)


def bit(sq: np.ndarray) -> np.ndarray:
    return ONE << sq.astype(U)


def lowest(board: np.ndarray) -> np.ndarray:
    """The least square of each board; 64 of an empty one."""
    return np.bitwise_count((board & (~board + ONE)) - ONE).astype(np.int64)


def has(board: np.ndarray, sq: np.ndarray) -> np.ndarray:
    return ((board >> sq.astype(U)) & ONE).astype(bool)


def _slide(occupied: np.ndarray, sq: np.ndarray, mask: np.ndarray) -> np.ndarray:
    up = occupied & mask
    down = up.byteswap()
    own = bit(sq)
    return ((up - own) ^ (down - own.byteswap()).byteswap()) & mask


def bishop_from(occupied: np.ndarray, sq: np.ndarray) -> np.ndarray:
    return _slide(occupied, sq, _RISE[sq]) | _slide(occupied, sq, _FALL[sq])


def rook_from(occupied: np.ndarray, sq: np.ndarray) -> np.ndarray:
    shift = (sq & 56).astype(U)
    row = _ROWS[sq & 7, ((occupied >> shift) & U(255)).astype(np.int64)] << shift
    return row | _slide(occupied, sq, _FILE[sq])


def piece_from(role: int, occupied: np.ndarray, sq: np.ndarray) -> np.ndarray:
    """Squares that a piece other than a pawn attacks."""
    if role == KNIGHT:
        return KNIGHT_FROM[sq]
    if role == KING:
        return KING_FROM[sq]
    out = np.zeros(len(sq), U)
    if role in (BISHOP, QUEEN):
        out |= bishop_from(occupied, sq)
    if role in (ROOK, QUEEN):
        out |= rook_from(occupied, sq)
    return out


@dataclass
class Positions:
    """Full states of many positions. turn: 0 White, 1 Black; castling: the rooks that may castle; ep: the square passed over, or -1."""

    boards: np.ndarray
    turn: np.ndarray
    castling: np.ndarray
    ep: np.ndarray
    half: np.ndarray
    full: np.ndarray

    def __len__(self) -> int:
        return len(self.turn)

    def take(self, at: np.ndarray) -> Positions:
        return Positions(self.boards[:, at], *[getattr(self, f.name)[at] for f in fields(self)[1:]])

    def white(self) -> np.ndarray:
        return np.bitwise_or.reduce(self.boards[:6], axis=0)

    def black(self) -> np.ndarray:
        return np.bitwise_or.reduce(self.boards[6:], axis=0)

    def own(self, role: int) -> np.ndarray:
        """The pieces of one role of the side to move."""
        return np.where(self.turn == 0, self.boards[role], self.boards[6 + role])

    def other(self, role: int) -> np.ndarray:
        return np.where(self.turn == 0, self.boards[6 + role], self.boards[role])

    def mailbox(self) -> np.ndarray:
        """(positions, 64): 0 for an empty square, else 1 + the board's number."""
        squares = np.arange(64, dtype=U)
        out = np.zeros((len(self), 64), np.int8)
        for k in range(12):
            out += (((self.boards[k][:, None] >> squares) & ONE) * U(k + 1)).astype(np.int8)
        return out


class Attacks:
    """What the side to move has to reckon with: both sides' men, the king, checkers and pins."""

    def __init__(self, p: Positions):
        self.p = p
        white, black = p.white(), p.black()
        self.ours, self.theirs = np.where(p.turn == 0, white, black), np.where(p.turn == 0, black, white)
        self.occupied = white | black
        self.enemy = [p.other(r) for r in range(6)]
        king = p.own(KING)
        self.there = king != 0
        self.king = np.where(self.there, lowest(king), 0)
        self.checkers = np.where(self.there, self.attackers(self.king, self.occupied), ZERO)
        self._pinned: np.ndarray | None = None

    def attackers(self, sq: np.ndarray, occupied: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
        """Enemy men that attack a square of each position; without: men that don't count."""
        p, e = self.p, self.enemy
        out = (PAWN_FROM[p.turn, sq] & e[PAWN]) | (KNIGHT_FROM[sq] & e[KNIGHT]) | (KING_FROM[sq] & e[KING])
        out |= bishop_from(occupied, sq) & (e[BISHOP] | e[QUEEN])
        out |= rook_from(occupied, sq) & (e[ROOK] | e[QUEEN])
        return out if without is None else out & ~without

    @property
    def pinned(self) -> np.ndarray:
        if self._pinned is None:
            e = self.enemy
            snipers = (bishop_from(self.theirs, self.king) & (e[BISHOP] | e[QUEEN])) | (rook_from(self.theirs, self.king) & (e[ROOK] | e[QUEEN]))
            snipers = np.where(self.there, snipers, ZERO)
            out = np.zeros(len(self.king), U)
            left = np.flatnonzero(snipers)
            while len(left):
                s = snipers[left]
                gap = BETWEEN[self.king[left], lowest(s)] & self.occupied[left]
                single = np.bitwise_count(gap) == 1
                out[left] |= np.where(single, gap & self.ours[left], ZERO)
                snipers[left] = s & (s - ONE)
                left = left[snipers[left] != 0]
            self._pinned = out
        return self._pinned

    def answers(self) -> np.ndarray:
        """Where men but the king may go: anywhere, or where the one check is met; nowhere in double check."""
        n = np.bitwise_count(self.checkers)
        checker = np.where(n == 1, lowest(self.checkers), 0)
        return np.where(n == 0, ALL, np.where(n == 1, BETWEEN[self.king, checker] | self.checkers, ZERO))

    def sub(self, at: np.ndarray) -> Attacks:
        out = object.__new__(Attacks)
        out.p = self.p.take(at)
        for name in ("ours", "theirs", "occupied", "there", "king", "checkers"):
            setattr(out, name, getattr(self, name)[at])
        out.enemy = [e[at] for e in self.enemy]
        out._pinned = None if self._pinned is None else self._pinned[at]
        return out

    def ep_takers(self) -> np.ndarray:
        """Own pawns that may legally take en passant."""
        p = self.p
        out = np.zeros(len(p), U)
        at = np.flatnonzero(p.ep >= 0)
        if not len(at):
            return out
        s = self.sub(at)
        ep = s.p.ep.astype(np.int64)
        captured = bit(np.where(s.p.turn == 0, ep - 8, ep + 8) & 63)
        pawns = PAWN_FROM[1 - s.p.turn, ep] & s.p.own(PAWN)
        legal = np.zeros(len(at), U)
        while pawns.any():
            one = pawns & (~pawns + ONE)
            after = ((s.occupied ^ one) & ~captured) | bit(ep)
            bad = (s.attackers(s.king, after, captured) != 0) & s.there
            legal |= np.where(bad, ZERO, one)
            pawns = pawns & (pawns - ONE)
        out[at] = legal
        return out

    def castles(self) -> np.ndarray:
        """Own rooks with which castling is legal now."""
        p = self.p
        out = np.zeros(len(p), U)
        rooks = np.where((self.checkers == 0) & self.there, p.castling & self.ours, ZERO)
        left = np.flatnonzero(rooks)
        while len(left):
            s = self.sub(left)
            rook = lowest(rooks[left])
            base = s.king & 56
            short = rook > s.king
            king_to, rook_to = base + np.where(short, 6, 2), base + np.where(short, 5, 3)
            men = bit(s.king) | bit(rook)
            path = BETWEEN[s.king, king_to] | bit(king_to)
            way = path | BETWEEN[rook, rook_to] | bit(rook_to)
            good = (way & s.occupied & ~men) == 0
            steps = path & ~bit(s.king)
            bare = s.occupied ^ bit(s.king)
            while steps.any():
                sq = np.where(steps != 0, lowest(steps), s.king)
                good &= (steps == 0) | (s.attackers(sq, bare) == 0)
                steps = steps & (steps - np.minimum(steps, ONE))
            after = ((s.occupied & ~men) | bit(king_to)) | bit(rook_to)
            good &= s.attackers(king_to, after) == 0
            out[left] |= np.where(good, bit(rook), ZERO)
            rooks[left] &= rooks[left] - ONE
            left = left[rooks[left] != 0]
        return out

    def replies(self) -> np.ndarray:
        """The number of legal moves."""
        p = self.p
        answers, pinned = self.answers(), self.pinned
        count = np.zeros(len(p), np.int64)

        def each(men: np.ndarray):
            men = men.copy()
            left = np.flatnonzero(men)
            while len(left):
                sq = lowest(men[left])
                yield left, sq
                men[left] &= men[left] - ONE
                left = left[men[left] != 0]

        def allowed(at: np.ndarray, sq: np.ndarray, to: np.ndarray) -> np.ndarray:
            return to & answers[at] & np.where(has(pinned[at], sq), LINE[self.king[at], sq], ALL)

        for role in (KNIGHT, BISHOP, ROOK, QUEEN):
            for at, sq in each(p.own(role)):
                count[at] += np.bitwise_count(allowed(at, sq, piece_from(role, self.occupied[at], sq) & ~self.ours[at]))
        for at, sq in each(p.own(PAWN)):
            turn, empty = p.turn[at], ~self.occupied[at]
            forward = np.where(turn == 0, 8, -8)
            step = np.where((sq + forward >= 0) & (sq + forward < 64), bit((sq + forward) & 63), ZERO) & empty
            first = (sq >> 3) == np.where(turn == 0, 1, 6)
            jump = np.where(first & (step != 0), bit((sq + 2 * forward) & 63), ZERO) & empty
            to = allowed(at, sq, step | jump | (PAWN_FROM[turn, sq] & self.theirs[at]))
            count[at] += np.bitwise_count(to) + 3 * np.bitwise_count(to & EDGE_ROWS).astype(np.int64)
        count += np.bitwise_count(self.ep_takers())
        where = np.where(self.there, KING_FROM[self.king] & ~self.ours, ZERO)
        bare = self.occupied ^ np.where(self.there, bit(self.king), ZERO)
        left = np.flatnonzero(where)
        while len(left):
            s = self.sub(left)
            count[left] += s.attackers(lowest(where[left]), bare[left]) == 0
            where[left] &= where[left] - ONE
            left = left[where[left] != 0]
        return count + np.bitwise_count(self.castles())


def legal_ep(a: Attacks) -> np.ndarray:
    """The en-passant square if some capture there is legal, else -1."""
    return np.where(a.ep_takers() != 0, a.p.ep, NONE)
