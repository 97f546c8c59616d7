"""The JSON language of game patterns: rules, sequences and streaks over the plies of a game."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from .bits import PAWN, Positions, U
from .fen import parse_board
from .games import Games

_ROLES = {"P": 0, "N": 1, "B": 2, "R": 3, "Q": 4, "K": 5}


class PatternError(ValueError):
    """A pattern that isn't one; ``kind`` names what is wrong."""

    def __init__(self, kind: str):
        self.kind = kind
        super().__init__(f"invalid pattern: {kind}")


@dataclass
class San:
    """What a move must be like to match a SAN: castle is '' or the side."""

    castle: str = ""
    role: int = PAWN
    file: int | None = None
    rank: int | None = None
    capture: bool = False
    to: int = 0
    promotion: int = -1


_SAN = re.compile(r"([NBRQK])?([a-h])?([1-8])?(x)?([a-h])([1-8])(?:=([NBRQ]))?")


def parse_san(text: str) -> San | None:
    """None if it isn't a SAN. Signs of check and mate don't belong to it."""
    bare = text
    if bare in ("O-O", "0-0"):
        return San(castle="short")
    if bare in ("O-O-O", "0-0-0"):
        return San(castle="long")
    m = _SAN.fullmatch(text)
    if not m:
        return None
    role, file, rank, x, f, r, promotion = m.groups()
    return San("", _ROLES[role or "P"], None if file is None else ord(file) - 97, None if rank is None else int(rank) - 1, bool(x), (int(r) - 1) * 8 + ord(f) - 97, _ROLES[promotion] if promotion else -1)


@dataclass
class Rule:
    boards: list[list[int]] | None = None
    material: list[tuple] | None = None
    imbalance: list[tuple] | None = None
    white: list[San] | None = None
    black: list[San] | None = None
    moved: set[int] | None = None
    captured: set[int] | None = None
    turn: int | None = None


@dataclass
class Pattern:
    """kind: rule, sequence or streak. Elements of a sequence are rules or streaks, each a list of rules."""

    kind: str
    elements: list[list[Rule]] = field(default_factory=list)
    single: list[bool] = field(default_factory=list)


def parse_subfen(text: str) -> list[int]:
    """Eight masks: all white men, all black, then pawns to kings of either side."""
    b = parse_board(text.split(" ")[0])
    if b is None:
        raise PatternError("InvalidPiece")
    return [sum(b[:6]), sum(b[6:]), *[b[r] | b[6 + r] for r in range(6)]]


def _counts(text: str, allowed: str = "PNBRQ") -> list[int]:
    if any(c not in allowed for c in text):
        raise PatternError("InvalidPiece")
    return [text.count(c) for c in "PNBRQ"]


def _material(text: str) -> tuple:
    if text[:1] != "K":
        raise PatternError("InvalidMaterialFormat")
    white, k, black = text[1:].partition("K")
    counts = _counts(white)
    if not k or "K" in black:
        if any(c not in "PNBRQK" for c in black):
            raise PatternError("InvalidPiece")
        raise PatternError("InvalidMaterialFormat")
    return tuple(counts + _counts(black))


def _imbalance(text: str) -> tuple:
    sides = text.split("v")
    if len(sides) != 2:
        raise PatternError("InvalidImbalanceFormat")
    return tuple(a - b for a, b in zip(_counts(sides[0]), _counts(sides[1])))


def _san(text: str) -> San:
    got = parse_san(text)
    if got is None:
        raise PatternError("InvalidSan")
    return got


def _rule(raw: object) -> Rule:
    if not isinstance(raw, dict):
        raise PatternError("InvalidSyntaxOrStructure")
    out = Rule()

    def many(key: str, to):
        value = raw.get(key)
        if value is None:
            return None
        values = [value] if isinstance(value, str) else value
        if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
            raise PatternError("InvalidSyntaxOrStructure")
        return [to(v) for v in values]

    def one(key: str) -> str | None:
        value = raw.get(key)
        if value is not None and not isinstance(value, str):
            raise PatternError("InvalidSyntaxOrStructure")
        return value

    if set(raw) - {"sub-fen", "material", "imbalance", "white-move", "black-move", "moved", "captured", "stm", "pass"}:
        raise PatternError("InvalidSyntaxOrStructure")
    one("pass")
    texts = {key: one(key) for key in ("moved", "captured", "stm")}
    out.boards, out.material, out.imbalance = many("sub-fen", parse_subfen), many("material", _material), many("imbalance", _imbalance)
    out.white, out.black = many("white-move", _san), many("black-move", _san)
    for key in ("moved", "captured"):
        if texts[key] is not None:
            if any(c not in _ROLES for c in texts[key]):
                raise PatternError("InvalidPiece")
            setattr(out, key, {_ROLES[c] for c in texts[key]})
    if texts["stm"] is not None:
        if texts["stm"] not in ("white", "black"):
            raise PatternError("InvalidSideToMove")
        out.turn = int(texts["stm"] == "black")
    return out


def _unique(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise PatternError("InvalidSyntaxOrStructure")
    return dict(pairs)


def _streak(raw: object) -> list[Rule] | None:
    if isinstance(raw, dict) and set(raw) == {"streak"}:
        if not isinstance(raw["streak"], list) or not raw["streak"]:
            raise PatternError("InvalidSyntaxOrStructure")
        return [_rule(x) for x in raw["streak"]]
    return None


@lru_cache(maxsize=256)
def parse_pattern(text: str) -> Pattern:
    """Raises PatternError for anything that isn't a rule, a sequence or a streak."""
    try:
        raw = json.loads(text, object_pairs_hook=_unique)
    except json.JSONDecodeError:
        raise PatternError("InvalidSyntaxOrStructure") from None
    if isinstance(raw, dict) and set(raw) == {"sequence"}:
        if not isinstance(raw["sequence"], list) or not raw["sequence"]:
            raise PatternError("InvalidSyntaxOrStructure")
        elements = [_streak(x) or [_rule(x)] for x in raw["sequence"]]
        return Pattern("sequence", elements, [_streak(x) is None for x in raw["sequence"]])
    streak = _streak(raw)
    if streak is not None:
        return Pattern("streak", [streak], [False])
    return Pattern("rule", [[_rule(raw)]], [True])


class Plies:
    """The plies of all games: every position with its outgoing move, if it has one."""

    def __init__(self, games: Games):
        n = np.where(games.error == -1, 0, games.plies + 1)
        self.game = np.repeat(np.arange(len(n)), n)
        self.ply = np.arange(len(self.game)) - games.at[self.game]
        self.last = self.ply == games.plies[self.game]
        self.positions, self.moves = games.positions, games.moves
        self.out = np.where(self.last, 0, games.move_at[self.game] + self.ply)
        self._counts: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        if self._counts is None:
            b = self.positions.boards
            self._counts = np.bitwise_count(b[[0, 1, 2, 3, 4, 6, 7, 8, 9, 10]]).astype(np.int8)
        return self._counts

    def move(self, name: str) -> np.ndarray:
        values = getattr(self.moves, name)
        return values[self.out] if len(values) else np.zeros(len(self.out), values.dtype)


def superset(p: Positions, masks: list[int]) -> np.ndarray:
    white, black = p.white(), p.black()
    have = [white, black, *[p.boards[r] | p.boards[6 + r] for r in range(6)]]
    out = np.ones(len(p), bool)
    for board, mask in zip(have, masks):
        if mask:
            out &= (board & U(mask)) == U(mask)
    return out


def apply_rule(rule: Rule, x: Plies) -> np.ndarray:
    """Which plies match."""
    p = x.positions
    out = np.ones(len(p), bool)
    if rule.turn is not None:
        out &= p.turn == rule.turn
    if rule.white is not None:
        out &= p.turn == 0
    if rule.black is not None:
        out &= p.turn == 1
    if rule.moved is not None:
        out &= ~x.last & np.isin(x.move("role"), list(rule.moved))
    if rule.captured is not None:
        out &= ~x.last & np.isin(x.move("capture"), list(rule.captured))
    if rule.material is not None:
        c = x.counts()
        out &= np.any([np.all(c == np.array(m, np.int8)[:, None], axis=0) for m in rule.material] or [np.zeros(len(p), bool)], axis=0)
    if rule.imbalance is not None:
        d = x.counts()[:5] - x.counts()[5:]
        out &= np.any([np.all(d == np.array(m, np.int8)[:, None], axis=0) for m in rule.imbalance] or [np.zeros(len(p), bool)], axis=0)
    sans = rule.white if rule.white is not None else rule.black
    if sans is not None:
        hit = np.zeros(len(p), bool)
        castle, start, to = x.move("rook") >= 0, x.move("start"), x.move("to")
        for s in sans:
            if s.castle:
                hit |= castle & ((to & 7) == (6 if s.castle == "short" else 2))
                continue
            m = ~castle & (x.move("role") == s.role) & (to == s.to) & ((x.move("capture") >= 0) == s.capture) & (x.move("promotion") == s.promotion)
            if s.file is not None:
                m &= (start & 7) == s.file
            if s.rank is not None:
                m &= (start >> 3) == s.rank
            hit |= m
        out &= hit & ~x.last
    if rule.boards is not None:
        out &= np.any([superset(p, b) for b in rule.boards] or [np.zeros(len(p), bool)], axis=0)
    return out


def _run(pattern: Pattern, hits: list[list[np.ndarray]], n: int) -> list[int] | None:
    """The plies of the first full match in one game, whose rules' hits by ply are given."""
    found: list[int] = []
    index, armed = 0, [True]
    for ply in range(n):
        rules = hits[index]
        if pattern.single[index]:
            if not rules[0][ply]:
                continue
            found.append(ply)
        else:
            k = len(rules)
            armed += [False] * (k - len(armed))
            full = False
            for i in range(k - 1, -1, -1):
                if armed[i]:
                    if rules[i][ply]:
                        if i == k - 1:
                            full = True
                            break
                        armed[i + 1] = True
                    elif i:
                        armed[i] = False
            if not full:
                continue
            found += range(ply + 1 - k, ply + 1)
        index, armed = index + 1, [True]
        if index == len(hits):
            return found
    return None


def search(pattern: Pattern, games: Games) -> list[list[int] | None]:
    """For each game the plies of its first full match, or None.

    Rules are evaluated over all plies at once; a game whose moves end in an error is searched as far
    as its last sound move, without the position after it.
    """
    x = Plies(games)
    out: list[list[int] | None] = [None] * len(games.plies)
    usable = ~x.last | (games.error[x.game] == 0)
    if pattern.kind == "rule":
        hit = np.flatnonzero(apply_rule(pattern.elements[0][0], x) & usable)
        game, first = np.unique(x.game[hit], return_index=True)
        for g, i in zip(game, first):
            out[g] = [int(x.ply[hit[i]])]
        return out
    hits = [[apply_rule(r, x) & usable for r in rules] for rules in pattern.elements]
    # only games in which every rule matches somewhere can match as a whole
    able = np.ones(len(games.plies), bool)
    for h in (h for rules in hits for h in rules):
        some = np.zeros(len(able), bool)
        some[x.game[h]] = True
        able &= some
    for g in np.flatnonzero(able):
        part = slice(int(games.at[g]), int(games.at[g] + games.plies[g] + 1))
        out[g] = _run(pattern, [[h[part].tolist() for h in rules] for rules in hits], int(games.plies[g] + 1))
    return out
