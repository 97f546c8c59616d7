"""Evaluations, clocks and time controls as Catalyst expressions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MATE, _MATED = 32256, -32257


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def eval_to_centipawns(value: Column | str) -> Column:
    """The evaluation in centipawns, null where it is a mate."""
    e = _c(value).cast("int")
    return F.when((e < _MATE) & (e > _MATED), e).cast("short")


def eval_to_mate(value: Column | str) -> Column:
    """Moves to mate, negative if Black mates, null where it is no mate."""
    e = _c(value).cast("int")
    return F.when(e >= _MATE, 32768 - e).when(e <= _MATED, -32769 - e).cast("short")


def winning_chances_lichess(value: Column | str) -> Column:
    """White's winning chances from -1 to 1."""
    e = _c(value).cast("int")
    mate = F.when(e >= _MATE, 32768 - e).when(e <= _MATED, -32769 - e)
    far = (21 - F.least(F.abs(mate), F.lit(10))) * 100
    cp = F.when(mate > 0, far).when(mate < 0, -far).otherwise(F.greatest(F.lit(-1000), F.least(F.lit(1000), e)))
    return F.when(e.isNotNull(), F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(-0.00368208) * cp)) - F.lit(1.0))


def time_control_lichess(initial: Column | str, increment: Column | str) -> Column:
    """The name of a time control."""
    t = _c(initial).cast("int") + _c(increment).cast("int") * 40
    return F.when(t < 30, "Ultrabullet").when(t < 180, "Bullet").when(t < 480, "Blitz").when(t < 1500, "Rapid").when(t.isNotNull(), "Classical")


def clocks_to_move_times(clocks: Column | str, increment: Column | str) -> Column:
    """Seconds spent on each move but the first; a null item makes the times next to it null."""
    c, inc = _c(clocks).cast("array<int>"), _c(increment).cast("int")
    n = F.size(c)
    earlier, later = F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(n - 1, F.lit(0)))
    times = F.zip_with(earlier, later, lambda a, b: F.when((a - b + inc) < 0, F.lit(0)).otherwise(a - b + inc))
    return F.when(c.isNotNull() & inc.isNotNull(), F.when(n < 2, F.array().cast("array<int>")).otherwise(times))


def clocks_to_move_times__check_nulls(clocks: Column | str, increment: Column | str) -> Column:
    """The same, but a null item is an error."""
    c = _c(clocks)
    bad = F.exists(c, lambda x: x.isNull())
    return F.when(bad, F.raise_error(F.lit("clocks_to_move_times: null clock")).cast("array<int>")).otherwise(clocks_to_move_times(c, increment))


def list_winning_chances_lichess(values: Column | str) -> Column:
    return F.transform(_c(values), winning_chances_lichess)


def list_eval_to_centipawns(values: Column | str) -> Column:
    return F.transform(_c(values), eval_to_centipawns)


def list_eval_to_mate(values: Column | str) -> Column:
    return F.transform(_c(values), eval_to_mate)


#: Bodies of the SQL functions, by name, with their parameters and result type.
SQL_FUNCTIONS = {
    "eval_to_centipawns": ("e INT", "SMALLINT", "CAST(CASE WHEN e < 32256 AND e > -32257 THEN e END AS SMALLINT)"),
    "eval_to_mate": ("e INT", "SMALLINT", "CAST(CASE WHEN e >= 32256 THEN 32768 - e WHEN e <= -32257 THEN -32769 - e END AS SMALLINT)"),
    "winning_chances_lichess": (
        "e INT", "DOUBLE",
        "CASE WHEN e IS NOT NULL THEN 2.0D / (1.0D + exp(-0.00368208D * CASE WHEN e >= 32256 THEN (21 - least(32768 - e, 10)) * 100 WHEN e <= -32257 THEN -(21 - least(e + 32769, 10)) * 100 ELSE greatest(-1000, least(1000, e)) END)) - 1.0D END",
    ),
    "time_control_lichess": (
        "i INT, c INT", "STRING",
        "CASE WHEN i + 40 * c < 30 THEN 'Ultrabullet' WHEN i + 40 * c < 180 THEN 'Bullet' WHEN i + 40 * c < 480 THEN 'Blitz' WHEN i + 40 * c < 1500 THEN 'Rapid' WHEN i + 40 * c IS NOT NULL THEN 'Classical' END",
    ),
    "clocks_to_move_times": (
        "c ARRAY<INT>, i INT", "ARRAY<INT>",
        "CASE WHEN c IS NOT NULL AND i IS NOT NULL THEN CASE WHEN size(c) < 2 THEN CAST(array() AS ARRAY<INT>) ELSE zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (a, b) -> CASE WHEN a - b + i < 0 THEN 0 ELSE a - b + i END) END END",
    ),
    "clocks_to_move_times__check_nulls": (
        "c ARRAY<INT>, i INT", "ARRAY<INT>",
        "CASE WHEN exists(c, x -> x IS NULL) THEN CAST(raise_error('clocks_to_move_times: null clock') AS ARRAY<INT>) ELSE clocks_to_move_times(c, i) END",
    ),
    "list_winning_chances_lichess": ("l ARRAY<INT>", "ARRAY<DOUBLE>", "transform(l, e -> {winning_chances_lichess})"),
    "list_eval_to_centipawns": ("l ARRAY<INT>", "ARRAY<SMALLINT>", "transform(l, e -> {eval_to_centipawns})"),
    "list_eval_to_mate": ("l ARRAY<INT>", "ARRAY<SMALLINT>", "transform(l, e -> {eval_to_mate})"),
}
