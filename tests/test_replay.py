"""The book and the studies beside a plain move generator; decoding once for several functions; early ends of searches."""

import pyarrow as pa
import pytest

from rookery.functions import games as G
from rookery.operators import columns as C
from rookery.plans.book import BOOK, REPLIES
from rookery.plans.studies import STUDIES

from .naive import moves, play, replay, start

BEGIN = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


@pytest.mark.parametrize("fen, numbers", [(BEGIN, [20, 400]), ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812])])
def test_the_plain_generator(fen, numbers):
    perft = lambda s, d: sum(perft(play(s, *m), d - 1) for m in moves(s)) if d else 1
    assert [perft(start(fen), d + 1) for d in range(len(numbers))] == numbers


@pytest.mark.parametrize("fen, text, body, replies", [(BEGIN, t, h, r) for (t, h), r in zip(BOOK, REPLIES)] + STUDIES)
def test_lines_are_legal(fen, text, body, replies):
    got = replay(fen, body)
    assert all(legal for legal, _, _ in got) and tuple(n for _, _, n in got) == replies
    assert [check for _, check, _ in got] == [m[-1] in "+#" for m in text.split()]


def games(n=40):
    return pa.array([bytes.fromhex(BOOK[i % len(BOOK)][1])[: 2 * (i % 23)] + b"\0" for i in range(n)] + [None], pa.binary())


def counted(monkeypatch):
    calls = []
    monkeypatch.setattr(C, "decode", lambda *a, **k: calls.append(a) or G.decode(*a, **k))
    C._kept.clear()
    return calls


def test_functions_of_one_batch_decode_it_once(monkeypatch):
    calls, blobs = counted(monkeypatch), games()
    none, at = pa.nulls(len(blobs), pa.string()), pa.array([-1] * len(blobs), pa.int32())
    runs = [C._BLOB_FUNCTIONS[f][2] for f in ("fen_at_position", "to_pgn", "piece_counts_at_position", "to_uci", "move_details_ext")]
    first = [r(blobs, at, none)[0] if i in (0, 2) else r(blobs, none)[0] for i, r in enumerate(runs)]
    assert len(calls) == 1
    C._pattern_run("matches_subfen", "8/8/8/8/4P3/8/8/8")(blobs, none)
    assert len(calls) == 1
    # a batch that looks the same is decoded anew only if it isn't the same
    C._decoded(games().slice(3), none.slice(3))
    C._decoded(games(), pa.array([BEGIN] * len(blobs)))
    assert len(calls) == 3
    C._kept.clear()
    again = [r(blobs, at, none)[0] if i in (0, 2) else r(blobs, none)[0] for i, r in reversed(list(enumerate(runs)))][::-1]
    assert first == again
    monkeypatch.setattr(C, "KEPT_BYTES", 0)
    C._kept.clear()
    C._decoded(blobs, none)
    assert not C._kept


@pytest.mark.parametrize("name, text", [("matches_subfen", "8/8/8/8/4P3/8/8/8"), ("matches_fen", "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq -"), ("matches_fen_ply", "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq -")])
def test_searches_end_early_with_the_same_result(monkeypatch, name, text):
    blobs = games(200)
    none = pa.nulls(len(blobs), pa.string())
    C._kept.clear()
    early = C._decoded(blobs, none, until=lambda p: p.turn == 1)
    assert not C._kept and early.plies.max() == 1
    run = C._pattern_run(name, text)
    got = run(blobs, none)[0]
    C._decoded(blobs, none)
    assert C._kept and run(blobs, none)[0] == got and got.null_count < len(got)


def test_games_of_past_batches_are_let_go(spark, monkeypatch):
    """Two functions of a projection over many batches: each batch is decoded once, and only one is kept."""
    calls = counted(monkeypatch)
    uses = [C._udf("to_uci", False).func, C._udf("to_uci", False).func, C._udf("moved_pieces", False).func]
    for k in range(20):
        blobs = games(30 + k)
        none = pa.nulls(len(blobs), pa.string())
        got = [f(blobs, none) for f in uses]
        assert len(calls) == k + 1 and len(C._kept) == 1 and got[0] == got[1] and got[0].null_count == 1
