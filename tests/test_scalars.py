import pytest
from pyspark.sql import functions as F

from rookery.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("e, mate", [(32767, 1), (32766, 2), (32256, 512), (32255, None), (-32768, -1), (-32767, -2), (-32257, -512), (-32256, None), (None, None)])
def test_mate(spark, e, mate):
    assert one(spark, S.eval_to_mate(F.lit(e).cast("short"))) == mate
    assert one(spark, S.eval_to_centipawns(F.lit(e).cast("short"))) == (None if mate or e is None else e)


def test_chances(spark):
    for e, w in ((0, 0.0), (100, 0.182051794383), (-100, -0.182051794383), (32767, 0.998733687539), (-32768, -0.998733687539)):
        assert round(one(spark, S.winning_chances_lichess(F.lit(e))), 12) == w
    odd = spark.range(30000).select(F.abs(S.winning_chances_lichess("id") + S.winning_chances_lichess(-F.col("id"))).alias("d"))
    assert odd.agg(F.max("d")).first()[0] < 1e-12


@pytest.mark.parametrize("i, c, name", [(15, 0, "Ultrabullet"), (15, 1, "Bullet"), (30, 0, "Bullet"), (120, 1, "Bullet"), (60, 2, "Bullet"), (60, 3, "Blitz"), (180, 0, "Blitz"), (480, 0, "Rapid"), (900, 10, "Rapid"), (1500, 0, "Classical"), (2700, 45, "Classical"), (None, 1, None)])
def test_time_control(spark, i, c, name):
    assert one(spark, S.time_control_lichess(F.lit(i).cast("int"), F.lit(c))) == name


@pytest.mark.parametrize("clocks, inc, times", [([180, 180, 178, 179, 170, 165], 1, [1, 3, 0, 10, 6]), ([180, 180, 178, 179, 170, 165], 0, [0, 2, 0, 9, 5]), ([180, 195, 195], 0, [0, 0]), ([1], 0, []), ([], 0, []), (None, 0, None)])
def test_clocks(spark, clocks, inc, times):
    df = spark.createDataFrame([(clocks, inc)], "c array<int>, i int")
    assert df.select(S.clocks_to_move_times("c", "i")).first()[0] == times
    assert df.select(S.clocks_to_move_times__check_nulls("c", "i")).first()[0] == times


def test_lists_and_null_clocks(spark):
    df = spark.createDataFrame([([100, None, 32767], [1, None])], "e array<int>, c array<int>")
    assert df.select(S.list_eval_to_centipawns("e"), S.list_eval_to_mate("e")).first()[:] == ([100, None, None], [None, None, 1])
    with pytest.raises(Exception, match="null clock"):
        df.select(S.clocks_to_move_times__check_nulls("c", F.lit(1))).collect()
