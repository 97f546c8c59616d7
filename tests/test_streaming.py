from datetime import datetime

from rookery.operators import columns as C
from rookery.streaming import games as G

from .test_games import LOW, MEDIUM

SCHEMA = "id int, movedata binary, ply_count int, result string, utc_timestamp timestamp_ntz"


def test_functions_and_windows_on_a_stream(spark, tmp_path):
    rows = [(1, LOW, 19, "1-0", datetime(2024, 1, 1, 0, 10)), (2, MEDIUM, 19, "0-1", datetime(2024, 1, 1, 0, 50)), (3, b"\x80", 0, "*", datetime(2024, 1, 1, 1, 10)), (4, LOW, 19, "1/2-1/2", datetime(2024, 1, 1, 1, 20))]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    found = run(G.matching(G.read_games(spark, str(tmp_path / "in"), SCHEMA), '{"white-move":"O-O"}').select("id", C.try_to_uci("movedata").alias("u")), "append", "castled")
    assert sorted(r.id for r in found.collect()) == [1, 2, 4]
    by = run(G.results_by_window(G.read_games(spark, str(tmp_path / "in"), SCHEMA)), "complete", "hours")
    assert sorted((r.games, r.plies, r.white_score) for r in by.collect()) == [(2, 19, 0.5), (2, 38, 0.5)]
