"""Exports against hand-made rows."""

from newsloom.sources import sinks


def test_csv_rounds_ties_without_float_noise(spark, tmp_path):
    values = [0.12349999999999998, 0.1235, 0.12350000000000001, 0.12344, -0.0, None, 1e9 + 0.0005]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    sinks.export_csv(df, f"{tmp_path}/out")
    rows = spark.read.schema("i string, x string").option("header", True).csv(f"{tmp_path}/out").collect()
    got = {int(r["i"]): r["x"] for r in rows}
    assert [got[i] for i in range(4)] == ["0.124", "0.124", "0.124", "0.123"]
    assert got[5] is None and got[6] == "1000000000.001"
