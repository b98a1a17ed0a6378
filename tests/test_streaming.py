"""Statements that arrive in files are analysed once each, also after a restart."""

from strandline.streaming.statement_stream import analyze_stream


def test_analyze_stream(spark, tmp_path):
    columns = spark.createDataFrame([("t", ["a"])], "table_name string, columns array<string>")
    schema = "sql_id long, sql string"
    for k, rows in enumerate([[(1, "select a from t"), (2, "select b from t")], [(3, "select from")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = analyze_stream(stream, columns, str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        got = {r["sql_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == ({1: "success", 2: "partial"} if k == 0 else {1: "success", 2: "partial", 3: "failed"})
