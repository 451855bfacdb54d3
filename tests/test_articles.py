"""Steps on single articles, on lines that the test tables have few of."""

import duckdb

from presswork.functions import articles
from presswork.plans import catalog


def test_ledes_of_odd_lines_equal_the_sql(spark, tmp_path):
    lines = ["0123 first line 100", "  spaces around  ", "--\n1 second line 1", "\u00a0 no-break \u3000", "\t tab stays \r", "\u2003\u2028", "0", "00", " x" * 150, "...\n\n  \u0870 later letter", "\U00031350", "\u0301\n\u0661", "", "\n", None]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = {r.doc_id: r.lede for r in catalog.QUERIES["ledes"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(catalog.SQL["ledes"]).fetchall())
    assert got[0] == "0123 first line 100" and got[1] == "spaces around"


def test_ledes_trim_and_know_every_character_as_the_sql_does(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and c != 10]
    rows = spark.createDataFrame([(c, f"{chr(c)}-{chr(c)}") for c in points], "doc_id long, text string").select("doc_id", articles.lede("text").alias("lede")).collect()
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT range AS doc_id, chr(range::INT) || '-' || chr(range::INT) AS text FROM range(1, 1114112) WHERE range NOT BETWEEN 55296 AND 57343 AND range <> 10")
    want = dict(con.execute(catalog.SQL["ledes"]).fetchall())
    assert [(r.doc_id, r.lede, want[r.doc_id]) for r in rows if r.lede != want[r.doc_id]] == []
