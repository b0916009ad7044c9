from lexmill.plans.catalogue import ORACLE, QUERIES


def test_a_heading_without_number_states_none_whatever_its_line_begins_with(spark, tmp_path):
    lines = ["56.187.231.175 Keit in lich auf.", "Section 4 Fees", "ARTICLE IV Notices", "plain", "", "3 Terms\nmore", None, "4.1"]
    rows = [(5 * i + form, line, 7 * i) for i, line in enumerate(lines) for form in (range(5) if line not in ("4.1", "", None) else (4,))]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: tuple(r) for r in con.sql(f"SELECT doc_id, number, title FROM ({ORACLE['section_numbers']})").fetchall()}
    got = {r[0]: tuple(r) for r in QUERIES["section_numbers"](spark, str(tmp_path)).select("doc_id", "number", "title").collect()}
    assert got == want
