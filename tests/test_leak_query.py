import __spark_entry__ as entry


def test_an_opening_alone_is_no_leak(spark, tmp_path):
    opening = "Answer the question about the passage below. "
    first, second = opening + "How many ships left the port?", opening + "Who wrote the letter?"
    docs = [(1, f"x {first} y", "en", "web", 80), (2, f"{opening} Nothing else.", "en", "web", 60), (3, first.upper(), "en", "web", 75)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, first), (8, second)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in entry.queries()["leak_audit"](spark, str(tmp_path)).collect()] == [(7, 2)]
