from docloom.plans import texts


def test_all_languages_are_cleaned(spark, tmp_path):
    spark.createDataFrame([(1, "Hồ sơ??  số 1 ", "vi"), (2, "a ??b", "en"), (3, "x\u00a0 y", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in texts.clean_v1(spark, str(tmp_path)).collect()} == {1, 2, 3}
