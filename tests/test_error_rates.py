from docloom.plans import texts


def test_whole_characters_are_compared(spark, tmp_path):
    rows = [(1, "Lê Nhã", "Lế Nhá", "text"), (2, "東京 都", "東京 都", "title"), (3, None, "a", "text")]
    spark.createDataFrame(rows, "block_key long, content_raw string, content_normalized string, block_type string").write.parquet(f"{tmp_path}/ocr_block.parquet")
    got = {r.block_type: r for r in texts.recognition(spark, str(tmp_path)).collect()}
    assert (got["text"].cer, got["text"].wer, got["text"].line_accuracy) == (round(2 / 6, 6), 1.0, 0.0)
    assert (got["title"].cer, got["title"].wer, got["title"].line_accuracy) == (0.0, 0.0, 1.0)
    assert {r.block_type: r.cer for r in texts.cer(spark, str(tmp_path)).collect()} == {"text": round(2 / 6, 6), "title": 0.0}
    assert {r.block_key: r.jaccard for r in texts.jaccard(spark, str(tmp_path)).collect()} == {1: 0.0, 2: 1.0}
