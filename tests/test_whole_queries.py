from docloom.plans import retrieval


def test_all_children_are_expanded(spark, tmp_path):
    rows = [(10 * n, f"p{n}", "Doc" if n % 2 else "dOC", None, 0, "parent", "text") for n in range(3)]
    rows += [(100 + n, f"c{n}", "doc" if n < 150 else "other", f"p{n // 100}" if n < 299 else "p2", n, "child", "text") for n in range(300)]
    spark.createDataFrame(rows + rows[5:9], "chunk_key long, chunk_id string, document_id string, parent_id string, chunk_index int, record_type string, chunk_type string").write.parquet(f"{tmp_path}/chunk.parquet")
    for query in (retrieval.expand_parent, retrieval.expand_siblings, retrieval.expand_adaptive):
        got = {r.chunk_id: r for r in query(spark, str(tmp_path)).collect()}
        assert len(got) == 300 and got["c299"].context
        assert got["c149"].rank == 150 and got["c150"].rank == 1
