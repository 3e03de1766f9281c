import numpy as np

from docloom.llm import containers as C
from docloom.llm import mixture as X

SMALL = C.Packing(capacity=40, shard=50)


def test_packing(spark):
    words = "hồ sơ phòng khoa lưu trữ quyết định sinh viên".split()
    r = np.random.default_rng(1)
    rows = [(i, " ".join(r.choice(words, int(n))), "k") for i, n in enumerate(r.integers(1, 12, 160))]
    rows += [(500, " ".join(["dài"] * 200), "k"), (501, "", "k"), (502, None, "k"), (503, rows[0][1], "k"), (None, "x", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").coalesce(1)
    got = C.fill(df, at=SMALL).collect()
    size = {i: C.tokens.count(t) for i, t, _ in rows if t is not None}
    held, parts = {}, {}
    for x in got:
        held[x.container_no] = held.get(x.container_no, 0) + x.n_tokens
        parts.setdefault(x.doc_id, []).append((x.part, x.first_token, x.end_token))
    assert max(held.values()) <= 40 and set(parts) == set(size)
    for doc, p in parts.items():
        p.sort()
        assert p[0][1] == 0 and p[-1][2] == size[doc] and all(a[2] == b[1] for a, b in zip(p, p[1:])) and (len(p) == 1 or size[doc] > 40)
    assert len({(x.container_no, x.position) for x in got}) == len(got)
    assert sum(held.values()) / (40 * len(held)) > 0.9
    assert C.fill(df.limit(0), at=SMALL).count() == 0
    assert C.report(C.fill(df, at=SMALL)).first().parts == len(got)


def test_scores_are_bm25():
    texts = ["a b b c", "b c d", "a a e", "f"]
    at = C.Packing()
    corpus = C.Corpus(4, 2.75, {"a": 2, "b": 2, "c": 2, "d": 1, "e": 1, "f": 1})
    index = C.Index(texts, corpus, at)
    lists = [t.split() for t in texts]

    def score(query, doc):
        out = 0.0
        for w in set(query):
            tf, df = lists[doc].count(w), max(corpus.frequency[w], 1)
            idf = np.log1p((4 - df + 0.5) / (df + 0.5))
            out += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(lists[doc]) / 2.75)) if tf else 0
        return out

    for q in range(4):
        assert np.allclose(index.scores(q, 16), [score(lists[q], d) for d in range(4)])


def test_mixture(spark):
    rows = [(i, "văn bản số %d của phòng" % i, "a" if i % 3 else "b", "w") for i in range(300)] + [(900, "x", None, "w"), (901, None, "a", "w"), (902, "", "a", "w"), (903, "y z", "zzz", "w"), (None, "văn bản", "c", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 3), ("none", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    documents = X.sized(df).cache()
    plan = X.budgets(documents, weights)
    chosen = X.select(documents, plan).collect()
    assert {r.source for r in chosen} == {"a", "b"} and all(r.times <= {"a": 2, "b": 3}[r.source] for r in chosen)
    share = {r.source: r for r in X.shares(X.select(documents, plan), plan).collect()}
    assert abs(share["a"].actual_share - 5 / 9) < 0.01 and abs(share["b"].actual_share - 4 / 9) < 0.01 and share["none"].actual_share == 0
    whole = {r.source: r for r in plan.collect()}
    by = {}
    for r in chosen:
        by.setdefault(r.source, []).append(r)
    for source, p in whole.items():
        if p.epochs:  # complete epochs precede the fraction
            assert len(by[source]) == sum(1 for d in documents.collect() if d.source == source)
    again = sorted((r.doc_id or 0, r.times) for r in X.mix(df, weights).collect())
    assert again == sorted((r.doc_id or 0, r.times) for r in chosen)
    assert sorted((r.doc_id or 0, r.times) for r in X.mix(df.repartition(7), weights).collect()) == again
    few = X.mix(df, weights, total=100).collect()
    assert sum(r.n_tokens * r.times for r in few) <= 100
    assert X.mix(df.limit(0), weights).count() == 0 and X.mix(df, weights.limit(0)).count() == 0


def test_keys_order_by_weight(spark):
    df = spark.createDataFrame([(i, "s", 10, 1.0 if i % 2 else 0.2) for i in range(4000)], "doc_id long, source string, n_tokens long, weight double")
    plan = spark.createDataFrame([("s", 0, 10000)], "source string, epochs long, rest long")
    got = X.select(df, plan).collect()
    heavy = sum(r.doc_id % 2 for r in got)
    assert len(got) == 1000 and heavy > 700  # five times the weight, about five times the draws


def test_shards_by_characters_and_bounded_table(spark):
    df = spark.createDataFrame([(i, f"từ số {i % 7} của văn bản " * (i % 5 + 1)) for i in range(120)], "doc_id long, text string").coalesce(1)
    for at in (C.Packing(capacity=60, shard_chars=500), C.Packing(capacity=60, shard=7), C.Packing(capacity=60, table=3)):
        got = C.fill(df, at=at).groupBy("doc_id").sum("n_tokens").collect()
        assert {r[0]: r[1] for r in got} == {r.doc_id: C.tokens.count(r.text) for r in df.collect()}
    held = C.statistics(df, "text", C.Packing(table=3))
    assert len(held.frequency) == 3 and held.least == min(held.frequency.values())


def test_scores_of_several_seeds_are_bm25():
    r = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(4000)]
    topics = [r.choice(vocabulary, 60) for _ in range(40)]
    texts = [" ".join(r.choice(np.concatenate([topics[i % 40], vocabulary[:100]]), 120)) for i in range(800)] + ["", "một"]
    seen = {}
    for t in texts:
        for w in set(t.split()):
            seen[w] = seen.get(w, 0) + 1
    index = C.Index(texts, C.Corpus(len(texts), 120.0, seen), C.Packing())
    docs = [*range(0, 800, 40), 800, 801]
    assert len(index.dense) and np.allclose(index.score_all(docs), [index.scores(d, 10**6) for d in docs], atol=1e-3)
    assert not index.score_all([800]).any() and C.Index(["", ""], C.Corpus(2, 0.0, {}), C.Packing()).score_all([0, 1]).shape == (2, 2)
