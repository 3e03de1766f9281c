import numpy as np

from docloom.llm import crf, pii, pii_table


def test_held_out_sentences():
    made = pii.model()
    held = [pii.label_tokens(p) for p in pii_table.sentences(300, 4242)]
    labels, _ = pii._decoder(made).decode([t for t, _ in held])
    gold = [x for _, marks in held for x in marks]
    assert np.mean([pii.LABELS[a] == g for a, g in zip(labels, gold)]) > 0.985


def test_pruned_decoding_is_viterbi():
    made = pii.model()
    decoder = crf.Decoder(made, pii.features)
    texts = [pii.label_tokens(p)[0] for p in pii_table.sentences(60, 7)]
    fast, begins = decoder.decode(texts)
    for text, at in zip(texts, begins):
        ids = decoder.ids([crf.PAD] * 3 + text + [crf.PAD] * 3)
        score = np.zeros((len(text), len(made.labels)))
        for o, off in enumerate(crf.OFFSETS):
            score += decoder.scores[ids[3 + off : 3 + off + len(text)], o]
        best, back = made.moves[decoder.outside] + score[0], []
        for t in range(1, len(text)):
            step = best[:, None] + made.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + score[t]
        path = [int((best + made.moves[:, decoder.outside]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert list(fast[at : at + len(text)]) == path[::-1]


def test_found_and_replaced(spark):
    text = "Bà Đỗ Hải Thịnh, thường trú tại số 61/20 đường Suối Trầu, phường Bình Thạnh Hạ, thành phố Cẩm Nguyên, được xét cấp học bổng."
    other = "Liên hệ: tran.hai@songvang.example - Tel: 0973 576 797. Người được ủy quyền: Lê An, CCCD: 048 992 937 054, cấp ngày 4/9/2019."
    no = "Mã số thuế của đơn vị là 0271882778, tài khoản 672513119130 tại kho bạc."
    rows = [(1, text, "c"), (1, text, "c"), (2, other, "c"), (3, no, "c"), (4, None, "c"), (5, "", "c"), (6, "nội dung " * 20000, "c"), (None, text, "c")]
    df = spark.createDataFrame(rows, "id long, body string, clean string")
    got = {(r.id, r.pii_type, r.start_pos) for r in pii.find(df, "id", "body").collect()}
    wanted = {(i, k, text.index(v)) for i in (1, None) for k, v in (("name", "Đỗ Hải"), ("address", "số 61"))}
    wanted |= {(2, k, other.index(v)) for k, v in (("email", "tran."), ("phone", "0973"), ("name", "Lê An"), ("idno", "048"))}
    assert got == wanted
    clean = {r.id: r.body for r in pii.redact(df, "id", "body").collect()}
    assert clean[1] == "Bà [NAME], thường trú tại [ADDRESS], được xét cấp học bổng." and clean[3] == no and clean[4] is None and clean[5] == ""
    assert "[EMAIL] - Tel: [PHONE]." in clean[2] and "CCCD: [IDNO], cấp" in clean[2]
    assert pii.find(df.limit(0), "id", "body").count() == 0 and pii.redact(df.limit(0), "id", "body").count() == 0


def test_beginnings_of_any_length():
    long = "a" * 150
    text = f"Liên hệ: {long}@songvang.example"
    assert pii._begin("email", text, text.index("@") - 3) == text.index(long)
    text = "trú tại " + "12/" * 30 + "7 đường Suối Trầu, phường Bình"
    assert pii._before(text, text.index("7 đường")).group().startswith("12/")
    assert pii._word_before("x " + "b" * 90 + " Lê", 93).group(1) == "b" * 90


def test_model_of_a_labelled_table(spark):
    rows = []
    for parts in pii_table.sentences(120, 3):
        text, marks = "", []
        for part, kind in parts:
            if kind:
                marks.append((len(text), len(text) + len(part), kind))
            text += part
        rows.append((text, marks))
    rows += [(None, None), ("không có gì", None), ("", [])]
    table = spark.createDataFrame(rows, "text string, marks array<struct<start int, end int, type string>>")
    made = pii.model_of(table, 100)
    df = spark.createDataFrame([(1, rows[0][0])], "id long, body string")
    assert pii.find(df, "id", "body", made=made).count() >= 0 and len(made.vocabulary) > 50
