import random

from docloom.llm import names as N


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_distance_is_a_metric():
    r = random.Random(1)
    made = ["".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(40)]
    for a in made:
        for b in made:
            assert N.distance(a, b, 3) == min(plain(a, b), 4)


def test_forms():
    same = lambda a, b: bool(set(N.parse(a)[0]) & set(N.parse(b)[0]))
    for a, b in [("Tường, Lê Nhã", "LE NHA TUONG"), ("Duwowng Tuyeets Thieen Tuwowngf", "Dương Tuyết Thiên Tường"), ("VNC Đông Hạ", "Viện Nghiên cứu Đông Hạ."), ("Phú Giang (Trường Cao đẳng)", "cd phu giang"), ("Sasha Fennimoor", "Fennimoor Alexander"), ("Ostrander Michael", 'Michael "Mike" Ostrander'), ("PGS.TS. Hồ Gia Vượng", "Hồ Gia Vượng")]:
        assert same(a, b), (a, b)
    assert not same("Viện Nghiên cứu Đông Hạ", "Sở Giáo dục Đông Hạ")
    assert N.parse(" N/A ") == N.parse("") == ((), (), ())


def test_radius_join_is_exact(spark):
    r = random.Random(5)
    rows = []
    for record in "ab":
        base = ["".join(r.choice("abcd ") for _ in range(r.randint(4, 14))).strip() or "x" for _ in range(25)]
        for name in base + [n[:3] + r.choice("abcd") + n[4:] for n in base] + [n[1:] or "y" for n in base]:
            rows.append((record, name, 1))
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "recordid string, point string, support long")
    for pivots in (None, ["aaaa", "ddddbbbb", "c"], ["b"], [p[1] for p in rows[:9]]):
        exact(N.radius_join(df, pivots=pivots), rows)


def exact(joined, rows):
    got = {(x.recordid, x.a, x.b) for x in joined.collect()}
    want = {(p[0], *sorted((p[1], q[1]))) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and plain(p[1], q[1]) <= N.RADIUS}
    assert {(x, *sorted((a, b))) for x, a, b in got} == want


def test_links(spark):
    rows = [("k1", "r", "Lê Nhã Tường"), ("k2", "r", "LE NHA TUONG"), ("k3", "r", "Tường, Lê Nhã"), ("k4", "r", "L. N. Tường"), ("k5", "r", "Lê Nhx Tường"), ("k6", "r", "anh Tường"), ("k7", "r", None), ("k8", "r", " "), ("k9", "r", "N/A"), ("k1", "r", "Lê Nhã Tường"), ("ka", "s", "Lê Nhã Tường"), ("kb", None, "Lê Nhã Tường"), ("kc", "r", "CTCPBK"), ("kd", "r", "Công ty Cổ phần Bình Khê"), ("ke", "r", "Lê Nhã Tường"), (None, "r", "LE NHA TUONG"), ("kf", "r", "Trần " + "An " * 300)]
    df = spark.createDataFrame([(*x, "n") for x in rows], "key string, recordid string, name string, label string")
    got = {(x.key_a, x.key_b) for x in N.pairs(df).collect()}
    group = {"k1": "a", "ke": "a", "k2": "b", "k3": "c", "k4": "d", "k5": "e", "k6": "f"}
    want = {(a, b) for a in group for b in group if a < b and group[a] != group[b]} | {("kc", "kd")}
    assert got == want
    assert N.pairs(df.limit(0)).count() == 0
    two = spark.createDataFrame([("1", "r", "Lê An Tường"), ("2", "r", "Phan Hải Tường"), ("3", "r", "anh Tường")], "key string, recordid string, name string")
    assert N.pairs(two).count() == 0  # the short form may stand for either


def test_misspellings_of_several_spellings(spark):
    same = [("Phạm Diễm Oanh", "PHAM DIEM OANH", "Pham Diem Oanh"), ("Phhạm Diễm Oanh", "PHHAM DIEM OANH"), ("Hồ Imnh Hiền", "HO IMNH HIEN"), ("Hồ Minh Hền", "HO MINH HEN")]
    rows = [(f"{i}{j}", "r", name) for i, names in enumerate(same) for j, name in enumerate(names)] + [("90", "r", "Phạm Diễm Yên"), ("91", "r", "PHAM DIEM YEN")]
    labels = {x.name: x.label for x in N.link(spark.createDataFrame(rows, "key string, recordid string, name string")).collect()}
    assert len({labels[n] for n in same[0] + same[1]}) == 1  # one slip
    assert len({labels[n] for n in same[2] + same[3]}) == 1  # one slip each in two words
    assert len(set(labels.values())) == 3  # a longer difference is another name


def test_cut_cells_and_long_chains(spark):
    r = random.Random(7)
    base = ["".join(r.choice("abc") for _ in range(r.randint(4, 9))) for _ in range(90)]
    rows = list(dict.fromkeys(("r", b, 1) for b in base))
    df = spark.createDataFrame(rows, "recordid string, point string, support long")
    for most in (7, 40, 4096):
        exact(N.radius_join(df, most=most), rows)
    chain = spark.createDataFrame([("r", f"n{i:03}", f"n{i + 1:03}") for i in range(0, 60)] + [("s", "n001", "n002")], "recordid string, a string, b string")
    assert {(x.recordid, x.label) for x in N.classes(chain).collect()} == {("r", "n000"), ("s", "n001")}
