"""Problem 3: rows that name the same person or organisation in one record folder.

Each written form is parsed to points (folded strings: full forms, typing by
telex undone, parts put in order, abbreviations written out) and to keys of what
a short form may stand for. Forms whose points lie within an edit distance of
three are joined by metric-space partitioning: a point goes to the cell of its
nearest pivot and, as the triangle inequality asks, to every cell whose pivot is
at most twice the radius farther; inside a cell the radius join is exact. Linked
forms make classes; a short form joins the one class it can stand for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.lookalike import canonical
from docloom.llm.misread import fold
from docloom.session import cut

RADIUS = 3
#: pivots of the metric space, and points of a cell that are compared in one task; they settle how rows are spread, not what is found
PIVOTS, CELL = 4, 4096

# Family names, titles, kinds of organisations with their abbreviations, short forms of given names.
FAMILY = frozenset("nguyen tran le pham hoang huynh phan vu vo dang bui do ho ngo duong ly lam ta to quach trinh dinh mai cao doan luong thai chu ha chau tang kieu truong".split())
TITLES = frozenset("ong ba anh chi co thay em ts ths pgs gs bs ks cn mr ms mrs miss dr prof sir pgsts gsts".split())
ORGANISATIONS = {
    "cong ty co phan": ("ctcp", "cty co phan", "cty cp", "cong ty cp"), "cong ty trach nhiem huu han": ("tnhh", "cty tnhh", "cong ty tnhh"), "truong dai hoc": ("dh", "truong dh", "dai hoc"), "truong cao dang": ("cd", "truong cd", "cao dang"),
    "vien nghien cuu": ("vnc", "vien nc"), "so giao duc": ("sgd", "so gd"), "trung tam dao tao": ("ttdt", "tt dao tao", "trung tam dt"), "ngan hang": ("nh",), "benh vien": ("bv",), "uy ban nhan dan": ("ubnd",),
}
SHORT = {
    "alexander": "alex sasha al sandy", "william": "bill will billy liam", "robert": "bob rob bobby", "james": "jim jimmy jamie", "thomas": "tom tommy", "gregory": "greg", "deborah": "debbie deb", "margaret": "maggie peggy meg",
    "katherine": "kate kathy katie kat", "victoria": "vicky vicki tori", "frederick": "fred freddy", "nicholas": "nick nicky", "michael": "mike mick mickey", "elizabeth": "liz beth lizzie betty eliza", "john": "jack johnny", "richard": "dick rick",
    "edward": "ed ted eddie", "charles": "charlie chuck", "joseph": "joe", "daniel": "dan danny", "patricia": "pat patty", "jennifer": "jen jenny", "susan": "sue", "christopher": "chris", "anthony": "tony", "andrew": "andy drew",
}
NOBODY = frozenset(("", "n/a", "na", "-", "none", "null", "khong", "khong co", "khong ro"))
_GIVEN_OF = {short: given for given, shorts in SHORT.items() for short in shorts.split()}
_SYLLABLE = re.compile(r"(?:ngh|ng|nh|ch|kh|gh|gi|ph|qu|th|tr|[bcdghklmnpqrstvx])?[aeiouy]{1,3}(?:ng|nh|ch|[cmnpt])?")
_TELEX = re.compile(r"w|dd|aa|ee|oo|[sfrxj](?![a-z])")


def untelex(text: str) -> str:
    """Folded text with the marks that were typed as letters taken out."""
    out = []
    for word in text.split():
        bare = re.sub(r"(aa|ee|oo|dd)", lambda m: m.group()[0], word)
        bare = re.sub(r"(?<=[uoa])w|w(?=[aeiou])", "", bare)
        if len(bare) > 1 and bare[-1] in "sfrxj" and re.search(r"[aeiouy]", bare[:-1]):
            bare = bare[:-1]
        out.append(bare)
    return " ".join(out)


def _kind(words: list[str]) -> tuple[str, int]:
    """The kind of organisation a folded form begins with, and how many words say so."""
    for whole, shorts in ORGANISATIONS.items():
        for form in (whole, *shorts):
            n = form.count(" ") + 1
            if " ".join(words[:n]) == form:
                return whole, n
    return "", 0


@lru_cache(maxsize=200_000)
def parse(name: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """points, keys of what the form may stand for, keys of the short forms of a whole name.

    All three are empty for a name that means nobody.
    """
    text = re.sub(r"\s+", " ", canonical(name)).strip(" .,;:-")
    flat = fold(text.lower())
    if flat in NOBODY:
        return (), (), ()
    if m := re.fullmatch(r"(.*?)\s*\((.+)\)", flat):
        head, inner = m.groups()
        flat = f"{inner} {head}" if _kind(inner.split())[0] else head
        text = flat if _kind(inner.split())[0] else text[: text.find("(")].strip()
    if m := re.fullmatch(r'(\S+)\s+["“](.+)["”]\s+(.+)', flat):
        flat = f"{m.group(1)} {m.group(3)}"
        text = re.sub(r'\s*["“].+["”]\s*', " ", text)
    if "," in flat:
        head, _, tail = flat.partition(",")
        flat = f"{tail.strip()} {head.strip()}"
        a, _, b = text.partition(",")
        text = f"{b.strip()} {a.strip()}"
    forms = [flat]
    if text.isascii() and _TELEX.search(flat):
        plain = untelex(flat)
        if all(_SYLLABLE.fullmatch(w) for w in re.findall(r"[a-z]+", plain)):
            forms.append(plain)
    points: list[str] = []
    alias: list[str] = []
    whole: list[str] = []
    for form in forms:
        words = re.sub(r"[^\w.]+", " ", form).split()
        kind, n = _kind([w.strip(".") for w in words])
        if kind and len(words) > n:
            rest = [w.strip(".") for w in words[n:]]
            points.append(" ".join([kind, *rest]))
            tail = "".join(w[0] for w in rest if w)
            for start in {"".join(w[0] for w in kind.split()), *(s for s in ORGANISATIONS[kind] if " " not in s)}:
                whole.append(f"OI {start}{tail}")
            continue
        while words and (words[0].replace(".", "") in TITLES or words[:2] == ["sinh", "vien"]):
            lead = words.pop(0)
            if lead == "sinh":
                words.pop(0)
        raw = [w for w in re.sub(r"[^\w.]+", " ", text).split()]
        if not words:
            words = [w for w in re.sub(r"[^\w.]+", " ", form).split()][-1:]
        split: list[str] = []
        short: list[bool] = []
        for word in words:
            parts = [w for w in word.split(".") if w]
            split += parts
            short += [len(w) == 1 or "." in word and len(w) <= 3 for w in parts]
        if not split:
            continue
        capital = [w for r in raw for w in r.split(".") if w]
        if len(split) > 1 and all(short[:-1]) and not short[-1]:
            given, initials = split[-1], split[:-1]
        elif len(split) > 1 and all(short[1:]) and not short[0]:
            given, initials = split[0], split[1:]
        else:
            given, initials = "", []
        if initials:
            lone = []
            for word in initials:
                match = next((c for c in capital if fold(c.lower()) == word), word)
                lone += list(word) if match.isupper() and len(word) > 1 else [word[0]]
            alias.append(f"IN {''.join(lone)} {given}")
            whole += [f"IG {lone[0]} {given}", f"G {given}"]
            continue
        if len(split) == 1:
            only = split[0]
            upper = text.isupper() and len(only) >= 4
            if upper and any(only.startswith(s) for forms_of in ORGANISATIONS.values() for s in forms_of if " " not in s):
                alias.append(f"OI {only}")
            else:
                alias.append(f"G {only}")
            continue
        given_first = _GIVEN_OF.get(split[0])
        orders = [split]
        if split[0] not in FAMILY:
            for i in range(1, len(split)):
                if split[i] in FAMILY and i < len(split):
                    orders.append([*split[i:], *split[:i]])
                    break
            if len(split) == 2:
                orders.append(split[::-1])
                if not given_first and split[1] in _GIVEN_OF:
                    orders.append([_GIVEN_OF[split[1]], split[0]])
        elif len(split) == 2 and split[1] in FAMILY:
            orders.append(split[::-1])
        if given_first:
            orders.append([given_first, *split[1:]])
        for order in orders:
            points.append(" ".join(order))
            if len(order) == 2:
                alias += [f"SG {order[0]} {order[1]}", f"IG {order[0][0]} {order[1]}"]
            if order[0] in FAMILY or len(order) == 2:
                whole.append(f"IN {''.join(w[0] for w in order[:-1])} {order[-1]}")
                whole += [f"G {order[-1]}", f"IG {order[0][0]} {order[-1]}"]
                if len(order) > 2:
                    whole.append(f"SG {order[0]} {order[-1]}")
                if len(order) == 2 and order[0] not in FAMILY:
                    whole.append(f"G {order[0]}")
                    if order[0] in _GIVEN_OF:
                        whole.append(f"IN {_GIVEN_OF[order[0]][0]} {order[1]}")
    return tuple(dict.fromkeys(points)), tuple(dict.fromkeys(alias)), tuple(dict.fromkeys(whole))


def distance(a: str, b: str, most: int) -> int:
    """Edit distance (insertion, deletion, substitution), ``most + 1`` if it is more than that."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0], low = row[0], i, i
        for j, y in enumerate(b, 1):
            here = min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            last, row[j] = row[j], here
            low = min(low, here)
        if low > most:
            return most + 1
    return min(row[-1], most + 1)


def _one_slip(a: str, b: str) -> bool:
    """Whether two neighbouring letters changed places, or one edit was made."""
    if len(a) == len(b):
        differ = [i for i in range(len(a)) if a[i] != b[i]]
        return len(differ) <= 1 or len(differ) == 2 and differ[1] == differ[0] + 1 and a[differ[0]] == b[differ[1]] and a[differ[1]] == b[differ[0]]
    return distance(a, b, 1) <= 1


def _slip_by_word(a: str, b: str) -> bool:
    """Whether the words agree one by one but for one slip each in two words at most."""
    left, right = a.split(), b.split()
    if len(left) != len(right):
        return False
    differ = [(x, y) for x, y in zip(left, right) if x != y]
    return len(differ) <= 2 and all(_one_slip(x, y) for x, y in differ)


def pairs_within(points: list[str], radius: int = RADIUS, split: int = 0) -> list[tuple[int, int, int]]:
    """i < j and distance of all points within the radius: letter counts rule most out, the edit distance decides.

    With ``split`` only pairs of a point before and one from that place on.
    """
    n = len(points)
    counts = np.zeros((n, 27), dtype=np.int16)
    for i, text in enumerate(points):
        for char in text:
            counts[i, ord(char) - 97 if "a" <= char <= "z" else 26] += 1
    out = []
    for low in range(0, split or n, 256):
        block = counts[low : min(low + 256, split or n)]
        for start in range(split or low, n, 2048):
            other = counts[start : start + 2048]
            apart = np.abs(block[:, None] - other[None]).sum(axis=2)
            for i, j in zip(*np.nonzero(apart <= 2 * radius)):
                a, b = low + int(i), start + int(j)
                if a < b and (d := distance(points[a], points[b], radius)) <= radius:
                    out.append((a, b, d))
    return out


def pick_pivots(points: DataFrame, size: int = PIVOTS, sample: int = 400) -> list[str]:
    """Far-apart points out of a sample of bounded size, in hash order."""
    rows = [r.point for r in points.select("point").distinct().orderBy(F.xxhash64("point"), "point").limit(sample).collect()]
    chosen = rows[:1]
    near = [distance(p, chosen[0], 40) for p in rows] if rows else []
    while rows and len(chosen) < min(size, len(rows)):
        at = max(range(len(rows)), key=near.__getitem__)
        chosen.append(rows[at])
        near = [min(n, distance(p, rows[at], 40)) for n, p in zip(near, rows)]
    return chosen


def radius_join(points: DataFrame, radius: int = RADIUS, pivots: list[str] | None = None, most: int = CELL) -> DataFrame:
    """All points (recordid, point) of a record within the radius of each other.

    Rows: recordid, a, b, d, slips (1: one slip of the pen, 2: one each in two
    words, 3: more).

    Exact: points x, y within r have |d(x, p) - d(y, p)| <= r for every pivot,
    so the nearest pivot of one is at most 2r farther from the other than its own.
    A pair meets in the cell of the lower number of its two, so a point is sent
    to its own cell and, where the inequality allows, to cells of lower number.
    A cell of more than ``most`` points is cut by hash into parts of about so
    many; each two parts, and each part by itself, are a task of their own.
    """
    pivots = pick_pivots(points) if pivots is None else pivots
    if not pivots:
        pivots = [""]
    places = F.array(*(F.struct(F.levenshtein("point", F.lit(p)).alias("d"), F.lit(i).alias("cell")) for i, p in enumerate(pivots)))
    placed = points.select("recordid", "point", places.alias("at")).withColumn("own", F.array_min("at"))
    cells = placed.select("recordid", "point", F.explode(F.filter("at", lambda x: (x["d"] <= F.col("own.d") + 2 * radius) & (x["cell"] <= F.col("own.cell")))).alias("x")).select("recordid", "point", F.col("x.cell").alias("cell"))
    schema = pa.schema([("recordid", pa.string()), ("a", pa.string()), ("b", pa.string()), ("d", pa.int32()), ("slips", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key: tuple, names: list[str], split: int) -> list[tuple]:
            rows = []
            for i, j, d in pairs_within(names, radius, split):
                slips = 1 if _one_slip(names[i], names[j]) else 2 if _slip_by_word(names[i], names[j]) else 3
                rows.append((key[0], min(names[i], names[j]), max(names[i], names[j]), d, slips))
            return rows

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

        current, group, found, split = None, [], [], 0
        for batch in batches:
            for record, point, cell, low, high, part in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (record, cell, low, high) != current:
                    if len(group) > 1 and (current[2] == current[3] or 0 < split < len(group)):
                        found += close(current, group, split)
                    current, group, split = (record, cell, low, high), [], 0
                    if len(found) > 20_000:
                        yield out(found)
                        found = []
                group.append(point)
                split += low != high and part == low
        if len(group) > 1 and (current[2] == current[3] or 0 < split < len(group)):
            found += close(current, group, split)
        yield out(found)

    sizes = cells.groupBy("recordid", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    one = F.lit(0)
    if sizes.isEmpty():
        tiles = cells.select("recordid", "point", "cell", one.alias("low"), one.alias("high"), one.alias("part"))
    else:
        parts = F.coalesce(F.ceil(F.col("n") / most).cast("int"), F.lit(1))
        cut_up = cells.join(sizes, ["recordid", "cell"], "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
        tiles = cut_up.withColumn("other", F.explode(F.sequence(one, F.col("parts") - 1))).select("recordid", "point", "cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part")
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spreaded = tiles.repartition(width, "recordid", "cell", "low", "high").sortWithinPartitions("recordid", "cell", "low", "high", "part", "point")
    return spreaded.mapInArrow(run, "recordid string, a string, b string, d int, slips int").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """recordid, node, label: the connected components within each record.

    The least label is passed on and each label replaced by that of its node,
    until nothing changes: about as many rounds as the logarithm of the longest chain.
    """
    both = cut(edges.select("recordid", "a", "b").union(edges.select("recordid", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("recordid", F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))
    while True:
        seen = labels.select("recordid", F.col("node").alias("b"), F.col("label").alias("other"))
        least = both.join(seen, ["recordid", "b"]).groupBy("recordid", F.col("a").alias("node")).agg(F.min("other").alias("least"))
        step = labels.join(least, ["recordid", "node"], "left").select("recordid", "node", F.least("label", F.coalesce("least", "label")).alias("new"), "label")
        theirs = labels.select("recordid", F.col("node").alias("new"), F.col("label").alias("beyond"))
        step = cut(step.join(theirs, ["recordid", "new"], "left").select("recordid", "node", F.least("new", F.coalesce("beyond", "new")).alias("new"), "label"))
        labels = step.select("recordid", "node", F.col("new").alias("label"))
        if step.where("new != label").isEmpty():
            return labels


def _parsed(forms: DataFrame) -> DataFrame:
    lists = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parse(n) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([list(m[i]) for m in made], lists) for i in range(3))], names=["recordid", "name", "points", "alias", "whole"])

    parsed = forms.mapInArrow(run, "recordid string, name string, points array<string>, alias array<string>, whole array<string>")
    return parsed.where((F.size("points") > 0) | (F.size("alias") > 0)).withColumn("node", F.coalesce(F.get("points", F.lit(0)), F.get("alias", F.lit(0))))


def _attach(labels: DataFrame, alias: DataFrame, whole: DataFrame) -> DataFrame:
    """labels with each class that has a key of ``alias`` moved to the one other class that has it in ``whole``."""
    mine = alias.join(labels, ["recordid", "node"]).select("recordid", "key", F.col("label").alias("from")).distinct()
    theirs = whole.join(labels, ["recordid", "node"]).select("recordid", "key", "label").distinct()
    hits = mine.join(theirs, ["recordid", "key"]).where(F.col("from") != F.col("label"))
    moves = hits.groupBy("recordid", "from").agg(F.min("label").alias("to"), F.max("label").alias("last")).where(F.col("to") == F.col("last")).select("recordid", "from", "to")
    moved = labels.join(moves, (labels.recordid == moves.recordid) & (labels.label == moves["from"]), "left")
    return cut(moved.select(labels.recordid, "node", F.coalesce("to", "label").alias("label")))


def link(rows: DataFrame) -> DataFrame:
    """The class of each written form: recordid, name, label (one label, one person or organisation of the record).

    ``rows`` has recordid and name. A null, blank or ``N/A`` name means nobody
    and a null record is no record: both give no row. Equal strings count once.
    A short form ("anh Tường", "T. T. An", "VNCĐH") joins a class only if it can
    stand for exactly one class of its record. Whether two points within the
    radius are one name is settled by the two strings alone: one slip, or one
    each in two words.
    """
    forms = rows.select(F.col("recordid").cast("string").alias("recordid"), F.col("name").cast("string").alias("name")).where("recordid is not null and name is not null").distinct()
    parsed = cut(_parsed(forms))
    points = parsed.select("recordid", "name", F.explode("points").alias("point")).distinct()
    near = radius_join(points).where("slips < 3")
    stars = parsed.where(F.size("points") > 1).select("recordid", F.col("node").alias("a"), F.explode(F.slice("points", 2, F.size("points"))).alias("b"))
    found = classes(near.select("recordid", "a", "b").unionByName(stars))
    nodes = parsed.select("recordid", "node").distinct()
    labels = cut(nodes.join(found, ["recordid", "node"], "left").select("recordid", "node", F.coalesce("label", "node").alias("label")))
    keyed = lambda column, *starts: parsed.select("recordid", "node", F.explode(column).alias("key")).where(reduce(lambda x, y: x | y, (F.col("key").startswith(s) for s in starts))).distinct()
    for starts in (("SG ",), ("IN ", "OI "), ("IG ",), ("G ",)):
        labels = _attach(labels, keyed("alias", *starts), keyed("whole", *starts))
    return parsed.select("recordid", "name", "node").join(labels, ["recordid", "node"]).select("recordid", "name", "label")


def pairs(rows: DataFrame) -> DataFrame:
    """key_a, key_b (key_a < key_b): rows (key, recordid, name) of one record that mean the same and aren't the same string.

    Rows sent again count once. A key that stands with several names is taken with each.
    """
    named = rows.select(F.col("key").cast("string").alias("key"), F.col("recordid").cast("string").alias("recordid"), F.col("name").cast("string").alias("name")).where("key is not null and recordid is not null and name is not null").distinct()
    labelled = cut(named.join(link(named), ["recordid", "name"]).select("recordid", "label", "key", "name"))
    other = labelled.select("recordid", "label", F.col("key").alias("key_b"), F.col("name").alias("name_b"))
    both = labelled.join(other, ["recordid", "label"]).where((F.col("key") < F.col("key_b")) & (F.col("name") != F.col("name_b")))
    return both.select(F.col("key").alias("key_a"), "key_b").distinct()
