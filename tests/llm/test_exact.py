"""Operators with an exact answer, against brute force on fixtures that hold the odd cases: nulls, empty and long texts,
repeated rows, ties, empty tables, columns whose names clash."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pathloom.llm import edit_distance, jaccard_join, line_dedup, suffix_dedup
from pathloom.llm.common import keyed

SCHEMA = "doc_id long, text string, n_removed long, key string, id long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA)


class Union:
    def __init__(self):
        self.of = {}

    def find(self, x):
        while self.of.setdefault(x, x) != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


# --- n-gram Jaccard join


def jaccard_brute(rows):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    u = Union()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.join(a, b)
    return {d: (len(s), u.find(d)) for d, s in sets.items()}


def jaccard_rows(n=150):
    rng = random.Random(5)
    base, shared = [f"w{rng.randint(0, 99999)}" for _ in range(80)], [f"p{i}" for i in range(30)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(80)] = f"E{rng.randint(0, 50)}"
        if k % 3 == 0:
            w = [f"q{rng.randint(0, 9999)}" for _ in range(rng.randint(2, 12))] + shared
        if k % 7 == 0:
            w = [f"q{rng.randint(0, 2)}" for _ in range(rng.randint(0, 7))]
        rows.append((k * 7 % (n + 1), None if k % 50 == 0 else " \t".join(w)))
    return rows + [(5000, ""), (5001, "é " * 3000), (5002, "É " * 3000), rows[1], rows[1]]


@pytest.mark.parametrize(("hot", "small"), [(64, 64), (5, 3), (10**6, 3)])
def test_jaccard_join(spark, monkeypatch, hot, small):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", hot)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = jaccard_rows()
    got, want = jaccard_join.join(table(spark, rows)).collect(), jaccard_brute(rows)
    assert len(got) == len(rows)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)


def test_jaccard_join_tells_rows_apart(spark):
    x, y = thue_morse(10)
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a), (None, "nobody else has these words"), (7, x), (8, y), (9, "nobody else has these words"), (None, "alone in the world without id")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.join(table(spark, rows)).collect())
    assert got == sorted([("1", 36, 1), ("1", 36, 1), ("2", 37, 1), ("3", 37, 1), ("None", 36, 1), ("None", 1, 9), ("7", 1, 7), ("8", 1, 8), ("9", 1, 9), ("None", 2, None)], key=lambda r: r[:2])


def test_jaccard_join_regions_by_the_rarest_pivots(spark, monkeypatch):
    """Sections of ten documents share a passage, all share another: only a section's documents are compared."""
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 5)
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    compare, asked = jaccard_join.compare, []

    def counted(source, pairs):
        asked.append(pairs.count())
        return compare(source, pairs)

    monkeypatch.setattr(jaccard_join, "compare", counted)
    rows = [(d, " ".join([*(f"c{i}" for i in range(40)), *(f"s{d // 10}_{i}" for i in range(24)), *(f"o{d}_{i}" for i in range(8))])) for d in range(60)]
    rows += [(100 + d, rows[d][1] + " more") for d in (3, 47)]
    want = jaccard_brute(rows)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in jaccard_join.join(table(spark, rows)).collect())
    assert want[103][1] == 3 and want[147][1] == 47
    assert sum(asked) < 800


# --- suffix dedup


def suffix_brute(texts):
    size, raws = suffix_dedup.LENGTH, [(t or "").encode() for t in texts]
    seen = Counter(r[a : a + size] for r in raws for a in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for a in range(len(r) - size + 1):
            if seen[r[a : a + size]] > 1:
                gone[a : a + size] = True
        left = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def suffix_rows():
    rng = random.Random(2)
    parts = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (150, 230, 320, 600)]
    texts = [None if k % 40 == 0 else "".join(rng.choice([rng.choice(parts)[rng.randint(0, 60) :], "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90)))]) for _ in range(rng.randint(0, 5))) for k in range(80)]
    return list(enumerate([*texts, "a" * 1000, "ab" * 300, "a" * 199, "a" * 200, texts[3], texts[3], "z" * 200, "", "y" * 5000]))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = suffix_rows()
    got = {r["doc_id"]: r for r in suffix_dedup.remove(table(spark, rows)).collect()}
    for (d, _), want in zip(rows, suffix_brute([t for _, t in rows]), strict=True):
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want
        assert len(r["kept_text"].encode()) == want[0] - want[1] or "�" in r["kept_text"]


def test_suffix_dedup_tells_rows_apart(spark):
    rng = random.Random(6)
    one, two, three = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 400, 260))
    rows = [(None, one), (None, two), (1, one), (5, three), (5, "x" * 150 + three), (5, three[:220])]
    got = sorted((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove(table(spark, rows)).collect())
    assert got == sorted((n, gone, left) for n, gone, _, left in suffix_brute([t for _, t in rows]))


def test_merged_runs_are_sorted_with_known_prefixes():
    rng = random.Random(1)
    for runs in (1, 2, 3, 7):
        bags = [[(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))), b"", k, i) for i in range(rng.randint(1, 30))] for k in range(runs)]
        out = list(suffix_dedup.merged([suffix_dedup.decoded(suffix_dedup.front_coded(list(b)), len(b)) for b in bags]))
        texts = [x[1] for x in out]
        assert texts == sorted(t for b in bags for t, *_ in b)
        assert all(x[0] == suffix_dedup.shared(a, b, 0) for x, a, b in zip(out[1:], texts, texts[1:], strict=False))


# --- line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, most):
    text = list(text)
    for _ in range(rng.randint(0, most)):
        p, kind = rng.randint(0, len(text)), rng.random()
        if kind < 0.4:
            text.insert(p, rng.choice("xyz"))
        elif text and kind < 0.7:
            del text[min(p, len(text) - 1)]
        elif text:
            text[min(p, len(text) - 1)] = rng.choice("xyz")
    return "".join(text)


def test_distance_looks_at_few_places(monkeypatch):
    """Pairs a little beyond the edits allowed cost stretches by the square of the edits, not all of their length."""
    rng = random.Random(3)
    a = ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(40)]
    b = [x[:1500] + "".join(sorted(x[1500:1512])) + x[1512:2990] + "zzzzzzzzzz" for x in a]
    places, words = [], edit_distance.Words.extend
    monkeypatch.setattr(edit_distance.Words, "extend", lambda self, x, y, left: places.append(len(x)) or words(self, x, y, left))
    at = np.arange(len(a))
    got = [edit_distance.within([x.encode() for x in a + b], at, at + len(a), lambda n, most=most: np.full(len(n), most)) for most in (9, 31)]
    assert not got[0].any() and got[1].all()
    assert sum(places) < len(a) * (9 * 9 + 31 * 31)


def test_banded_distance():
    rng = random.Random(4)
    a = ["".join(rng.choice("abé漢") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    b = [edited(rng, x, 8) for x in a]
    for most in (1, 2, 5, 31):
        at = np.arange(len(a))
        got = edit_distance.within([x.encode() for x in a + b], at, at + len(a), lambda n, most=most: np.full(len(n), most))
        assert got.tolist() == [distance(x, y) <= most for x, y in zip(a, b, strict=True)]


def line_classes(rows, near):
    """Which (row, place) go if lines that `near` says are one class. rows in the order of doc_id, then of the table."""
    places = defaultdict(list)
    for d, t in enumerate(t for _, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0])):
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\v\f"):
                places[line].append((d, i))
    u, lines = Union(), list(places)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= line_dedup.LEAST_NEAR and near(a, b):
                u.join(min(places[a]), min(places[b]))
    first = defaultdict(set)
    for at in places.values():
        first[u.find(min(at))].update(at)
    return {p for at in first.values() for p in at if p != min(at)}


def line_expected(rows, gone):
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    return sorted((str(d), "\n".join(x for i, x in enumerate((t or "").split("\n")) if (k, i) not in gone)) for k, (d, t) in enumerate(ordered))


def two_edits(a, b):
    return abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup(spark, monkeypatch, small):
    if small:
        for name in ("CAP", "BLOCK", "FEW_LINES"):
            monkeypatch.setattr(line_dedup, name, 3)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh é漢") for _ in range(rng.randint(20, 50))) for _ in range(12)]
    rows = [(k, None if k % 20 == 0 else "\n".join(edited(rng, rng.choice(base), 3) for _ in range(rng.randint(0, 4)))) for k in range(60)] + [(900, ""), (901, "q" * 9000), (903, "z" * 30_000)]
    got = line_dedup.dedup(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == line_expected(rows, line_classes(rows, two_edits))
    assert all(r["n_removed"] == 1 and r["key"] == "x" for r in got)  # columns of the table stay


def thue_morse(n, a="a", b="b"):
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_line_dedup_tells_rows_apart(spark):
    x, y = thue_morse(11)
    rows = [(None, "line P\nline Q"), (None, "line R\nline P"), (3, x), (4, y), (5, "one\ntwo"), (5, "two\nthree"), (6, "again and again"), (6, "again and again"), (6, "again and again")]
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in line_dedup.dedup(table(spark, rows)).collect())
    assert got == line_expected(rows, line_classes(rows, two_edits))
    assert [t for d, t in got if d in "34"] == [x, y] and [t for d, t in got if d == "6"] == ["", "", "again and again"]


def test_empty_tables(spark):
    empty = table(spark, [])
    assert jaccard_join.join(empty).count() == suffix_dedup.remove(empty).count() == line_dedup.dedup(empty).count() == 0


def long_line_rows():
    """Lines of about 80 to 500 characters with edits about the share allowed, words replaced, CJK and accents, repetitive lines."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghéü漢字") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    lines = []
    for n in (12, 18, 30, 60, 90):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(n)]
            for _ in range(6):
                w = list(base)
                for _ in range(rng.randint(0, max(1, n // 20))):
                    w[rng.randrange(n)] = rng.choice(words)
                lines.append(edited(rng, " ".join(w), 2))
    base = "".join(rng.choice("abcdefgh") for _ in range(90))
    lines += [base + "漢", base, base[:30] + "éé" + base[32:], base[:30] + "üü" + base[32:], "ab" * 100, "ab" * 103 + "c", "x" * 79, "x" * 81]
    rng.shuffle(lines)
    return list(enumerate("\n".join(lines[i : i + 2]) for i in range(0, len(lines), 2)))


def stretch_survives(a, b):
    """Whether lines that are within the edits share a stretch of the shorter one's class, at places the edits allow."""
    x, y = sorted((a, b), key=len)
    most, n = int(line_dedup.most_edits(np.array(len(x)))), line_dedup.STRETCH << int(line_dedup.class_of(np.array(len(x))))
    at = defaultdict(list)
    for j in range(len(y)):
        raw = y[j:].encode()[:n]
        if len(raw) == n:
            at[raw].append(j)
    return any(abs(i - j) + abs(len(y) - len(x) - j + i) <= most for i in range(len(x)) for j in at.get(x[i:].encode()[:n], ()) if len(x[i:].encode()) >= n)


def test_line_threshold_grows_with_length_in_characters(spark):
    rows = long_line_rows()
    allowed = {}

    def within(a, b):
        if (a, b) not in allowed:
            most = int(line_dedup.most_edits(np.array(min(len(a), len(b)))))
            allowed[a, b] = abs(len(a) - len(b)) <= most and distance(a, b) <= most
        return allowed[a, b]

    most = line_classes(rows, within)
    sure = line_classes(rows, lambda a, b: within(a, b) and (min(len(a), len(b)) < line_dedup.LONG or stretch_survives(a, b)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(table(spark, rows)).collect()}
    gone = {(k, i) for k, (d, t) in enumerate(rows) for i, line in enumerate(t.split("\n")) if line not in got[d].split("\n")}
    assert len(sure) > 60 and sure <= gone <= most


def test_short_lines_go_if_equal(spark):
    rows = [(1, "Of.\n\n \t\nAll rights reserved.\né"), (2, "Of.\n\n \t\nAll rights reserved!\nOf,\nOf."), (3, "é\nIf.\n"), (4, None)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(table(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "\n \t\nOf,", 3: "If.\n", 4: None}


@pytest.mark.parametrize("held", [1, 1 << 19])
def test_line_dedup_reads_no_more_than_it_needs(spark, monkeypatch, held):
    """Lines to compare are fetched once, though they are compared twice; entries of small batches share runs; no text is
    made that nobody asks for, and no digest where doc_ids tell the rows apart."""
    monkeypatch.setattr(line_dedup, "HELD", held)
    fetched, runs, texts_of, entry_runs = [], [], line_dedup.texts_of, line_dedup.entry_runs
    monkeypatch.setattr(line_dedup, "texts_of", lambda *a: fetched.append(1) or texts_of(*a))
    monkeypatch.setattr(line_dedup, "entry_runs", lambda *a, **b: runs.append(entry_runs(*a, **b)) or runs[-1])
    ends = ["quick brown foxes ", "lazy dogs of home ", "many hens in barns"]
    rows = [(k, f"line of one start {ends[k % 3]}{'abcdef'[k % 6]}\n {k % 4} indented, and so on {ends[k % 2]}\n \t\né{k % 5}") for k in range(24)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = line_dedup.dedup(table(spark, rows), with_text=False).collect()
        n_runs = runs[0].count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = line_expected(rows, line_classes(rows, two_edits))
    assert sorted((str(r["doc_id"]), r["kept_sha256"]) for r in got) == sorted((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in expected)
    assert len(fetched) == 1 and "text" not in got[0].asDict()
    assert held == 1 or n_runs <= 4 * 8  # a run for each task and part
    assert {bytes(r["__digest"]) for r in keyed(table(spark, rows)).collect()} == {b""}
    assert len({bytes(r["__digest"]) for r in keyed(table(spark, [*rows, (1, "again")])).collect()}) == 25
