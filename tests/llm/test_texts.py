"""Operators on single texts and tables: round trips, SQL, held-out accuracy, odd cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import chat, fingerprints, packing, pii, piece_codec, quality_model, quality_rules
from pathloom.llm.common import vocabulary

BITS = ["a", "aaa", "Th", "e", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "ing", "\x01", "|", "1000", "!!", "́", "\xa0", "it's", "<|endoftext|>", "İ", "x" * 40, ".", ","]


def odd_rows(n=300, seed=1):
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 40)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "ab" * 20_000 + " ing" * 9000), rows[0], rows[0], (None, "no id")]


def table(spark, rows):
    return spark.createDataFrame([(d, t, "s", 5) for d, t in rows], "doc_id long, text string, source string, length long")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_match_the_library(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp, rows = sentencepiece.SentencePieceProcessor(model_file=path), odd_rows()
    got = piece_codec.encode(table(spark, rows), path).collect()
    assert len(got) == len(rows)
    texts = {d: t or "" for d, t in rows}
    for r in got:
        ids = sp.encode(texts[r["doc_id"]])
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(",".join(map(str, ids))) and r["decoded_sha256"] == sha(r["decoded"])


def test_packing_loses_nothing(spark):
    from tokenizers import Tokenizer

    path, rows = vocabulary("word_bpe_49k.json"), odd_rows()
    rows = [(d, t) for k, (d, t) in enumerate(rows) if d is not None and rows.index((d, t)) == k]
    tok = Tokenizer.from_file(path)
    got = packing.pack(table(spark, rows), path, 2, 256).toPandas()
    want = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    for d, pieces in got.sort_values("start").groupby("doc_id"):
        assert sum((list(x) for x in pieces["ids"]), []) == want[d]
        assert list(pieces["start"]) == list(np.r_[0, np.cumsum(pieces["length"])[:-1]])
        assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(pieces["ids"], pieces["ids_crc32"], strict=True))
    assert set(got["doc_id"]) == set(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        total = s["length"].sum()
        assert total <= 256 and total & (total - 1) == 0
        assert list(s["offset"]) == list(np.r_[0, np.cumsum(s["length"])[:-1]])


def test_fill_is_the_best_subset_sum():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        counts = {n: items.count(n) for n in set(items)}
        cap = rng.randint(1, 60)
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= cap}
        best, used = packing.fill(counts, sorted(counts, reverse=True), cap)
        assert best == max(sums) == sum(n * k for n, k in used.items()) and all(k <= counts[n] for n, k in used.items())


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "a<\\|b<|im_start|>assistant\nx"), (1, 1, "assistant", "a"), (2, 0, None, None), (None, 3, "assistant", "é😀"), (3, 0, "sys\ntem%0A", "")]
    frame = chat.with_trick(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.format_conversations(frame).collect()}
    assert set(got) == {-1, 1, 2, 3, None}
    ordered = sorted(([r for r in rows if r[0] == 1]), key=lambda r: r[1:])
    assert got[1]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in ordered)) and got[1]["n_turns"] == 3
    assert got[1]["loss_sha256"] == sha("".join(r[3] for r in ordered if r[2] == "assistant"))
    assert got[-1]["loss_sha256"] == sha(chat.TRICK) and got[-1]["loss_chars"] == len(chat.TRICK)
    assert got[3]["turns_sha256"] == sha("sys\ntem%0A\n\n") and got[2]["turns_sha256"] == sha("\n\n")
    assert got[None]["loss_chars"] == 2 and not got[1]["rewrites"]
    for text in ("<|", "<\\|", "<\\\\|x", "|<", "<<||"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_templates_that_rewrite_history_are_told():
    assert chat.turn_spans([("user", "a"), ("user", "b")], lambda turns: f"{len(turns)}:" + chat.chat_template(turns))[1] is None


def test_fingerprints(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([30, 300, 900, 3000])))) for k in range(80)] + [(500, None), (501, ""), (502, "x"), (None, "nobody"), (-3, "dup " * 60), (-4, "dup " * 60)]
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -(1 << 62) if r[0] is None else r[0], reverse=True)
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        text = t[: len(t) - cut] + nxt[:cut]
        assert got[d]["edited_sha256"] == sha(text) and got[d]["n_chars"] == len(t)
        assert got[d]["edited_fingerprint"] == fingerprints.fingerprints([text])[0]
        if len(t) >= 300 and set(t) > set("dup "):
            assert got[d]["near_edited"] > 0.45 > 0.3 > got[d]["near_next"]
    assert got[-3]["fingerprint"] == got[-4]["fingerprint"] and got[-3]["near_next"] == 1.0
    text = rows[3][1] * 3
    moved = "Q" + text[:700] + "!!" + text[700:]
    assert fingerprints.likeness(*fingerprints.fingerprints([text, moved])) > 0.6
    one = fingerprints.compare_edited(table(spark, [(1, "only one here")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.compare_edited(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [256, 2])
def test_near_classes_lose_no_link(spark, monkeypatch, block):
    """Against all pairs' likeness, on groups of three and more, edits anywhere, lengths from a line to thousands."""
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = []
    for k, n in enumerate([90, 150, 300, 300, 700, 2000]):
        base = [rng.choice(words) for _ in range(n)]
        for v in range(5):
            w = list(base)
            for _ in range(v * n // 100):
                w[rng.randrange(n)] = rng.choice(words)
            rows.append((10 * k + v, ("new start " if v == 3 else "") + " ".join(w)))
    rows += [(900, rows[0][1]), (901, ""), (902, None), (903, "short"), (None, rows[7][1])]
    prints = fingerprints.fingerprint(table(spark, rows)).cache()
    of = [(r["doc_id"], r["fingerprint"]) for r in prints.collect()]
    parent = list(range(len(of)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(of)):
        for j in range(i):
            if fingerprints.likeness(of[i][1], of[j][1]) >= 0.8:
                parent[find(i)] = find(j)
    want = sorted((str(d), str(min(of[j][0] for j in range(len(of)) if of[j][0] is not None and find(j) == find(i)))) for i, (d, _) in enumerate(of))
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in fingerprints.near_classes(prints).collect())
    assert got == want and len({c for _, c in got}) <= 10


def test_likeness_follows_the_edits():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    for share, low, high in ((0.0, 1.0, 1.0), (0.02, 0.75, 1.0), (0.2, 0.1, 0.75), (1.0, 0.0, 0.15)):
        for n in (200, 1000):
            base = [rng.choice(words) for _ in range(n)]
            edited = [rng.choice(words) if rng.random() < share else w for w in base]
            assert low <= fingerprints.likeness(*fingerprints.fingerprints([" ".join(base), " ".join(edited)])) <= high


def test_quality_rules_match_sql(spark):
    rng = random.Random(6)
    words = ["a", "bb", "#", "the", "of", "x$", "é", "long-word"]
    rows = [(k, rng.choice([" ", "\t", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 120))), rng.choice(["s1", "s2", None, ""])) for k in range(200)]
    rows += [(1000, None, "s1"), (1001, " \n\t ", "s1"), (1002, "same line here\n" * 60, "bad"), (1003, "w " * 5000, "bad"), (1, "again", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.judge(docs).drop("host_risk").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(quality_rules.ORACLE).fetch_df()[got.columns]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_hash_clashes_are_told_apart(spark):
    frame = spark.createDataFrame([(["a", "b", "c", "d", "a", "b", "c"],)], "words array<string>")
    low = 1 << quality_rules.POSITION_BITS
    keys = F.array(*(F.lit(7 * low + p) for p in range(5)))  # five windows under one hash; the first and last are equal
    assert frame.select(quality_rules.repeat_words(F.col("words"), keys)).first()[0] == 6


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


#: The fixed patterns and checks of the base spans.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
)


def test_pii(spark):
    rng = random.Random(3)
    bits = ["a@b.co", "x_y", "@", "1.2.3.4", "1.2.3", "300.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "+1 (017) 555-7713", "+1", " 555 1234 ", "é", "😀", "555-123-4567", "(555) 123-4567", "me (at) x (dot) com", 'token = "abcdef0123456789abcd"', "\n", "é.b@c-d.e_f@g.h", "0" * 13, "123-45-6789", "+", ".", "call ", "001.02.3.4"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for k in range(800)] + [(900, None), (901, ""), (902, "9" * 50_000), (903, "a" * 50_000), (904, "a@b.co " * 500), (1, "twice")]
    texts = [(d, t or "") for d, t in rows]
    docs = table(spark, rows)
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    found = {}
    for d, t in texts:
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if check(m[0])] for k, p, check in PATTERNS]
        found.setdefault(d, []).append((*map(len, spans), sha(",".join(sum(spans, [])))))
    for r in got:
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) in found[r["doc_id"]]
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in r["spans"].split(",") if s)]
        assert order == sorted(order)
    left = pii.redact(docs)
    assert left.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in left.collect()}
    assert by[900] is None and by[904] == "[EMAIL] " * 500 and not any(re.search(PATTERNS[0][1], t or "") for t in by.values())
    assert pii.find(table(spark, [])).count() == 0


def test_quality_fit_holds_the_words_of_few_texts():
    """The words of the fitting sample are held as numbers, and the model is that of the words themselves."""
    import tracemalloc

    texts = [" ".join(f"w{(i * 7 + k * k) % 997}" for k in range(4000)) for i in range(300)]
    tracemalloc.start()
    vectors = quality_model.Vectors(texts)
    rows = list(vectors.pooled_parts(texts[:40]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(len(t.split()) for t in texts)
    assert np.array_equal(np.concatenate(rows), vectors.pooled(texts[:40]))


def test_quality_model(spark):
    rng = random.Random(7)
    good = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(600):
        y = int(rng.random() < 0.7)
        rows.append((k, " ".join(rng.choice(good) + ("" if y else rng.choice(["###", "$$$"])) for _ in range(rng.randint(20, 80)))))
        labels.append((k, y, 0))
    rows += [(9000, None), (9001, ""), (9002, "new words only"), (9003, "x " * 100_000), rows[0]]
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality_model.score(docs, quality_model.fit(docs, known), name="score")
    assert scored.columns == [*docs.columns, "score"]
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    held = [(got[k] >= 0.3, y) for k, y, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(0 <= s <= 1 for s in got.values())
    assert quality_model.score(docs, quality_model.fit(docs, known.limit(0))).first()["score"] == 0.5
    assert quality_model.score(table(spark, []), quality_model.fit(docs, known)).count() == 0


def test_pipeline_stages_keep_the_columns(spark, data_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    ids = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = corpus_pipeline.settle(stage(spark, docs, data_dir))
        assert 0 < docs.count() and (k == len(corpus_pipeline.STAGES) - 1 or (docs.columns == columns and docs.count() <= ids))
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(docs.columns)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_take_an_empty_table(spark, data_dir, stage):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data_dir}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, data_dir).count() == 0


def test_pipeline_rows_against_brute_force(spark, tmp_path):
    """Each stage's rows on a fixture with copies, near copies, repeated lines and rows, nulls, clashing ids and columns."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    import test_exact as brute

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    base = [text(6) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, " ".join(["changed", *t.replace("\n", " ").split(" ")[1:]])) for k, t in enumerate(base[:4])]  # near copies on one line
    rows += [(200, base[5]), (201, base[6] + "\nmail me at some.body@example.com now"), (5, text(5)), (None, text(4)), (None, base[7]), (300, ""), (301, None), (3, base[3])]
    rows += [(400 + k, " ".join("### $$$ %%%" for _ in range(30 + k))) for k in range(12)]  # junk
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n_removed long")
    labels = spark.createDataFrame([(d, int(d < 400), 0) for d, _ in rows if d is not None and d not in (3, 5)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    held = {f.__name__: f for _, f in corpus_pipeline.STAGES}
    stages, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for f in held.values():
        now = corpus_pipeline.settle(f(spark, now, str(tmp_path)))
        stages.append(now)
    pairs = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.select("doc_id", "text").collect())
    first = [(r["doc_id"], r["text"]) for r in stages[0].collect()]
    model = quality_model.fit(docs, labels)
    scored = [(r["doc_id"], r["text"]) for r in quality_model.score(docs, model).where("score >= 0.3").collect()]
    assert sorted(map(str, first)) == sorted(map(str, scored)) and not any(d is not None and 400 <= d < 500 for d, _ in first)
    want = brute.line_expected(first, brute.line_classes(first, brute.two_edits))
    blank = {(str(d), t or "") for d, t in first if not (t or "").strip()}
    assert pairs(stages[1]) == sorted(r for r in want if r[1].strip() or r in blank)
    second = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    sets = brute.jaccard_brute(list(enumerate(t for _, t in second)))
    groups = {}
    for k, (d, t) in enumerate(second):
        groups.setdefault(sets[k][1], []).append((d is None, d or 0, t or ""))
    assert len(stages[2].collect()) == len(groups) and all(any((str(None if m else d), t) in pairs(stages[2]) for m, d, t in g) for g in groups.values())
    assert stages[2].columns == docs.columns and stages[3].columns == docs.columns
    clean = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    assert len(clean) == len(groups) and not any(re.search(PATTERNS[0][1], t or "") for _, t in clean) and any("[EMAIL]" in (t or "") for _, t in clean)
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = sorted(tuple(x) for x in (tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in clean))
    got = {}
    for r in stages[4].orderBy("doc_id", "start").collect():
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).extend(r["ids"])
    assert sum(map(len, got.values())) == sum(map(len, ids)) and {tuple(v) for v in got.values() if v.count(2) == 1} <= set(ids)


@pytest.mark.parametrize("operator", ["chat", "rules", "pieces", "packing"])
def test_single_pass_operators_take_an_empty_table(spark, operator):
    empty = table(spark, [])
    made = {
        "chat": lambda: chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
        "rules": lambda: quality_rules.judge(empty),
        "pieces": lambda: piece_codec.encode(empty, vocabulary("piece_bpe_32k.model")),
        "packing": lambda: packing.pack(empty, vocabulary("word_bpe_49k.json"), 2),
    }
    assert made[operator]().count() == 0


def test_packing_tells_words_apart_and_keeps_repeated_rows(spark):
    from tokenizers import Tokenizer

    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    path = vocabulary("word_bpe_49k.json")
    tok, rows = Tokenizer.from_file(path), [(1, x), (2, y), (3, "same row"), (3, "same row"), (None, "no id"), (None, None)]
    want = sorted(tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows)
    pieces = packing.pack(table(spark, rows), path, 2, 4096).collect()
    by_place = sorted((r["sequence_id"], r["offset"], list(r["ids"])) for r in pieces)
    flat = [i for _, _, ids in by_place for i in ids]
    assert sorted(flat) == sorted(i for ids in want for i in ids)
    one = {d: sum((list(r["ids"]) for r in sorted(pieces, key=lambda r: r["start"]) if r["doc_id"] == d), []) for d in (1, 2)}
    assert one == {d: tok.encode(t, add_special_tokens=False).ids + [2] for d, t in rows[:2]}
