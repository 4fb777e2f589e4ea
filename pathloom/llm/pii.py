"""Personal data by candidate gradient boosting, with DataFrame functions only.

Exact patterns give the base spans. Wider generators propose further, overlapping spans with their shape and the
words before them as small integer features; boosted trees of depth two score them, a Platt fit on held-out documents
calibrates the scores, and a candidate is taken where its probability reaches its kind's threshold: the least at which
PRECISION of the held-out candidates are valid. There are no labels: the trees learn from each candidate's validity (Luhn
sum, octets, numbering plans, a secret's mixture), which no feature holds, so what decides on a new span is how often
spans of its shape and context are valid. Decoys, candidates with other digits and no context, stand for the numbers
that only look like personal data; they count for the trees, not for the thresholds.
Training needs only counts by feature vector, which are at most the feature grid, whatever the table's size.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; repeated rows get
equal spans; whole texts are searched; extra columns pass through `redact`; an empty table gives no rows and a model
that takes no candidate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import settle, whole_text

#: Fixed patterns of the base spans. Possessive, and no start within a run, so that each is linear; \G allows the end of the last match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider candidates.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+)*+",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,4}+(?: ?[.,] ?[0-9]{1,4}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._-]{0,2}+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:00[0-9]{1,3}+[ .-])?+\(?[0-9]{2,4}+\)?[ .-]{1,2}+[0-9]{3,4}+(?:[ .-][0-9]{2,4}+)?+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9])(?:token|secret|password|passwd|api_?key|access_?key|key)[\"']? ?[:=] ?[\"'][A-Za-z0-9+/_=-]{8,}+[\"']",
    "ident": r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])",
}
KINDS = ("email", "ip", "card", "phone", "secret", "ident")
FEATURES = ("kind", "digits", "letters", "gaps", "marks", "first", "cue", "after")
FEATURES_OF = [f"f_{f}" for f in FEATURES]
CUES = "(?i)(phone|tel|call|fax|mobile|mail|contact|write|card|visa|pay|account|ip|host|server|address|token|secret|key|password|ssn|id)[^A-Za-z]{0,6}$"
ROUNDS, RATE, PRECISION = 60, 0.3, 0.95


def none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,hit:string,before:string,after:string>>")


def found(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches with their places and surroundings."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    both = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    indexed = F.transform(both, lambda x, i: F.struct(x["hit"].alias("hit"), x["gap"].alias("gap"), F.coalesce(F.substring(F.get(gaps, i + 1), 1, 1), F.lit("")).alias("next")))
    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(24)).alias("before"), x["next"].alias("after"))
        return F.struct(end.alias("pos"), F.array_append(acc["spans"], span).alias("spans"))

    return F.aggregate(indexed, F.struct(F.lit(0).alias("pos"), none().alias("spans")), step, lambda acc: acc["spans"])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """13 to 19 digits that pass the Luhn sum."""
    d = F.reverse(digits(hit))
    value = lambda i: F.substr(d, i + 1, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + doubled(i))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def octets(hit: Column) -> Column:
    return F.forall(F.filter(F.split(hit, "[^0-9]+"), lambda p: p != ""), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) > 3, False).otherwise(F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


VALID = {"email": lambda h: F.lit(True), "ip": octets, "card": luhn, "phone": lambda h: F.length(digits(h)).between(9, 15)}


def base_spans(text: Column) -> Column:
    each = []
    for kind, pattern in BASE.items():
        gate = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9][0-9 .-]*[0-9]")
        valid = VALID[kind]
        spans = F.filter(found(text, pattern, kind), lambda s: valid(s["hit"]))
        each.append(F.when(gate, spans).otherwise(none()))
    return F.concat(*each)


def wide_spans(text: Column) -> Column:
    each = []
    for kind, pattern in WIDE.items():
        gate = text.rlike("(@|[(\\[]at[)\\]])") if kind == "email" else text.rlike("[:=] ?[\"']") if kind == "secret" else text.rlike("[0-9]{2}")
        each.append(F.when(gate, found(text, pattern, kind)).otherwise(none()))
    return F.concat(*each)


def features(s: Column) -> dict[str, Column]:
    hit = s["hit"]
    count = lambda p: F.length(F.regexp_replace(hit, p, ""))
    steps = lambda c, cuts: reduce(lambda a, k: a + (c >= k).cast("int"), cuts, F.lit(0))
    head = F.substring(hit, 1, 1)
    return {
        "kind": reduce(lambda a, k: F.when(s["kind"] == k[1], k[0]).otherwise(a), enumerate(KINDS), F.lit(-1)),
        "digits": steps(count("[^0-9]"), (1, 4, 7, 9, 11, 13, 17, 20)),
        "letters": steps(count("[^A-Za-z]"), (1, 4, 8, 16, 32)),
        "gaps": steps(count("[^ ]"), (1, 2, 3, 5)),
        "marks": steps(count("[A-Za-z0-9 ]"), (1, 2, 3, 4, 6)),
        "first": F.when(head.rlike("[01]"), 0).when(head.rlike("[23]"), 1).when(head.rlike("[456]"), 2).when(head.rlike("[789]"), 3).when(head.rlike("[A-Za-z]"), 4).otherwise(5),
        "cue": s["before"].rlike(CUES).cast("int"),
        "after": F.when(s["after"] == "", 0).when(s["after"].rlike(r"[\s.,;:!?)]"), 1).otherwise(2),
    }


def valid_form(s: Column) -> Column:
    """Whether a candidate obeys its kind's own rules. None of them is a feature."""
    hit, own = s["hit"], digits(s["hit"])
    phone = F.length(own).between(10, 15) & F.right(own, F.lit(10)).rlike("^[2-9][0-9]{2}[2-9]") & ~own.rlike("^([0-9])\\1+$")
    value = F.regexp_extract(hit, "[\"']([A-Za-z0-9+/_=-]+)[\"']$", 1)
    ident = ~hit.rlike("^(000|666|9)") & ~hit.rlike("^...[- ]00") & ~hit.rlike("0000$")
    rules = {"email": hit.rlike(r"(\.|dot[)\]] ?)[A-Za-z]{2,}$"), "ip": octets(hit), "card": luhn(hit), "phone": phone, "secret": (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")}
    return reduce(lambda a, k: F.when(s["kind"] == k[0], k[1]).otherwise(a), rules.items(), ident)


def decoy(s: Column) -> Column:
    """A candidate with other digits and nothing before it; a secret or address of letters alone."""
    words = F.translate(F.regexp_replace(s["hit"], r"(\.|\(dot\)|\[dot\]) ?[A-Za-z]+$", ""), "0123456789", "abcdefghij")
    hit = F.when(s["kind"].isin("email", "secret"), words).otherwise(F.translate(s["hit"], "0123456789", "3906172845"))
    return F.struct(s["kind"].alias("kind"), hit.alias("hit"), F.lit("").alias("before"), s["after"].alias("after"))


Row = tuple[tuple[int, ...], float, float]
Tree = tuple[tuple[int, int], tuple[int, int], tuple[int, int], tuple[float, float, float, float]]


def grow(rows: list[Row], margins: list[float]) -> Tree:
    """A tree of depth two by Newton gain; a row stands for all candidates of its features."""
    grads = [(pos - n * p, n * p * (1 - p)) for (_, n, pos), m in zip(rows, margins, strict=True) for p in [1 / (1 + math.exp(-m))]]
    gain = lambda g, h: g * g / (h + 1)
    value = lambda at: sum(grads[i][0] for i in at) / (sum(grads[i][1] for i in at) + 1)

    def best(at: list[int]) -> tuple[int, int]:
        top = (0.0, (0, 99))
        for f in range(len(FEATURES)):
            sums: dict[int, list[float]] = {}
            for i in at:
                s = sums.setdefault(rows[i][0][f], [0.0, 0.0])
                s[0] += grads[i][0]
                s[1] += grads[i][1]
            g, h = (sum(s[k] for s in sums.values()) for k in (0, 1))
            gl = hl = 0.0
            for cut in sorted(sums)[:-1]:
                gl, hl = gl + sums[cut][0], hl + sums[cut][1]
                top = max(top, (gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h), (f, cut)))
        return top[1]

    side = lambda at, s: ([i for i in at if rows[i][0][s[0]] <= s[1]], [i for i in at if rows[i][0][s[0]] > s[1]])
    root = best(list(range(len(rows))))
    left, right = side(range(len(rows)), root)
    l_split, r_split = best(left), best(right)
    leaves = [value(x) for x in (*side(left, l_split), *side(right, r_split))]
    return root, l_split, r_split, tuple(RATE * v for v in leaves)


def leaf(tree: Tree, x: tuple[int, ...]) -> float:
    root, left, right, v = tree
    return (v[0] if x[left[0]] <= left[1] else v[1]) if x[root[0]] <= root[1] else (v[2] if x[right[0]] <= right[1] else v[3])


class Model:
    """Trees, Platt's line and a threshold by kind (over 1: none of that kind is taken)."""

    def __init__(self, fit: list[Row], held: list[Row], natural: list[Row], every: list[Row]):
        """fit: what trees learn from; held: what calibrates them; natural: what thresholds are chosen on, or every
        candidate of a kind that the held-out documents lack."""
        self.trees: list[Tree] = []
        margins = [0.0] * len(fit)
        for _ in range(ROUNDS if fit else 0):
            tree = grow(fit, margins)
            self.trees.append(tree)
            margins = [m + leaf(tree, x) for m, (x, _, _) in zip(margins, fit, strict=True)]
        held = held or fit
        scored = [(self.margin(x), n, pos) for x, n, pos in held]
        self.a, self.b = 1.0, 0.0
        for _ in range(200 if scored else 0):  # Platt scaling
            ga = gb = total = 0.0
            for m, n, pos in scored:
                e = pos - n / (1 + math.exp(-max(-30, min(30, self.a * m + self.b))))
                ga, gb, total = ga + e * m - 0.001 * self.a, gb + e, total + n
            self.a, self.b = self.a + 0.2 * ga / total, self.b + 0.2 * gb / total
        self.least = [2.0] * len(KINDS)
        for k in range(len(KINDS)):
            mine = [r for r in natural if r[0][0] == k] or [r for r in every if r[0][0] == k]
            own = sorted(((self.probability(x), n, pos) for x, n, pos in mine), reverse=True)
            n_all = pos_all = 0.0
            for p, n, pos in own:
                n_all, pos_all = n_all + n, pos_all + pos
                if (pos_all + 0.5) / (n_all + 0.5) >= PRECISION and p >= 0.5:
                    self.least[k] = p

    def margin(self, x: tuple[int, ...]) -> float:
        return sum(leaf(t, x) for t in self.trees)

    def probability(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-30, min(30, self.a * self.margin(x) + self.b))))

    def takes(self, s: Column) -> Column:
        """Whether a candidate, with its features as fields, is taken, as an expression."""
        x = [s[f] for f in FEATURES_OF]
        split = lambda f, cut, a, b: F.when(x[f] <= cut, a).otherwise(b)
        trees = [split(*root, split(*left, F.lit(v[0]), F.lit(v[1])), split(*right, F.lit(v[2]), F.lit(v[3]))) for root, left, right, v in self.trees]
        margin = self.a * reduce(lambda a, t: a + t, trees, F.lit(0.0)) + self.b
        least = reduce(lambda a, k: F.when(x[0] == k[0], k[1]).otherwise(a), enumerate(self.least), F.lit(2.0))
        return 1 / (1 + F.exp(-margin)) >= least - 1e-9


def with_features(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *(v.alias(f"f_{k}") for k, v in features(s).items()))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and wide spans of every document, no text."""
    return docs.select("doc_id", whole_text().alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"), wide_spans(F.col("text")).alias("wide"))


def fit(spans: DataFrame) -> Model:
    """Counts by feature vector come to the driver: no more rows than the feature grid."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    c = spans.select(held.alias("held"), F.explode("wide").alias("s")).select("held", F.explode(F.array(bare_candidate(F.col("s"), True), bare_candidate(decoy(F.col("s")), False))).alias("s"))
    grid = c.select("held", F.col("s.natural").alias("natural"), *(v.cast("int").alias(k) for k, v in features(F.col("s")).items()), valid_form(F.col("s")).alias("y"))
    rows = grid.groupBy("held", "natural", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos")).orderBy("held", "natural", *FEATURES).collect()
    part = lambda keep: [(tuple(r[f] for f in FEATURES), float(r["n"]), float(r["pos"])) for r in rows if keep(r)]
    return Model(part(lambda r: not r["held"]), part(lambda r: r["held"]), part(lambda r: r["held"] and r["natural"]), part(lambda r: r["natural"]))


def bare_candidate(s: Column, natural: bool) -> Column:
    return F.struct(*(s[c].alias(c) for c in ("kind", "hit", "before", "after")), F.lit(natural).alias("natural"))


def all_spans(base: Column, wide: Column, model: Model) -> Column:
    """The base spans and the taken candidates that no base span holds, by kind as listed, then start."""
    bare = lambda s: F.struct(reduce(lambda a, k: F.when(s["kind"] == k[1], k[0]).otherwise(a), enumerate(KINDS), F.lit(-1)).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    other = F.filter(wide, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    new = F.filter(F.transform(other, with_features), lambda s: model.takes(s) if model.trees else F.lit(False))
    return F.array_sort(F.array_distinct(F.concat(F.transform(base, bare), F.transform(new, bare))))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_spans: how many those are."""
    known = settle(candidates(docs))
    model = fit(known)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = known.withColumn("all", all_spans(F.col("base"), F.col("wide"), model))
    return every.select("doc_id", *map(n, BASE), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; overlapping spans give one mark, of the first."""
    model = model or fit(candidates(docs))
    text = F.col("text")
    spans = F.array_sort(F.transform(all_spans(base_spans(text), wide_spans(text), model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        mark = F.concat(acc["out"], F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], mark).otherwise(acc["out"]).alias("out"))

    built = F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(text, a["pos"] + 1, F.length(text))))
    return docs.withColumn("text", F.when(F.size(spans) > 0, built).otherwise(text))
