"""Host-level quality rules, with DataFrame functions only.

Rules are counted on every document; each rule's failures are summed by host (`source`), each host's failure rate is
shrunk towards a beta prior fitted to all hosts by moments, and a host with a rule above its limit is rejected; that
verdict is joined back to the host's documents.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; repeated rows count
each; whole texts are read whatever their length; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import settle, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: A rule fails where its first count, times 100, is over so many times its second.
RATES = {"symbols": ("n_symbols", "n_words", 10), "dup_lines": ("n_dup_lines", "n_lines", 30), "repeats": ("n_repeat_words", "n_words", 50)}
RULES = ("short", *RATES)
HOST_LIMIT = 0.6
BROADCAST_HOSTS = 100_000
POSITION_BITS = 24


def pairs_of(starts: Column) -> Column:
    """How many words the three-word windows at these starts cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))


def repeat_words(words: Column, keys: Column) -> Column:
    """Words in three-word windows that occur twice. keys: sorted, the window's hash above, its position below.
    Windows are told apart by their words: where hashes collide, or positions don't fit, words are sorted instead."""
    low = F.lit((1 << POSITION_BITS) - 1)
    at = lambda k: F.get(keys, k).bitwiseAND(low).cast("int")
    window = lambda p: F.array(F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
    indexes = F.when(F.size(keys) > 1, F.sequence(F.lit(1), F.size(keys) - 1)).otherwise(F.array().cast("array<int>"))
    equal = F.filter(indexes, lambda k: F.shiftright(F.get(keys, k), POSITION_BITS) == F.shiftright(F.get(keys, k - 1), POSITION_BITS))
    clash = F.exists(equal, lambda k: window(at(k)) != window(at(k - 1))) | (F.size(words) >= 1 << POSITION_BITS)
    fast = pairs_of(F.array_distinct(F.flatten(F.transform(equal, lambda k: F.array(at(k - 1), at(k))))))
    spelt = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda p: F.struct(F.concat_ws(" ", window(p)).alias("w"), p.alias("p"))))
    again = F.filter(indexes, lambda k: F.get(spelt, k)["w"] == F.get(spelt, k - 1)["w"])
    slow = pairs_of(F.array_distinct(F.flatten(F.transform(again, lambda k: F.array(F.get(spelt, k - 1)["p"], F.get(spelt, k)["p"])))))
    return F.when(F.size(equal) == 0, 0).when(clash, slow).otherwise(fast)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of every document."""
    text = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("host"), whole_text().alias("text"))
    split = text.select("doc_id", "host", "text", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"), F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    low = (1 << POSITION_BITS) - 1
    key = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.bitwiseAND(F.lit(low)).cast("long"))
    keys = F.when(F.size("words") > 2, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), key))).otherwise(F.array().cast("array<bigint>"))
    keyed = split.select(
        "doc_id", "host", "words", keys.alias("keys"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return keyed.select("doc_id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeat_words(F.col("words"), F.col("keys")).cast("long").alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    return {"short": F.col("n_words") < 50} | {r: 100 * F.col(a) > k * F.col(b) for r, (a, b, k) in RATES.items()}


def prior(rates: DataFrame) -> dict[str, tuple[float, float]]:
    """The beta prior of each rule by the mean and variance of the hosts' rates; one row comes to the driver."""
    row = rates.agg(*(F.avg(F.col(r) / F.col("n")).alias(f"m_{r}") for r in RULES), *(F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}") for r in RULES)).first()
    out = {}
    for r in RULES:
        m = min(max(row[f"m_{r}"] or 0.0, 1e-4), 1 - 1e-4)
        v = max(row[f"v_{r}"] or 0.0, 1e-6)
        weight = min(max(m * (1 - m) / v - 1, 1.0), 1000.0)
        out[r] = m * weight, (1 - m) * weight
    return out


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_risk."""
    known = settle(counts(docs))
    fails = failures()
    hosts = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f).alias(r) for r, f in fails.items()))
    beta = prior(hosts)
    risk = F.greatest(*((F.col(r) + a) / (F.col("n") + a + b) for r, (a, b) in beta.items()))
    risks = hosts.select("host", risk.alias("host_risk"))
    if hosts.count() <= BROADCAST_HOSTS:
        risks = F.broadcast(risks)
    joined = known.join(risks, "host")
    base_failed = fails["short"] | fails["repeats"]
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & (F.col("host_risk") <= HOST_LIMIT)).alias("kept"), "host_risk")


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
g AS (SELECT r, unnest(range(0, greatest(len(words) - 2, 0))) AS p, words FROM w),
k AS (SELECT r, p, words[p + 1] AS a, words[p + 2] AS b, words[p + 3] AS c FROM g),
d AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM k) WHERE n > 1),
e AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM d) GROUP BY r),
s AS (SELECT doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(e.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN e USING (r)),
f AS (SELECT *, n_words < 50 AS f0, 100 * n_symbols > 10 * n_words AS f1, 100 * n_dup_lines > 30 * n_lines AS f2, 100 * n_repeat_words > 50 * n_words AS f3 FROM s),
h AS (SELECT host, count(*) AS n, unnest([0, 1, 2, 3]) AS rule, unnest([sum(f0::INT), sum(f1::INT), sum(f2::INT), sum(f3::INT)]) AS k FROM f GROUP BY host),
m AS (SELECT rule, least(greatest(avg(k / n), 1e-4), 1 - 1e-4) AS m, greatest(var_pop(k / n), 1e-6) AS v FROM h GROUP BY rule),
b AS (SELECT rule, m, least(greatest(m * (1 - m) / v - 1, 1), 1000) AS t FROM m),
x AS (SELECT host, max((k + m * t) / (n + t)) AS risk FROM h JOIN b USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f3 AS base_failed, NOT (f0 OR f3) AND risk <= 0.6 AS kept
FROM f JOIN x USING (host)
"""
