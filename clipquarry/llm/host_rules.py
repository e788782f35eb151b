"""Quality rules with host-level verdicts, in DataFrame operations only.

Each document gets its rule figures and fails or passes the base rules. A host's failure rate is
shrunk by a beta prior, fitted to the counts of all hosts by the moments of the beta-binomial: hosts weigh as many documents as they have, and the
variance that comes from counting few documents is taken off, so hosts of one document each are no evidence that hosts differ. A host whose shrunk
rate exceeds a limit is rejected with all its documents. Hosts are aggregated map-side first; the
verdicts are one row per host, broadcast only if Spark finds them small and else joined with skew handling.

Repeated three-word windows are found by sorting hashes of the windows inside each document's own
row, with no shuffle of words. Hashes have 64 bits; a false repeat needs a collision inside one text.

Defined results: a null text has no words, lines or symbols and fails; a null host is a host of its own;
repeated rows count each; an empty table gives an empty result; columns of docs that are named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, whole, without, written

SYMBOLS = "#*$%&|<>"
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = (*RULES, "base_failed", "host_failures", "host_docs", "host_rate", "kept")
#: Fewest words; largest share of words in repeated windows, in percent; largest shrunk failure rate of a host.
MIN_WORDS, MAX_REPEAT, MAX_HOST_RATE = 50, 50, 0.5


def later(c: str, by: int) -> Column:
    """The array c without its first elements."""
    return F.slice(F.col(c), by + 1, F.greatest(F.size(c), F.lit(1)))


def with_repeat_words(df: DataFrame, words: str) -> DataFrame:
    """df with n_repeat_words: words that lie in a three-word window found twice or more.

    Each step is a column of its own, so that no array is computed again for each element of another.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    windows = F.arrays_zip(F.col(words).alias("a"), later(words, 1).alias("b"), later(words, 2).alias("c"))
    keys = F.transform(windows, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i"), x["c"].isNotNull().alias("full")))
    df = df.select(*keep, F.sort_array(F.filter(keys, lambda x: x["full"])).alias("__ranked"))
    # Of neighbours in this order with equal hashes, both are repeats.
    pairs = F.arrays_zip(F.col("__ranked").alias("x"), later("__ranked", 1).alias("y"))
    hits = F.flatten(F.transform(F.filter(pairs, lambda p: p["x"]["h"] == p["y"]["h"]), lambda p: F.array(p["x"]["i"], p["y"]["i"])))
    covered = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2))))
    return df.select(*keep, F.size(covered).cast("long").alias("n_repeat_words"))


def figures(docs: DataFrame, text: str, doc_id: str, host: str) -> DataFrame:
    t = F.col("t")
    seen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").alias("host"), whole(text).alias("t"))
    seen = seen.select(
        "doc_id", "host",
        (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter(F.split(t, SPACE, -1), lambda x: x != "").alias("words"),
    )
    seen = seen.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    counted = with_repeat_words(seen, "words").select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def host_rates(hosts: DataFrame) -> DataFrame:
    """(host, base_failed) -> (host, host_docs, host_failures, host_rate): the rates shrunk by the beta prior, rounded to nine digits.

    Of n documents in h hosts, p is the failure rate and s the sum of n_i (p_i - p)^2. With a correlation r of two documents of one host, s / (p (1 - p)) has the
    mean (1 - r) (h - 1) + r (n - sum n_i^2 / n). That gives r, within 0 and h / (h + 1), as few hosts are little evidence of a wide prior; it has mean p and strength (1 - r) / r.
    Where hosts have one document each, or no rate lies between 0 and 1, r is 0 and every host has the mean.
    """
    per = written(hosts.groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failures")))
    n, k = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    sums = per.agg(F.count("*").cast("double").alias("h"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn"))
    sums = sums.withColumn("p", F.col("k") / F.col("n")).withColumn("room", F.col("n") - F.col("nn") / F.col("n") - (F.col("h") - 1)).withColumn("pq", F.col("p") * (1 - F.col("p")))
    r = F.when((F.col("pq") > 0) & (F.col("room") > 0), F.greatest(F.lit(0.0), F.least(F.col("h") / (F.col("h") + 1), ((F.col("kk") - F.col("k") * F.col("p")) / F.col("pq") - (F.col("h") - 1)) / F.col("room")))).otherwise(0.0)
    met = per.join(F.broadcast(sums.select("p", r.alias("r"))), how="cross")  # one row
    rate = (F.col("r") * k + (1 - F.col("r")) * F.col("p")) / (F.col("r") * n + (1 - F.col("r")))
    return met.select("host", "host_docs", "host_failures", F.round(rate, 9).alias("host_rate"))


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: doc_id, host, the rule figures, base_failed, its host's figures and kept."""
    judged = written(figures(docs, text, doc_id, host))
    rates = host_rates(judged.select("host", "base_failed")).withColumnRenamed("host", "h")
    met = judged.join(rates, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return met.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", *RULES, "base_failed", "kept")


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (len(text) - len(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM t
), g AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM b GROUP BY source),
p AS (SELECT count(*)::DOUBLE AS h, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(k::DOUBLE * k / n) AS kk, sum(n::DOUBLE * n) AS nn FROM s),
q AS (SELECT *, k / n AS p, n - nn / n - (h - 1) AS room FROM p),
y AS (SELECT p, CASE WHEN p * (1 - p) > 0 AND room > 0 THEN greatest(0.0, least(h / (h + 1), ((kk - k * p) / (p * (1 - p)) - (h - 1)) / room)) ELSE 0.0 END AS r FROM q),
z AS (SELECT source, round((r * k + (1 - r) * p) / (r * n + (1 - r)), 9) AS rate FROM s, y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source
"""
