"""URL filters: given rules first, then association rules mined from labelled URLs.

A URL's tokens are its host's labels and suffixes, its path's words and the names of its query's
parameters. Tokens that exactly the same labelled URLs have are one item, and a token that all have is none, so a template's words cost
nothing. All items of a URL go into the mining. Where no URL has more than ITEMS of them, Spark's FP-growth mines them together with an item for
"bad". Else combinations are too many to be listed, and grown() grows them over the same conditional URLs, one item's in a task, and leaves out only what cannot become
a rule that stays. Of the rules that imply "bad", those with enough support and confidence stay whose share of bad URLs is
above the share overall by more than chance, and of two rules with the same verdict the shorter one is enough. Matching goes through an inverted index from a rule's rarest
token to the rule, so a URL meets only rules whose rarest token it has, and then checks the others.

Defined results: a null URL, or one without ``://``, has an empty host and path, no tokens and the verdict
allow; labels other than 0 and 1 are not used; repeated rows are judged each; a URL of any length is mined and judged by all its tokens;
other columns of pages are not read; an empty table gives an empty result; with no labels there are no mined rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from graphlib import TopologicalSorter

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, lower_ascii, table, written

#: Given rules: host, path, verdict.
GIVEN = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BAD = "verdict=bad"
#: Least share of labelled URLs with a combination, least share of bad ones among them, and the chance, at most, of so many bad ones at the share overall.
SUPPORT, CONFIDENCE, CHANCE = 0.001, 0.6, 0.001
#: Items of a URL, at most, for whose combinations FP-growth lists all; with more in any URL, grown() leaves out what cannot become a rule.
ITEMS = 10
RESULT = ("host", "path", "rule", "mined", "verdict")


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_path(url: Column) -> tuple[Column, Column]:
    after = F.coalesce(rest(url), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def given(host: Column, path: Column, rules=GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL. Numbers count as one token; the scheme and the fragment are left out."""
    host, path = host_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(lower_ascii(path), r"[^a-z0-9]+"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(rest(url), r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("h="), x)),
            F.transform(words, lambda x: F.concat(F.lit("p="), F.regexp_replace(x, r"^\d+$", "#"))),
            F.transform(query, lambda x: F.concat(F.lit("q="), lower_ascii(F.regexp_extract(x, r"^([^=]*)", 1)))),
        )
    )


def itemised(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(u, tokens, bad) -> (names, bad): each URL's items, those first whose own share of bad URLs differs most from the share overall, by chi-squared; and (token, n): the items and in how many URLs they are."""
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    each = rows.select("u", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    # Two sums of hashes of the URLs tell sets of URLs apart.
    marks = [F.sum(F.xxhash64("u", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    per = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), *marks).where((F.col("n") >= least) & (F.col("n") < total))
    away = F.col("b") - F.col("n") * (bad / max(total, 1))
    kinds = few(written(per.groupBy("n", "b", "s1", "s2").agg(F.min("token").alias("token")).select("token", "n", (-away * away / F.col("n")).alias("rank"))))
    found = each.join(kinds, "token").groupBy("u").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("best"))
    names = F.coalesce(F.transform("best", lambda x: x["token"]), F.array().cast("array<string>"))
    # A bad URL without items still counts as one that is bad.
    return rows.select("u", "bad").join(found, "u", "left").select(names.alias("names"), "bad").where("bad OR size(names) > 0"), kinds.select("token", "n")


def is_rule(hits, good, base: float, confidence: float, chance: float):
    """Whether so many bad and good URLs make a rule. With more bad or fewer good ones, a rule stays one."""
    hits, good = np.asarray(hits, float), np.asarray(good, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        n, c = hits + good, hits / (hits + good)
        divergence = c * np.log(c / base) + np.where(good > 0, (1 - c) * np.log((1 - c) / (1 - base)), 0.0)
        return (c >= confidence) & (c > base) & (n * divergence >= -math.log(chance) - 1e-9)


def _grow(has: np.ndarray, h: np.ndarray, g: np.ndarray, least: int, rule) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """(items, bad, good) of the combinations that may be rules which stay, of URLs (rows of ``has``: which items they have) that are h times bad and g times good.

    Left out is, with all that contains it, what has too few bad URLs; and what has an item without which it has the same good ones, as it is covered without that item.
    Of an item and those after it, nothing is tried if even without all good URLs that lack any of them there are too many for a rule.
    """
    stack = [((), np.arange(len(has)), np.arange(has.shape[1]), [])]
    while stack:
        chosen, rows, items, alone = stack.pop()  # alone: for each chosen item the good URLs that lack only this one
        here = has[np.ix_(rows, items)]
        hits, good = h[rows] @ here, g[rows] @ here
        ok = (hits >= least) & (good < g[rows].sum())
        for x in alone:
            ok &= has[np.ix_(x, items)].any(0)
        items, hits, good, here = items[ok], hits[ok], good[ok], here[:, ok]
        if not len(items):
            continue
        fewest = g[rows] @ np.logical_and.accumulate(here[:, ::-1], axis=1)[:, ::-1]
        hopeful = rule(np.maximum.accumulate(hits[::-1])[::-1], fewest)
        is_one = rule(hits, good)
        for i in np.flatnonzero(hopeful).tolist():
            with_it = here[:, i]
            found = (*chosen, int(items[i]))
            if is_one[i]:
                yield found, int(hits[i]), int(good[i])
            lacks = rows[~with_it]
            stack.append((found, rows[with_it], items[i + 1 :], [*(x[has[x, items[i]]] for x in alone), lacks[g[lacks] > 0]]))


def grown(urls: DataFrame, least: int, base: float, confidence: float, chance: float) -> DataFrame:
    """(names, bad) -> (needs, hits, n): all combinations that are rules, but for some that a shorter one covers.

    As FP-growth does it: URLs with the same items are one, and an item meets, in a task of its own, the items after it in the URLs that have it.
    """
    counted = urls.groupBy("names").agg(F.count_if("bad").alias("h"), F.count_if(~F.col("bad")).alias("g"))
    each = counted.select("h", "g", "names", F.posexplode("names").alias("at", "first"))
    each = each.groupBy("first", F.slice("names", F.col("at") + 2, F.size("names")).alias("rest")).agg(F.sum("h").alias("h"), F.sum("g").alias("g"))

    def rules(first: tuple[str], group: pd.DataFrame) -> pd.DataFrame:
        rule = lambda hits, good: is_rule(hits, good, base, confidence, chance)
        rest = [list(x) for x in group["rest"]]
        # The order of the items is that of all URLs: one that comes before another does so in each.
        before: dict[str, set[str]] = {}
        for x in rest:
            for a, b in zip(x, x[1:], strict=False):
                before.setdefault(a, set())
                before.setdefault(b, set()).add(a)
            if x:
                before.setdefault(x[0], set())
        names = list(TopologicalSorter(before).static_order())
        number = {x: i for i, x in enumerate(names)}
        has = np.zeros((len(rest), len(names)), bool)
        for i, x in enumerate(rest):
            has[i, [number[y] for y in x]] = True
        h, g = group["h"].to_numpy(np.int64), group["g"].to_numpy(np.int64)
        found = [((), int(h.sum()), int(g.sum()))] if h.sum() >= least and rule(h.sum(), g.sum()) else []
        found += _grow(has, h, g, least, rule)
        needs = [sorted([first[0], *(names[i] for i in x)]) for x, _, _ in found]
        return pd.DataFrame({"needs": pd.Series(needs, dtype=object), "hits": pd.Series([x for _, x, _ in found], dtype="int64"), "n": pd.Series([x + y for _, x, y in found], dtype="int64")})

    return each.groupBy("first").applyInPandas(rules, "needs array<string>, hits long, n long")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, chance: float = CHANCE, most: int = ITEMS) -> DataFrame:
    """(tokens, bad) -> (rule_id, needs, rarest, confidence, support): rules that imply a bad URL.

    Rules are pruned by support, confidence and significance, which ask the same of any share of bad URLs, and where a shorter one with no less confidence covers them.
    """
    rows = written(labelled.where(F.col("bad").isNotNull()).select(F.monotonically_increasing_id().alias("u"), "tokens", "bad"))
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    least = max(math.ceil(support * total), 1)
    urls, counts = itemised(rows, least)
    urls = written(urls)
    size, widest = urls.agg(F.count("*"), F.max(F.size("names"))).first()
    if not bad or not size:
        return rows.select(F.lit("").alias("rule_id"), F.array(F.lit("")).alias("needs"), F.lit("").alias("rarest"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    if widest > most:
        found = written(grown(urls, least, bad / total, confidence, chance))
    else:
        items = urls.select(F.concat("names", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
        sets = FPGrowth(itemsCol="items", minSupport=min(least / size, 1.0)).fit(items).freqItemsets
        sets = written(sets.select(F.sort_array(F.array_remove("items", BAD)).alias("needs"), F.array_contains("items", BAD).alias("bad"), F.col("freq")).where(F.size("needs") > 0))
        both = sets.where("bad").select("needs", F.col("freq").alias("hits"))
        found = both.join(sets.where("not bad").select("needs", F.col("freq").alias("n")), "needs")
    c, n, base = F.col("hits") / F.col("n"), F.col("n"), bad / total
    lift = c / base
    found = found.where((c >= confidence) & (lift > 1))
    # Chernoff's bound: so large a share of bad ones among n has a chance of exp(-n * divergence) at most.
    divergence = c * F.log(lift) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - base))).otherwise(0.0)
    found = found.where(n * divergence >= -math.log(chance))
    rules = written(found.select("needs", c.alias("confidence"), (F.col("hits") / total).alias("support")))
    # One token less, and that rule as good: the longer one adds nothing.
    less = rules.where(F.size("needs") > 1).select("needs", "confidence", F.explode(F.transform("needs", lambda x: F.array(x))).alias("drop"))
    less = less.select("needs", F.col("confidence").alias("c"), F.array_except("needs", "drop").alias("short"))
    worse = less.join(rules.select(F.col("needs").alias("short"), "confidence"), "short").where("confidence >= c").select("needs").distinct()
    rules = rules.join(worse, "needs", "left_anti")
    rare = rules.select("needs", F.explode("needs").alias("token")).join(counts, "token").groupBy("needs").agg(F.min_by("token", F.struct("n", "token")).alias("rarest"))
    return written(rules.join(rare, "needs").select(F.array_join("needs", " ").alias("rule_id"), "needs", "rarest", "confidence", "support"))


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id", label_id: str = "doc_id", label: str = "quality", bad: int = 0, rules=GIVEN, **prune) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, mined (the best mined rule that fits, or null) and verdict."""
    host, path = host_path(F.col("url"))
    seen = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    seen = seen.withColumns({"host": host, "path": path, "tokens": tokens(F.col("url")), "uid": F.monotonically_increasing_id()})
    rule, verdict = given(F.col("host"), F.col("path"), rules)
    seen = written(seen.withColumns({"rule": rule, "given": verdict}))
    marks = labels.select(F.col(f"`{label_id}`").alias("l"), F.when(F.col(f"`{label}`").isin(0, 1), F.col(f"`{label}`") == bad).alias("bad"))
    mined = mine(seen.join(marks, F.col("page_id") == F.col("l")).select("tokens", "bad"), **prune)
    index = few(mined).select("rarest", "needs", F.col("confidence").alias("conf"), "rule_id")
    # Only URLs that no given rule decides are asked; each at most once per rule whose rarest token it has.
    open_ = seen.where("given is null").select("uid", "tokens", F.explode("tokens").alias("token"))
    hits = open_.join(index, F.col("token") == F.col("rarest")).where(F.size(F.array_except("needs", "tokens")) == 0)
    best = hits.groupBy("uid").agg(F.max_by("rule_id", F.struct("conf", "rule_id")).alias("mined"))
    out = seen.join(best, "uid", "left")
    verdict = F.coalesce("given", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "url", "host", "path", "rule", "mined", verdict.alias("verdict"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return judge(pages, labels).select("page_id", "host", "path", "rule", "verdict", "mined")
