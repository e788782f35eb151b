from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from clipquarry.llm import host_rules, mixing


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in order if s not in fixed}
        if not rest:
            return fixed
        left = total - sum(fixed.values())
        fair = {s: left * x / sum(rest.values()) for s, x in rest.items()}
        over = {s: most * sizes[s] for s in rest if fair[s] > most * sizes[s]}
        if not over:
            return fixed | fair
        fixed |= over


def test_targets_sizes_and_limits(docs):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(["x"] * int(r.integers(0, 60))), None, ["a", "b", "c", "d", None][int(r.integers(0, 5))]) for i in range(600)] + [(900, None, None, "a")]
    got = mixing.mix(docs(rows)).collect()
    sizes, taken = Counter(), Counter()
    for x in got:
        assert x.size == len((x.text or "").split()) and x.taken == x.copies * x.size and x.taken <= 2 * x.size
        sizes[x.source] += x.size
        taken[x.source] += x.taken
    want = plain_targets(dict(sizes))
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
    assert all(abs(taken[s] - want[s]) <= 31 for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(rows).repartition(7)).collect()), key=str)
    assert mixing.copies(mixing.mix(docs(rows))).count() == sum(x.copies for x in got)
    thin = mixing.mix(docs(rows), keep_rows=False)
    assert thin.columns == ["doc_id", "source", *mixing.RESULT] and sorted((x.doc_id, x.copies, x.target) for x in thin.collect()) == sorted((x.doc_id, x.copies, x.target) for x in got)


def test_buckets_change_nothing(docs, monkeypatch):
    rows = [(i, "x " * (i % 17), None, "ab"[i % 2]) for i in range(400)]
    a = {x.doc_id: x.taken for x in mixing.mix(docs(rows)).collect()}
    monkeypatch.setattr(mixing, "BUCKET", 16)
    assert {x.doc_id: x.taken for x in mixing.mix(docs(rows)).collect()} == a


def test_weights_shift_copies(spark):
    rows = [(i, "x x x x", "s", 1.0 if i % 2 else 3.0) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    got = mixing.mix(d, weight="quality", share=0.5).collect()
    by = defaultdict(int)
    for x in got:
        by[x.quality] += x.copies
    assert by[3.0] > 2 * by[1.0] and abs(sum(x.taken for x in got) - 800) <= 4


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).count() == 0
    assert [x.taken for x in mixing.mix(docs([(1, "", None, "a"), (2, None, None, None)])).collect()] == [0, 0]


def plain_figures(text):
    words = (text or "").split()
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeat = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat)


def test_figures_equal_plain(docs):
    r = np.random.default_rng(3)
    alphabet = ["a", "b", "c#", "é𝄞", "\n", "a\n", "|"]
    rows = [(i, " ".join(r.choice(alphabet, r.integers(0, 40)))) for i in range(150)] + [(500, None), (501, ""), (502, " \n \n"), (503, "a a a a"), (504, "x\n\nx\n")]
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in host_rules.judge(docs(rows)).collect()}
    assert got == {i: plain_figures(t) for i, t in rows}


def plain_rates(hosts):
    """The rates by a plain reading of the moments: {host: (documents, failures)} -> {host: rate}."""
    n, k = sum(d for d, _ in hosts.values()), sum(f for _, f in hosts.values())
    p, room = k / n, n - sum(d * d for d, _ in hosts.values()) / n - (len(hosts) - 1)
    r = 0.0
    if 0 < p < 1 and room > 0:
        between = sum(d * (f / d - p) ** 2 for d, f in hosts.values()) / (p * (1 - p))
        r = min(max((between - (len(hosts) - 1)) / room, 0.0), len(hosts) / (len(hosts) + 1))
    return {h: (r * f + (1 - r) * p) / (r * d + 1 - r) for h, (d, f) in hosts.items()}


def rates(spark, hosts):
    rows = [(h, i < f) for h, (d, f) in hosts.items() for i in range(d)]
    return {x.host: x.host_rate for x in host_rules.host_rates(spark.createDataFrame(rows, "host string, base_failed boolean").repartition(3)).collect()}


def test_rates_equal_plain(spark):
    r = np.random.default_rng(6)
    for case in range(4):
        hosts = {f"h{i}": (int(d), int(r.binomial(d, r.beta(*[(1, 3), (0.2, 0.2), (50, 50), (5, 1)][case])))) for i, d in enumerate(r.integers(1, 40, 25))}
        assert rates(spark, hosts) == pytest.approx(plain_rates(hosts), abs=1e-8)


def test_few_documents_say_little(spark):
    one = rates(spark, {f"h{i}": (1, i % 2) for i in range(100)})
    assert all(x == 0.5 for x in one.values())  # one document each is no evidence that hosts differ
    alike = rates(spark, {f"h{i}": (20, 10) for i in range(30)})
    assert all(x == 0.5 for x in alike.values())
    apart = rates(spark, {f"h{i}": (200, 190 if i % 2 else 10) for i in range(30)} | {"new": (1, 1)})
    assert apart["h1"] > apart["new"] > 0.5 and apart["new"] < 0.95 and apart["h0"] < 0.1
    assert set(rates(spark, {"a": (3, 3), "b": (2, 2)}).values()) == {1.0} and rates(spark, {"a": (3, 1)})["a"] == pytest.approx(1 / 3, abs=1e-8)


def test_the_prior_is_found(spark):
    """Hosts drawn from a beta distribution: the shrunk rates are nearer to the true ones than raw rates are, and about as near as with the true prior."""
    r = np.random.default_rng(7)
    true = r.beta(2, 4, 400)
    docs_ = r.integers(1, 12, 400)
    failed = r.binomial(docs_, true)
    got = rates(spark, {f"h{i}": (int(d), int(f)) for i, (d, f) in enumerate(zip(docs_, failed))})
    error = lambda x: float(np.mean((x - true) ** 2))
    mine = error(np.array([got[f"h{i}"] for i in range(400)]))
    assert mine < 0.6 * error(failed / docs_) and mine < 1.05 * error((failed + 2) / (docs_ + 6))


def test_bad_hosts_take_their_documents_along(docs):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, None, "good") for i in range(60)] + [(100 + i, "short" if i % 10 else good, None, "bad") for i in range(60)] + [(300, good, None, None), (301, "short", None, "one")]
    got = {x.doc_id: x for x in host_rules.judge(docs(rows)).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[100 + i].kept for i in range(60)) and got[110].base_failed is False
    assert got[300].kept and got[300].host is None
    # One failure of one document says little: its rate is drawn towards the others'.
    assert got[301].host_rate < 1 and not got[301].kept
    assert host_rules.judge(docs([])).count() == 0
