from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipquarry.llm import exact_dedup, near_dedup
from clipquarry.llm.groups import components


def test_equal_but_for_white_space(docs):
    d = docs([(3, "a  b"), (1, "a\tb"), (2, "a b "), (4, None), (5, ""), (None, "a b"), (7, "A b"), (1, "a\tb")])
    got = {(x.doc_id, x.text): (x.keep_id, x.group_size, x.kept) for x in exact_dedup.annotate(d).collect()}
    assert got[3, "a  b"] == (1, 4, False) and got[1, "a\tb"] == (1, 4, True) and got[None, "a b"] == (1, 4, False)
    assert got[2, "a b "] == (2, 1, True) and got[4, None] == (4, 2, True) and got[5, ""] == (4, 2, False) and got[7, "A b"] == (7, 1, True)
    left = exact_dedup.survivors(d)
    assert left.columns == d.columns and sorted(x.doc_id for x in left.collect()) == [1, 2, 4, 7]


@pytest.mark.parametrize("counters", [1, 2, 8, 1000])
def test_any_number_of_counters_gives_the_same(docs, counters):
    r = np.random.default_rng(0)
    rows = [(i, f"text {min(int(r.exponential(3)), 30)}") for i in range(300)]
    got = {x.doc_id: (x.keep_id, x.group_size) for x in exact_dedup.annotate(docs(rows).repartition(5), counters=counters, keep_text=False).collect()}
    want = {}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        want[i] = (min(same), len(same))
    assert got == want
    assert exact_dedup.survivors(docs(rows), counters=counters).count() == len({t for _, t in rows})


def test_clashing_names(spark):
    from clipquarry.llm import bpe, kneser_ney, mixing

    names = ["h", "c", "d", "n", "id", "row", "size", "source_size", "rank", "bucket", "at", "w", "s", "t", "keep_id", "KEPT", "component", "decoded", "token_ids", "trusted"]
    rows = [(i, f"some text {i % 3} " * 20, "en", "src") + tuple(str(i) for _ in names) for i in range(9)]
    d = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert exact_dedup.survivors(d).columns == d.columns
    assert exact_dedup.annotate(d).where("kept").count() == exact_dedup.survivors(d).count() == 3
    assert near_dedup.survivors(d).columns == d.columns and near_dedup.survivors(d).count() >= 1
    assert mixing.copies(mixing.mix(d)).where("doc_id = cast(h AS long)").count() >= 9
    assert kneser_ney.accepted(d, labels).columns == d.columns
    assert bpe.encode_decode(d).where("h = cast(doc_id AS string) and octet_length(decoded) = length(text)").count() == 9


def test_heavy_digests_are_found(spark):
    keys = spark.createDataFrame([(bytes([i % 5 if i % 2 else 9]), i) for i in range(1000)], "d binary, doc_id long").repartition(7)
    got = {bytes(x.h): x.group_size for x in exact_dedup.heavy(keys, 4).collect()}
    assert got == {b"\x09": 500}


def test_empty_table(docs):
    none = docs([])
    assert exact_dedup.annotate(none).count() == 0 and exact_dedup.survivors(none).count() == 0
    assert near_dedup.link(none).count() == 0 and near_dedup.survivors(none).count() == 0


def plain_set(text, size):
    w = [x.lower() for x in (text or "").split()]
    k = min(size, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()


def plain_components(rows, size, percent):
    sets = {i: plain_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(r, words, share):
    return [f"w{r.integers(10**6)}" if r.random() < share else w for w in words]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_copies_equal_plain(docs, monkeypatch, size, percent):
    r = np.random.default_rng(size)
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in r.integers(0, 40, r.integers(1, 120))]
        for _ in range(int(r.integers(1, 9))):
            rows.append((len(rows), " ".join(edited(r, base, r.choice([0, 0.005, 0.02, 0.05])))))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "two one")]
    want = plain_components(rows, size, percent)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.link(docs(rows), size=size, percent=percent).collect()}
    assert got == want
    # Nodes that branch, blocks and split clusters change nothing.
    monkeypatch.setattr(near_dedup, "NODE", 4)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.link(docs(rows), size=size, percent=percent).collect()} == want
    left = near_dedup.survivors(docs(rows), size=size, percent=percent)
    assert sorted(x.doc_id for x in left.collect()) == sorted({c for _, c in want.values()}) and "kept" in left.columns


def plain_rows(rows, size, percent):
    """(id, set size, component) of each row, sorted, where an id may occur with several texts: those with words are linked by it too."""
    sets = [plain_set(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and (rows[a][0] == rows[b][0] or 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return sorted(((i, len(sets[a]), min(rows[b][0] for b in range(len(rows)) if top(b) == top(a))) for a, (i, _) in enumerate(rows)), key=str)


def test_repeated_ids_equal_plain(docs):
    r = np.random.default_rng(8)
    text = {k: " ".join(f"w{x}" for x in r.integers(0, 1000, 30)) for k in "ABCDE"}
    rows = [(1, "A"), (1, "B"), (2, "B"), (3, "A"), (4, "C"), (5, "C"), (5, "D"), (6, "D"), (7, "E"), (7, "E"), (8, "E")]
    rows = [(i, text[k]) for i, k in rows] + [(9, None), (9, text["E"]), (10, "")]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.link(docs(rows).repartition(3), size=3, percent=85).collect()), key=str)
    assert got == plain_rows(rows, 3, 85)
    assert {c for i, _, c in got if i in (1, 2, 3)} == {1} and {c for i, _, c in got if i in (4, 5, 6)} == {4}
    left = near_dedup.survivors(docs(rows), size=3, percent=85).collect()
    assert sorted({x.doc_id for x in left}) == [1, 4, 7, 10]


def test_large_alike_nodes(docs, monkeypatch):
    """Families that no branching parts go through blocks beside each other; a stray one goes through all pairs."""
    r = np.random.default_rng(9)
    base = [f"w{x}" for x in r.integers(0, 10**6, 300)]
    rows = [(i, " ".join([*base[:150], f"x{i}", *base[151:]])) for i in range(60)]
    rows += [(100 + i, " ".join(base[: 260 + i])) for i in range(6)]
    want = plain_components(rows, 5, 80)
    monkeypatch.setattr(near_dedup, "NODE", 6)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.link(docs(rows)).collect()} == want


@pytest.mark.parametrize(("size", "percent"), [(3, 85)])
def test_recall_just_above_the_threshold(docs, size, percent):
    """Thousands of pairs with a similarity between the threshold and 2.5 points above: nearly all are linked, and none below it is."""
    r = np.random.default_rng(10)
    rows, above = [], 0
    while len(rows) < 4000:
        a = [f"w{x}" for x in r.integers(0, 10**9, int(r.integers(120, 260)))]
        b = list(a)
        for at in r.choice(len(a), int(r.integers(2, 8)), replace=False):
            b[at] = "new"
        x, y = plain_set(" ".join(a), size), plain_set(" ".join(b), size)
        share = 100 * len(x & y) / len(x | y)
        if percent - 2.5 <= share <= percent + 2.5:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
            above += share >= percent
    got = {x.doc_id: x.component_id for x in near_dedup.link(docs(rows).repartition(4), size=size, percent=percent).collect()}
    linked = 0
    for i in range(0, len(rows), 2):
        x, y = plain_set(rows[i][1], size), plain_set(rows[i + 1][1], size)
        if got[i + 1] == i:
            assert 100 * len(x & y) >= percent * len(x | y)
            linked += 1
    assert linked >= 0.995 * above > 500


def test_rows_without_id_stay(docs):
    got = near_dedup.link(docs([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "a b c d")]), size=3, percent=85).collect()
    assert sorted((x.doc_id or -1, x.kept) for x in got) == [(-1, True), (-1, True), (5, True), (5, True), (6, False)]


def test_components(spark):
    r = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + int(a), 100 + int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(300, 300)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {x.id: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_tell_similar_sets(spark):
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 400, np.uint64)
    b = np.r_[a[:370], r.integers(0, 2**63, 30, np.uint64)]
    x, y = (np.frombuffer(near_dedup.sketch(np.unique(s))[1], np.uint8) for s in (a, b))
    assert abs((x == y).mean() - 370 / 430) < 0.12
    assert F is not None
