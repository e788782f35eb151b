from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from test_mixing_and_hosts import plain_targets

import corpus_pipeline
from clipquarry.llm import bpe, exact_dedup, kneser_ney


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "mixture", "tokens"]


def test_stages_take_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        out = stage(spark, given, small)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = [x.doc_id for x in docs.select("doc_id").collect()]
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            verdicts = {x.doc_id: x.kept for x in kneser_ney.classify(given, labels).collect()}
            assert sorted(ids) == sorted(i for i, kept in verdicts.items() if kept) and len(ids) < before
            good = {x.doc_id for x in labels.where("quality = 1").collect()}
            assert len(good - set(ids)) <= 0.01 * len(good)
        elif name == "exact_copies":
            texts: dict[str, int] = {}
            for x in given.collect():
                t = exact_plain(x.text)
                texts[t] = min(texts.get(t, x.doc_id), x.doc_id)
            assert sorted(ids) == sorted(texts.values())
        elif name == "near_copies":
            assert sorted(ids) == plain_near([(x.doc_id, x.text) for x in given.collect()])
        elif name == "mixture":
            assert sorted(ids) == plain_mix([(x.doc_id, x.text, x.source) for x in given.collect()])
        else:
            enc = bpe.encoder(open(bpe.default_ranks(), "rb").read(), bpe.default_pattern())
            texts = {x.doc_id: x.text for x in given.collect()}
            for x in docs.collect():
                want = np.array(enc.encode_ordinary(texts[x.doc_id]), "<u4").tobytes()
                assert bytes(x.token_ids) == want and x.n_tokens * 4 == len(want) and x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()
    assert exact_dedup is not None


def plain_near(rows):
    """The smallest id of each component of texts with four fifths of their five-word runs in common, by counting what every two texts share."""
    runs, at = {}, {}
    for i, t in rows:
        w = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() if t else []
        k = min(5, len(w))
        runs[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        for x in runs[i]:
            at.setdefault(x, []).append(i)
    up = {i: i for i in runs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in runs:
        for j, both in Counter(j for x in runs[i] for j in at[x] if j < i).items():
            if 100 * both >= 80 * (len(runs[i]) + len(runs[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return sorted(i for i in up if top(i) == i)


def plain_mix(rows):
    """The ids, as often as the mix takes them, source by source in the order of their odds."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    of = {}
    for i, _, s in rows:
        of.setdefault(s, []).append(i)
    goal = plain_targets({s: sum(size[i] for i in ids) for s, ids in of.items()})
    out = []
    for s, ids in of.items():
        whole = sum(size[i] for i in ids)
        expected = min(goal[s] / whole, 2.0) if whole else 0.0
        sure, p = int(expected), expected - int(expected)
        u = {i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48) for i in ids}
        ahead, need = 0, goal[s] - sure * whole
        taken = {i: sure for i in ids}
        if p > 0:
            for i in sorted((i for i in ids if size[i]), key=lambda i: ((u[i] / (1 - u[i])) / (p / (1 - p)), i)):
                if ahead + size[i] / 2 > need:
                    break
                taken[i] += 1
                ahead += size[i]
        out += [i for i, n in taken.items() for _ in range(n)]
    return sorted(out)


def exact_plain(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
