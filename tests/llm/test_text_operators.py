from __future__ import annotations

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from clipquarry.llm import bpe, kneser_ney, secret_scan, toxicity, url_rules


# Byte-level BPE


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(open(bpe.default_ranks(), "rb").read(), bpe.default_pattern())


def test_round_trip(docs, enc):
    texts = ["", None, "Hello world's  end\n\n  x", "é𝄞 ß\u2028 <|endoftext|>", "a" * 3000, " " * 9000 + "b", "x\t" * 3000, "\n" * 5000, "it's " * 30_000]
    got = {x.doc_id: x for x in bpe.encode_decode(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        ids = np.frombuffer(got[i].token_ids, "<u4").tolist()
        assert bytes(got[i].decoded) == (t or "").encode()
        if len(t or "") < 9000:
            assert ids == enc.encode_ordinary(t or "")
    again = bpe.decode(bpe.encode(docs(list(enumerate(texts))))).collect()
    assert all(bytes(x.decoded) == (texts[x.doc_id] or "").encode() for x in again)


def test_cuts_do_not_show(enc, monkeypatch):
    r = np.random.default_rng(0)
    parts = ["word", "it's", " ", "  ", "\n", "12", "!?", "é", "\t ", "a b", " " * 20, "'", "'ve", "漢字", "。", "e\u0301", "١٢", "½"]
    monkeypatch.setattr(bpe, "CHUNK", 8)
    monkeypatch.setattr(bpe, "LONG_SPACE", 6)
    monkeypatch.setattr(bpe, "_RUN", re.compile(r"\s{6,}"))
    for _ in range(300):
        text = "".join(r.choice(parts, 30))
        assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)


def test_white_space_that_the_library_cannot_take(enc):
    ids = bpe.encode_text(enc, "a" + " " * 1_000_000 + "b")
    assert enc.decode_bytes(ids) == b"a" + b" " * 1_000_000 + b"b"


def test_digest_query(spark, small, enc):
    got = {x.doc_id: x for x in bpe.op9_byte_bpe(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


# Secret scans

_BASE = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), 18), ("hex", re.compile(r"[0-9a-f]+"), 16))


def plain_base(text):
    out = []
    for k, (name, pattern, least) in enumerate(_BASE):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(2) if k == 0 else m.group()) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_equal_plain(docs, spark, small):
    r = np.random.default_rng(1)
    bits = ["token", "Secret", "API_KEY", "=", ": ", "'", '"', "abcdef0123456789", "AKIA", "ABCDEFGH12345678", " ", "é𝄞", "\n", "x.token: 'abcdefabcdefabcd'", "password"]
    rows = [(i, "".join(r.choice(bits, r.integers(0, 12)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "token=a.token: 'ABCDEFGHIJKLMNOP'")]
    rows += [(2000 + x.doc_id, x.text) for x in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {x.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in x.spans if s.kind != "random") for x in secret_scan.scan(docs(rows)).collect()}
    assert got == {i: plain_base(t) for i, t in rows}


def plain_p(token):
    name = next((k for k, v in secret_scan.ENCODINGS.items() if re.search(v[0], token)), None)
    if name is None:
        return None
    _, size, turn, effect = secret_scan.ENCODINGS[name]
    body = token.rstrip("=")
    n = len(body)
    x2 = size / n * sum(c * c for c in Counter(body).values()) - n
    away = effect * n
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+"
    runs = 1 + sum(kind(a) != kind(b) for a, b in zip(body, body[1:]))
    v = np.array([ord(c) for c in body], float)
    r = min(abs(np.corrcoef(v[:-1], v[1:])[0, 1]), 0.999)
    zs = ((size - 1 + away - x2) / math.sqrt(2 * (size - 1 + 2 * away)), (runs - 1 - (n - 1) * turn / 2) / math.sqrt((n - 1) * turn / 2 * (1 - turn / 2)), (math.atanh(0.8) - math.atanh(r)) * math.sqrt(max(n - 4, 1)))
    return max(math.exp(-z * z / 2) / 2 if z > 0 else 1.0 for z in zs)


def test_p_values_equal_plain_and_random_strings_are_found(docs):
    r = np.random.default_rng(2)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    secrets = ["".join(r.choice(alphabet, 44)) for _ in range(20)]
    words = ["ThisIsAnOrdinaryIdentifierName", "internationalisation_of_things", "ABCDEFGHIJKLMNOPQRSTUVWXYZ2345", "aaaaaaaaaaaaaaaaaaaaaaaaaaa1B", "VerylongGermanCompoundword" * 2]
    rows = [(i, f"see {s} there") for i, s in enumerate(secrets)] + [(100 + i, f"see {w} there") for i, w in enumerate(words)]
    found = {x.doc_id: x.p for x in secret_scan.find(docs(rows)).collect() if x.p is not None}
    for i, t in rows:
        want = plain_p(t.split()[1])
        assert (found.get(i) is None) == (want is None) and (want is None or found[i] == pytest.approx(want, rel=1e-6))
    got = {x.doc_id: [(s.start, s.end) for s in x.spans if s.kind == "random"] for x in secret_scan.scan(docs(rows)).collect()}
    assert all(got[i] == [(4, 48)] for i in range(20)) and not any(got[100 + i] for i in range(len(words)))
    assert secret_scan.scan(docs([])).count() == 0


def test_discoveries_equal_plain(docs):
    """Benjamini-Hochberg by hand, over the p values of each stratum in bins of a twentieth of a decade."""
    r = np.random.default_rng(9)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    parts = ["Quick", "brown", "Fox", "jumps", "Over", "lazy", "Dog", "handler", "Factory", "Config", "2024", "x86", "v2"]
    rows = []
    for i in range(500):
        if i % 3 == 0:
            a = list(alphabets[i % 9 // 3])
            token = "".join(r.choice(a, int(r.integers(20, 70))))
        else:
            token = "".join(r.choice(parts, int(r.integers(4, 9))))
        rows.append((i, f"see {token} there {token[::-1]}"))
    found = [x for x in secret_scan.find(docs(rows)).collect() if x.kind == 3 and x.p is not None]
    strata = defaultdict(list)
    for x in found:
        strata[x.encoding, x.long].append((min(math.floor(-20 * math.log10(x.p)), 400) if x.p else 400, x.doc_id, x.start, x.end))
    want = set()
    for spans in strata.values():
        bins = [s[0] for s in spans]
        good = [b for b in set(bins) if 10 ** (-b / 20) * len(bins) <= secret_scan.LEVEL * sum(c >= b for c in bins)]
        want |= {s[1:] for s in spans if good and s[0] >= min(good)}
    got = {(x.doc_id, s.start, s.end) for x in secret_scan.scan(docs(rows)).collect() for s in x.spans if s.kind == "random"}
    assert got == want and len(found) > len(want) > 50


def test_values_with_any_name_are_found(docs):
    r = np.random.default_rng(3)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    names = ["AWS_SECRET_ACCESS_KEY=", "client_key=", "sig=", "auth=", "https://a.example/x?key=", 'data-key="', "longNameWith2Digits4ItsValue="]
    rows, want = [], {}
    for i in range(42):
        name, value = names[i % len(names)], "".join(r.choice(alphabet, 40)) + "=" * (i % 3)
        rows.append((i, f"see {name}{value} there"))
        want[i] = (4 + len(name), 4 + len(name) + len(value))
    got = {x.doc_id: [(s.start, s.end) for s in x.spans if s.kind == "random"] for x in secret_scan.scan(docs(rows)).collect()}
    assert all(want[i] in got[i] for i in want)


# URL rules


def plain_url(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((len(h + p), h + p, v) for h, p, v in url_rules.GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def test_given_rules_equal_plain(spark):
    urls = [None, "", "nothing", "http://A.Example.NET/en/1?x", "http://example.net/EN/", "https://net", "https://x.net/", "http://example.com/de/x#y", "http://badexample.com/de/", "ftp://a.org/fr/", "http://É.org/fr/", "a://b://c.org/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: x for x in url_rules.judge(pages, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow")


def test_mined_rules_equal_plain(spark):
    r = np.random.default_rng(0)
    urls, bad = [], []
    for _ in range(600):
        host, word = r.choice(["pills", "shop", "news"]), r.choice(["buy", "read", "win"])
        urls.append(f"http://{host}.example.org/{word}/{r.integers(100)}")
        bad.append(r.random() < (0.95 if (host, word) == ("pills", "buy") else 0.05))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad) if i % 2], "doc_id long, quality int")
    got = {x.page_id: x.verdict for x in url_rules.judge(pages, labels, support=0.02).collect()}
    assert got == {i: "block" if "pills" in u and "/buy/" in u else "allow" for i, u in enumerate(urls)}


def plain_rules(rows, support, confidence, chance):
    """All combinations, counted one by one: {tokens: share of bad URLs} of the rules that stay."""
    from itertools import combinations

    total, bad = len(rows), sum(b for _, b in rows)
    least = max(math.ceil(support * total), 1)
    sets = {t: frozenset(i for i, (x, _) in enumerate(rows) if t in x) for x, _ in rows for t in x}
    first = {}
    for t in sorted(sets):
        if least <= len(sets[t]) < total:
            first.setdefault(sets[t], t)
    tokens, found = sorted(first.values()), {}
    for k in range(1, len(tokens) + 1):
        for c in combinations(tokens, k):
            at = frozenset.intersection(*(sets[t] for t in c))
            hits = sum(rows[i][1] for i in at)
            if hits < least:
                continue
            share, base = hits / len(at), bad / total
            if share < confidence or share <= base:
                continue
            divergence = share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)
            if len(at) * divergence >= -math.log(chance):
                found[c] = share
    return {c: s for c, s in found.items() if not any(found.get(tuple(t for t in c if t != x), -1) >= s for x in c)}


@pytest.mark.parametrize("seed", range(3))
def test_mining_equals_counting(spark, seed):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(250):
        x = [t for t in "abcdef" if r.random() < 0.5] + ["all"]
        x += ["twin"] if "a" in x else []
        rows.append((x, bool(r.random() < (0.9 if {"b", "c"} <= set(x) or seed == 2 and "d" in x else 0.2))))
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6, 0.001).collect()
    want = plain_rules(rows, 0.02, 0.6, 0.001)
    assert {tuple(x.needs): round(x.confidence, 9) for x in got} == {c: round(s, 9) for c, s in want.items()} and want


@pytest.mark.parametrize("n", [16, 40])
def test_templates_do_not_explode(spark, n):
    """URLs that share many path words, some of them with gaps, and one planted combination."""
    r = np.random.default_rng(n)
    words = [f"word{i}" for i in range(n)]
    urls, bad = [], []
    for i in range(300):
        mine = [w for w in words if i % 2 or r.random() < 0.9]
        pills, buy = bool(r.random() < 0.3), bool(r.random() < 0.3)
        urls.append(f"http://host.example.org/{'/'.join(mine)}/{'pills' if pills else 'news'}/{'buy' if buy else 'read'}/{i}")
        bad.append(r.random() < (0.97 if pills and buy else 0.03))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id long, quality int")
    began = time.perf_counter()
    got = {x.page_id: x.verdict for x in url_rules.judge(pages, labels, support=0.05, confidence=0.8).collect()}
    assert time.perf_counter() - began < 60
    assert got == {i: "block" if "/pills/buy/" in u else "allow" for i, u in enumerate(urls)}


@pytest.mark.parametrize("seed", range(3))
def test_mining_of_many_items_equals_counting(spark, seed):
    """URLs of more items than FP-growth lists, and rules of items that tell little by themselves."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(300):
        x = [t for t in "abcdefghijklmn" if r.random() < (0.5 if t in "kl" else 0.9)]
        # k and l tell nothing by themselves.
        rows.append((x, bool(r.random() < (0.9 if ("k" in x) == ("l" in x) else 0.2))))
    assert max(len(x) for x, _ in rows) > url_rules.ITEMS
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.05, 0.6, 0.01).collect()
    want = plain_rules(rows, 0.05, 0.6, 0.01)
    assert {tuple(x.needs): round(x.confidence, 9) for x in got} == {c: round(s, 9) for c, s in want.items()} and want


def test_mined_rules_where_most_urls_are_bad(spark):
    r = np.random.default_rng(1)
    rows = [(f"http://{('pills', 'shop', 'news')[i % 3]}.example.org/{r.choice(['buy', 'read', 'win'])}/{i}", i % 3 == 0 or bool(r.random() < 0.4)) for i in range(900)]
    assert 0.55 < np.mean([b for _, b in rows]) < 0.65
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b)) for i, (_, b) in enumerate(rows)], "doc_id long, quality int")
    got = {x.page_id: x.verdict for x in url_rules.judge(pages, labels, support=0.02).collect()}
    assert got == {i: "block" if "pills" in u else "allow" for i, (u, _) in enumerate(rows)}


# Quality


def plain_kneser_ney(texts, order=4):
    counts = [Counter() for _ in range(order + 1)]
    table = kneser_ney.classes()
    symbols = lambda t: [0] * (order - 1) + [int(table[ord(c)]) for c in t]
    for t in texts:
        s = symbols(t)
        counts[order].update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, sums, left = [None], [None], [None]
    for k in range(1, order + 1):
        n = Counter(min(c, 5) for c in counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cuts.append([0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05 * i), float(i)) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)])
        total, back = defaultdict(float), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            back[g[:-1]] += cuts[k][min(c, 3)]
        sums.append(total)
        left.append(back)

    def p(g):
        if not g:
            return 1 / 64
        k, h = len(g), g[:-1]
        if not sums[k][h]:
            return p(g[1:])
        c = counts[k][g]
        return (c - cuts[k][min(c, 3)] if c else 0) / sums[k][h] + left[k][h] / sums[k][h] * p(g[1:])

    def log_perplexity(t):
        s = symbols(t)
        return -sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))) / len(t)

    return log_perplexity


def test_perplexity_equals_plain(docs, spark):
    r = np.random.default_rng(0)
    words = ["the", "of", "Année", "house", "x1", "walk", "ein", "\n", "end."]
    rows = [(i, " ".join(r.choice(words, r.integers(5, 60))), ["en", "fr", None][i % 3]) for i in range(60)]
    rows += [(100, "### $$$ %%% @@@ &&& ***" * 20, "en"), (101, None, "en"), (102, "", None), (103, "THE OF HOUSE!! WALK!! " * 30, "fr"), (104, "the of 𝄞 漢字", "de")]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100, 0), (None, 1), (3, 1), (50, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in kneser_ney.classify(docs(rows), labels).collect()}
    held = {x.doc_id for x in docs(rows).where("pmod(xxhash64(text), 8) = 0").collect()}
    assert 0 < len([i for i in held if i < 40]) < 20
    plain = plain_kneser_ney([t for i, t, _ in rows if i < 40 and i not in held])
    for i, t, _ in rows:
        assert got[i].log_perplexity == (pytest.approx(plain(t), rel=1e-4) if t else None)
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in (100, 101, 102, 103))
    kept = kneser_ney.accepted(docs(rows), labels)
    assert kept.columns == docs(rows).columns and {x.doc_id for x in kept.collect()} == {i for i in got if got[i].kept}
    assert kneser_ney.classify(docs([]), labels).count() == 0


@pytest.mark.parametrize("texts", [["abc abd abc xyz", "the end of the house"], ["a"], ["abcdefghijklmnopqrstuvwxyz " * 9], None])
def test_probabilities_sum_to_one(spark, small, texts):
    text = spark.createDataFrame([(t,) for t in texts], "text string") if texts else spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    seen, back, low = kneser_ney.train(text)
    p = (back.reshape(64, -1, 1) * low.reshape(1, -1, 64)).reshape(-1)
    rows = seen.toPandas()
    p[rows["k"].to_numpy()] += rows["a"].to_numpy()
    assert (p > 0).all() and np.allclose(p.reshape(-1, 64).sum(1), 1, atol=1e-9)


def test_packed_blocks_come_back():
    r = np.random.default_rng(3)
    size = kneser_ney.SIZE**kneser_ney.ORDER
    found = []
    for n in (0, 1, 500, 3000, 40, 0):
        k = np.unique(r.integers(0, size, n))
        found.append((k, np.where(r.random(len(k)) < 0.1, r.integers(1, 10**6, len(k)), r.integers(1, 4, len(k)))))
    got = [{} for _ in found]
    for shard, payload in kneser_ney.pack(16, found):
        docs_, keys, lengths, doc, often = kneser_ney.unpack(payload)
        assert docs_ == len(found) and (keys // (size // 16) == shard).all()
        for k, d, n in zip(np.repeat(keys, lengths).tolist(), doc.tolist(), often.tolist(), strict=True):
            got[d][k] = n
    assert got == [dict(zip(k.tolist(), n.tolist(), strict=True)) for k, n in found]
    assert list(kneser_ney.pack(16, [])) == [] and list(kneser_ney.pack(16, found[:1])) == []


def test_blocks_and_shards_change_nothing(docs, spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, " ".join(r.choice(["the", "of", "Haus", "###", "x1"], r.integers(0, 50))), ["en", "fr"][i % 2]) for i in range(200)] + [(300, "a" * 5000, "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(90)], "doc_id long, quality int")
    take = lambda: {x.doc_id: (x.n_symbols, round(x.log_perplexity or -1, 9)) for x in kneser_ney.classify(docs(rows).repartition(3), labels).collect()}
    want = take()
    for shards, block, per in ((1, 100, 50_000), (64, 1_000_000, 7)):
        for name, x in (("SHARDS", shards), ("BLOCK", block), ("BLOCK_DOCS", per)):
            monkeypatch.setattr(kneser_ney, name, x)
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        try:
            assert take() == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_other_scripts_are_judged(docs, spark):
    r = np.random.default_rng(4)
    letters = [chr(c) for c in range(0x430, 0x450)]
    stems = ["".join(r.choice(letters, r.integers(2, 5))) for _ in range(60)]
    text = lambda: " ".join("".join(r.choice(stems, r.integers(1, 4))) for _ in range(120))
    rows = [(i, text(), "ru") for i in range(600)]
    rows += [(1000 + i, "".join(r.choice([*letters, " "], 800)), "ru") for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(500)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in kneser_ney.classify(docs(rows), labels).collect()}
    assert np.mean([got[i] for i in range(500, 600)]) > 0.97 and not any(got[1000 + i] for i in range(40))


def plain_limits(rows, of_all):
    """(low, high) of each text length, as a function, from (log perplexity, symbols, sum of squares) of held texts; quantiles are values that occur."""
    at = lambda xs, q: sorted(xs)[max(math.ceil(q * len(xs)) - 1, 0)]
    values = [v for v, *_ in rows]
    long = [v for v, n, _ in rows if n >= 1000] or values
    middle, far = at(values, 0.5), max((at(long, 0.75) - at(long, 0.25)) / 1.349, 1e-6)
    total = sum(n for _, n, _ in rows)
    one = math.sqrt(max(sum(s for *_, s in rows) / total - (sum(v * n for v, n, _ in rows) / total) ** 2, 0))
    spread = lambda n: math.sqrt(far**2 + one**2 / n)
    z = [(v - middle) / spread(n) for v, n, _ in rows]
    least = 4.0 if of_all else 2.0
    below, above = min(at(z, 0.005) * 1.5, -least), max(at(z, 0.995) * 1.5, least)
    return lambda n: (middle + below * spread(n), middle + above * spread(n))


def test_thresholds_equal_plain(docs, spark):
    r = np.random.default_rng(11)
    words = {"en": ["the", "of", "house", "walk", "end."], "fr": ["le", "de", "maison", "année", "fin."], "de": ["der", "von", "haus"]}
    rows = [(i, " ".join(r.choice(words[lang], r.integers(3, 400))), lang) for i, lang in enumerate(["en"] * 700 + ["fr"] * 600 + ["de"] * 60 + ["en", "fr", "de"] * 20)]
    rows += [(5000, "### $$$ " * 9, "en"), (5001, "the the the " * 99, None), (5002, "", "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(1360)], "doc_id long, quality int")
    scored = kneser_ney.scores(docs(rows), labels, "text", "doc_id", "lang", "doc_id", "quality").collect()
    held = [(x.lang, (x.log_perplexity, x.n_symbols, x.squares)) for x in scored if x.part == 2]
    own = {lang: [v for k, v in held if k == lang] for lang in words}
    assert len(own["en"]) >= 50 <= len(own["fr"]) and 0 < len(own["de"]) < 50
    limits = {lang: plain_limits(v, False) for lang, v in own.items() if len(v) >= 50}
    rest = plain_limits([v for _, v in held], True)
    for x in kneser_ney.classify(docs(rows), labels).collect():
        low, high = limits.get(x.lang, rest)(max(x.n_symbols, 1))
        assert (x.low, x.high) == pytest.approx((low, high), rel=1e-6)
        assert x.kept == (x.n_symbols > 0 and x.low <= x.log_perplexity <= x.high)


def test_held_out_documents(spark):
    """A third of the labels is kept back: of its good documents nearly all stay, of its bad ones few."""
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = {x.doc_id: x.kept for x in kneser_ney.classify(spark.read.parquet(f"{data}/documents.parquet"), labels.where("doc_id % 3 <> 0")).collect()}
    held = {x.doc_id: x.quality for x in labels.where("doc_id % 3 = 0").collect()}
    assert np.mean([got[i] for i, q in held.items() if q == 1]) >= 0.99 and np.mean([got[i] for i, q in held.items() if q == 0]) <= 0.08


def test_rows_without_id_or_with_a_repeated_one_are_judged_each(docs, spark):
    r = np.random.default_rng(5)
    words = ["the", "of", "house", "walk", "end.", "and", "river"]
    good = lambda: " ".join(r.choice(words, 50))
    junk = "### $$$ %%% @@@ " * 30
    rows = [(i, good(), "en") for i in range(60)] + [(None, good(), "en"), (None, junk, "en"), (None, good(), None), (None, None, "en"), (70, good(), "en"), (70, junk, "en"), (71, junk, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    left = kneser_ney.accepted(docs(rows), labels).collect()
    assert sorted((x.doc_id or -1, x.text) for x in left) == sorted((i or -1, t) for i, t, _ in rows if t and t != junk)


# Toxicity


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    docs_ = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), {x.doc_id: x.toxic for x in labels.where("doc_id % 3 = 0").collect()}
    got = {x.doc_id: x for x in toxicity.score(docs_, train).collect()}
    hit = [got[i].toxic for i, t in held.items() if t == 1]
    false = [got[i].toxic for i, t in held.items() if t == 0]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.005
    assert all(0 <= x.severity <= 1 for x in got.values())


def test_severity_of_held_out_grades():
    """Four grades told by words that overlap between grades, in texts of ordinary words: expected severity follows the grade of documents not fitted."""
    r = np.random.default_rng(0)
    names = [["rude", "silly"], ["stupid", "liar"], ["scum", "filth"]]

    def text(grade):
        words = [f"w{x}" for x in r.zipf(1.4, r.integers(20, 90)) if x < 3000]
        return words + [w for k in range(grade) for w in r.choice(names[k], r.integers(0, 3))] + (["pardon"] if grade == 0 and r.random() < 0.3 else [])

    grades = r.choice(4, 3000, p=[0.7, 0.15, 0.1, 0.05])
    x = [toxicity.features(" ".join(text(g))) for g in grades]
    m = toxicity.fit([(int(g), f) for g, f in zip(grades[:2000], x[:2000])])
    assert (np.diff(m["thresholds"]) > 0).all()
    sev = np.array([toxicity.severity(m, f).sum() for f in x[2000:]])
    means = [sev[grades[2000:] == g].mean() for g in range(4)]
    assert (np.diff(means) > 0.3).all()
    # What harmless documents have draws severity down.
    plain = toxicity.features("w1 w2 rude")
    assert toxicity.severity(m, np.union1d(plain, toxicity.features("pardon"))).sum() < toxicity.severity(m, plain).sum()


def test_the_fit_is_the_least_loss():
    """Gradients equal differences of the loss, and no plain search around the solution finds less."""
    r = np.random.default_rng(1)
    n, width = 60, 5
    dense = (r.random((n, width)) < 0.4) * r.normal(1, 0.3, width)
    grade = np.clip((dense @ np.array([2, -1, 0, 0.5, 1]) + r.logistic(size=n)).astype(int), 0, 3)
    row, col = np.nonzero(dense)
    loss = toxicity.Loss(grade, np.full(n, 1 / n), row, col, dense[row, col], width, 1e-2)

    def plain(w, t):
        z = (dense @ w)[:, None] - t
        above = np.c_[np.ones(n), 1 / (1 + np.exp(-z)), np.zeros(n)]
        return -np.mean([math.log(above[i, g] - above[i, g + 1]) for i, g in enumerate(grade)]) + 0.005 * (w @ w)

    w, t = toxicity.solve(loss, np.array([0.5, 1.5, 3.0]), 2000)
    assert loss.at(w, t)[0] == pytest.approx(plain(w, t))
    _, dw, dt = loss.at(w + 0.1, t)
    for k in range(width):
        step = np.eye(width)[k] * 1e-6
        assert dw[k] == pytest.approx((plain(w + 0.1 + step, t) - plain(w + 0.1 - step, t)) / 2e-6, abs=1e-6)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert dt[k] == pytest.approx((plain(w + 0.1, t + step) - plain(w + 0.1, t - step)) / 2e-6, abs=1e-6)
    least = plain(w, t)
    assert all(plain(w + r.normal(0, s, width), t + r.normal(0, s, 3)) >= least - 1e-9 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_which_labels_count(docs, spark):
    rows = [(i, "you are scum" if i < 20 else "you are kind") for i in range(60)]
    one = [(i, 1 if i < 20 else 0) for i in range(60)]
    odd = [(0, 0), (1, 0), (30, None), (31, -1), (None, 1), (999, 1)]  # of several labels the largest counts
    a, b = ([tuple(x) for x in toxicity.score(docs(rows), spark.createDataFrame(m, "doc_id long, toxic int")).orderBy("doc_id").collect()] for m in (one, one + odd))
    assert a == b and all(x[4] == (x[0] < 20) for x in a)


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs([(1, "bad words"), (2, None), (None, "")]), none).collect()
    assert [x.severity for x in got] == [0.0] * 3 and not any(x.toxic for x in got)
    assert toxicity.score(docs([]), none).count() == 0
