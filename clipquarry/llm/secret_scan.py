"""Secret scans with a battery of randomness tests, in DataFrame operations only.

Base kinds are matched by pattern. Further candidates are runs of 20 or more characters of the usual
encodings, outside the base spans. An encoding (hex, base 32, base 36, alphanumeric, base 64) is inferred
from a candidate's characters, and three tests ask whether it looks drawn at random from that alphabet:
chi-squared uniformity, runs of character classes, lag-1 serial correlation. Each test's null hypothesis
is ordinary, structured text, with an effect that grows with the length, so a short candidate has to be
the more random; the candidate's p value is the largest of the three, as all must reject. Tails are bounded
by exp(-z * z / 2) / 2, which errs on the safe side. Within each stratum of encoding and length the
Benjamini-Hochberg procedure, over a histogram of p values of all documents, keeps the share of false finds
below a level.

Offsets count code points and come from the lengths of what lies between the matches. Only offsets and
figures are shuffled, never texts. Defined results: a null text is empty and has no spans; repeated
rows are scanned each; input columns other than the id and the text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole, written


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: An equals sign is padding at the end, so that of name=value the value is a candidate of its own.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,6}"
#: In the order in which spans at one place are listed. Maximal runs of the base kinds that are long enough are what the unbounded patterns match.
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
MIN_VALUE = 12
#: Share of false finds among the spans that the tests add.
LEVEL = 0.05
#: Encodings: pattern, size of the alphabet, chance that neighbours differ in class, least chi-squared effect of structured text for each character.
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", 16, 0.46875, 1.0),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", 32, 0.3046875, 2.0),
    "base36": (r"^(?=.*[0-9])((?=.*[a-z])[a-z0-9]+|(?=.*[A-Z])[A-Z0-9]+)$", 36, 0.40123, 2.0),
    "alnum": (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", 62, 0.62227, 2.0),
    "base64": (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_-]+=*$", 64, 0.64453, 2.0),
}
#: A structured sequence's serial correlation, at least.
SERIAL = 0.8
BINS = 400


def matches(text: Column, k: int, pattern: str) -> Column:
    """Of each match: kind, number, code points between it and the match before, the match. Most texts have none, which one search tells."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    found = F.filter(both, lambda x: x["m"].isNotNull())
    each = F.transform(found, lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["m"].alias("m")))
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,m:string>>"))


def tail(z: Column) -> Column:
    """An upper bound of P(Z > z)."""
    return F.when(z > 0, F.exp(-z * z / 2) / 2).otherwise(F.lit(1.0))


def tested(df: DataFrame) -> DataFrame:
    """df (with m) and its encoding, length class and p value, null where no encoding fits."""
    m, n = F.col("m"), F.length("body")
    encoding = F.lit(None).cast("string")
    for name, (pattern, *_) in reversed(ENCODINGS.items()):
        encoding = F.when(m.rlike(pattern), F.lit(name)).otherwise(encoding)
    pick = lambda at: F.element_at(F.create_map(*[F.lit(y) for k, v in ENCODINGS.items() for y in (k, float(v[at]))]), F.col("encoding"))
    df = df.withColumn("encoding", F.when(F.col("kind") == len(KINDS) - 1, encoding))
    df = df.withColumn("body", F.when(F.col("encoding").isNotNull(), F.rtrim(m, F.lit("="))))
    df = df.withColumns({"size": pick(1), "turn": pick(2), "effect": pick(3), "chars": F.filter(F.split("body", "", -1), lambda c: c != "")})
    df = df.withColumns({"kinds": F.array_distinct("chars"), "codes": F.transform("chars", lambda c: F.ascii(c).cast("double"))})
    body = F.col("body")
    squares = F.aggregate("kinds", F.lit(0.0), lambda a, c: a + F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)))
    classes = F.translate("body", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=", "a" * 26 + "A" * 26 + "0" * 10 + "+" * 5)
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")])
    zipped = F.arrays_zip(F.col("codes").alias("x"), F.slice("codes", 2, F.greatest(F.size("codes"), F.lit(1))).alias("y"))
    sums = F.aggregate(
        F.filter(zipped, lambda p: p["y"].isNotNull()), start,
        lambda a, p: F.struct((a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"), (a["xx"] + p["x"] * p["x"]).alias("xx"), (a["yy"] + p["y"] * p["y"]).alias("yy"), (a["xy"] + p["x"] * p["y"]).alias("xy")),
    )
    df = df.withColumns({"squares": squares, "runs": runs, "sums": sums})
    freedom, away = F.col("size") - 1, F.col("effect") * n
    z1 = (freedom + away - (F.col("size") / n * F.col("squares") - n)) / F.sqrt(2 * (freedom + 2 * away))
    rare = F.col("turn") / 2
    z2 = (F.col("runs") - 1 - (n - 1) * rare) / F.sqrt((n - 1) * rare * (1 - rare))
    k = (n - 1).cast("double")
    s = lambda c: F.col(f"sums.{c}")
    spread = (k * s("xx") - s("x") * s("x")) * (k * s("yy") - s("y") * s("y"))
    r = F.when(spread > 0, F.least(F.abs((k * s("xy") - s("x") * s("y")) / F.sqrt(spread)), F.lit(0.999))).otherwise(0.999)
    z3 = (F.lit(SERIAL_Z) - F.atanh(r)) * F.sqrt(F.greatest(n - 4, F.lit(1)))
    p = F.greatest(tail(z1), tail(z2), tail(z3))
    return df.withColumns({"p": F.when(F.col("encoding").isNotNull(), p), "long": F.floor(F.log2(n.cast("double")) * 2).cast("int")})


SERIAL_Z = 1.0986122886681098  # atanh(SERIAL)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All spans: uid, doc_id, kind (null in the one row of a text without any), start, end, and of candidates encoding, long and p."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole(text).alias("t")).withColumn("uid", F.monotonically_increasing_id())
    every = F.concat(*[matches(F.col("t"), k, p) for k, p in enumerate(KINDS.values())])
    rows = rows.select("uid", "doc_id", F.explode_outer(every).alias("x")).select("uid", "doc_id", "x.*")
    value = F.length(F.regexp_extract("m", ASSIGN, 2))
    rows = tested(rows).select("uid", "doc_id", "kind", "i", (F.col("gap") + F.length("m")).alias("step"), F.length("m").alias("n"), ((F.col("kind") != 0) | (value >= MIN_VALUE)).alias("ok"), "encoding", "long", "p")
    w = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("uid").withColumn("end", F.sum("step").over(w)).withColumn("start", F.col("end") - F.col("n"))
    # A refused match stays as a row without a kind, as its text may have no other.
    rows = rows.withColumn("kind", F.when(F.col("ok"), F.col("kind"))).drop("ok", "step", "n", "i")
    base = F.col("kind") < len(KINDS) - 1
    # The next base span is the last one in the opposite order: frames that only grow take one pass.
    running = lambda *order: Window.partitionBy("uid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    left = F.max(F.when(base, F.col("end"))).over(running("start", "kind"))
    right = F.min(F.when(base, F.col("start"))).over(running(F.desc("start"), F.desc("kind")))
    free = (F.coalesce(left, F.lit(-1)) <= F.col("start")) & (F.coalesce(right, F.col("end")) >= F.col("end"))
    return rows.withColumn("kind", F.when(base | (free & F.col("p").isNotNull()), F.col("kind")))


def discoveries(spans: DataFrame, level: float) -> DataFrame:
    """(encoding, long, least): the least bin, of -20 log10 p, at which a stratum's candidates are finds. At most a few dozen rows."""
    strata = spans.where("p is not null and kind is not null").groupBy("encoding", "long", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("encoding", "long")
    cum = strata.withColumns({"up": F.sum("n").over(w.orderBy(F.desc("bin"))), "all": F.sum("n").over(w)})
    return cum.where(F.pow(F.lit(10.0), -F.col("bin") / 20) * F.col("all") <= F.lit(level) * F.col("up")).groupBy("encoding", "long").agg(F.min("bin").alias("least"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", level: float = LEVEL) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, end, kind) by start and then kind."""
    bin_ = F.least(F.floor(-20 * F.log10("p")), F.lit(BINS)).cast("int")
    spans = written(find(docs, text, doc_id).withColumn("bin", bin_))
    least = discoveries(spans, level).withColumnsRenamed({"encoding": "e", "long": "l"})
    met = spans.join(F.broadcast(least), (F.col("encoding") == F.col("e")) & (F.col("long") == F.col("l")), "left")
    kept = F.col("kind").isNotNull() & ((F.col("kind") < len(KINDS) - 1) | (F.col("bin") >= F.col("least")))
    names = F.array(*[F.lit(k) for k in KINDS])
    span = F.when(kept, F.struct("start", F.col("kind").alias("k"), "end"))
    grouped = met.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("s"))
    return grouped.select("doc_id", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["k"]).alias("kind"))).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
