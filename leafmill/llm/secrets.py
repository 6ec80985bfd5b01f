"""Secret scans with DataFrame functions only.

Base kinds are found by patterns. Beyond them, runs of characters that secrets are written in are scored by
two character Markov models, one of random strings and one of ordinary identifiers: the log-likelihood ratios
of their transitions tell which of the two a run looks like. They are added up, each within `CLIP` of 0, so
that no single odd pair decides, and the best stretch of a run counts, so that a secret behind an ordinary
prefix is found. The models are counted from labelled samples; their ratios are one table of 67 x 67 numbers, a
literal of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What runs are made of; its order numbers the table's rows and columns.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
ASSIGN = r"""(?=[pPsStTaA])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
_SPANS = "array<struct<start: bigint, rank: int, end: bigint, kind: string>>"

#: Bounds of a transition's ratio; the share of the characters' own frequencies in that of a transition.
CLIP, SMOOTH = 2.5, 0.1

#: Parts of ordinary identifiers, for samples.
_PARTS = (
    "get set user name file path data list index count value table column row key map node edge tree graph "
    "page text word line token parse build read write open close start stop begin end first last next prev "
    "total size length width height color style class object field method import export module package test "
    "check error warning message request response server client session account address number order item "
    "product customer service version update delete create insert select query filter group sort join merge "
    "about after again always because before between change different example family follow government house "
    "important language large little might mother never other people place point question right school sentence "
    "should small something sound spell still story study think thought three through together under until "
    "water where which while white without world would young xml json http html utf api url sql cpu gpu pdf "
    "zip max min avg buffer queue stack cache proxy shadow pixel vector matrix kernel thread socket "
    "exchange quick jump job year window yellow fix box zero lazy wrap"
).split()
_ENDINGS = ("", "", "", "", "", "", "", "", "s", "ed", "er", "ing", "ly", "ment", "able", "ic", "al", "ive", "ish", "ous")
_RUNS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234567890123456789", "qwertyuiopasdfghjklzxcvbnm")


def default_samples(spark: SparkSession, n: int = 20_000) -> DataFrame:
    """(random, text): n random strings, from digests, in hex, base 64, letters and digits, and letters alone, in
    either case or both, and n ordinary ones: identifiers in snake, kebab, camel, constant and path case or
    without any, some with endings or a number, long numbers, and runs of the alphabet. All follow from the row number."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    packed = F.translate(F.base64(F.unhex(digest("b"))), "\r\n", "")
    only = lambda x, kept: F.regexp_replace(x, f"[^{kept}]", "")
    case = lambda kinds: F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    hexed = F.substring(digest("a"), 1, 40)
    random = case([hexed, F.upper(hexed), hexed, packed, only(packed, "A-Za-z0-9"), only(packed, "A-Za-z"), only(F.lower(packed), "a-z"), only(F.upper(packed), "A-Z"), only(F.lower(packed), "a-z0-9"), only(F.upper(packed), "A-Z0-9")])
    parts = F.array(*map(F.lit, _PARTS))
    drawn = lambda k, of: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(of))
    ending = lambda k: F.element_at(F.array(*map(F.lit, _ENDINGS)), (drawn(k + 10, len(_ENDINGS)) + 1).cast("int"))
    part = lambda k: F.concat(F.element_at(parts, (drawn(k, len(_PARTS)) + 1).cast("int")), ending(k))
    snake = F.concat_ws("_", *[part(k) for k in range(5)])
    camel = F.concat(part(0), *[F.initcap(part(k)) for k in range(1, 5)])
    number = F.when(F.col("id") % 3 == 0, drawn(20, 1000).cast("string")).otherwise("")
    figures = F.regexp_replace(digest("n"), "[a-f]", "")
    along = F.element_at(F.array(*map(F.lit, _RUNS)), (drawn(21, len(_RUNS)) + 1).cast("int"))
    repeated = F.repeat(F.substring(F.lit(ALPHABET), (drawn(22, len(ALPHABET)) + 1).cast("int"), F.lit(1)), 20)
    ordinary = case([snake, F.translate(snake, "_", "-"), camel, F.initcap(camel), F.translate(snake, "_", "/"), F.concat_ws("", *[part(k) for k in range(4)]), F.upper(snake), F.upper(F.concat_ws("", *[part(k) for k in range(4)])), figures, F.when(F.col("id") % 2 == 0, along).otherwise(repeated), snake])
    rows = spark.range(0, n, 1, 2)
    return rows.select(F.lit(True).alias("random"), random.alias("text")).union(rows.select(F.lit(False), F.concat(ordinary, number)))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratios of all transitions, row by row, from samples (random, text), with one added
    to each count and smoothed, within CLIP of 0, and 0 at most for a character after itself: that says nothing. Null texts, null labels and characters outside the alphabet don't count. What comes to
    the driver is two rows at most for each pair of the alphabet's characters."""
    n = len(ALPHABET)
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1))
    pairs = samples.where(F.col("random").isNotNull() & (F.length("text") > 1)).select("random", "text", at.alias("i")).select("random", F.expr("substr(text, i, 2)").alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect()}
    def model(kind: bool) -> list[list[float]]:
        rows = [[counts.get((kind, a + b), 0) + 1 for b in ALPHABET] for a in ALPHABET]
        total = sum(map(sum, rows))
        every = [sum(column) / total for column in zip(*rows, strict=True)]
        return [[(1 - SMOOTH) * x / sum(row) + SMOOTH * p for x, p in zip(row, every, strict=True)] for row in rows]

    pairs = [(a == b, x, y) for a, *rows in zip(ALPHABET, model(True), model(False), strict=True) for b, x, y in zip(ALPHABET, *rows, strict=True)]
    out = [max(-CLIP, min(0.0 if same else CLIP, math.log(x) - math.log(y))) for same, x, y in pairs]
    assert len(out) == n * n
    return out


def ratio(text: str, table: list[float]) -> str:
    """SQL for the log-likelihood ratio of the best stretch of a run, 0 at least; `text` is SQL for it."""
    values = f"cast(split('{','.join(f'{x:.4f}' for x in table)}', ',') as array<double>)"
    code = lambda at: f"instr('{ALPHABET}', substr({text}, {at}, 1))"
    step = f"(a, i) -> transform(array(greatest(a.now, 0D) + element_at({values}, (({code('i - 1')}) - 1) * {len(ALPHABET)} + {code('i')})), now -> named_struct('now', now, 'best', greatest(a.best, now)))[0]"
    return f"aggregate(sequence(2, length({text})), named_struct('now', 0D, 'best', 0D), {step}, a -> a.best)"


def _spans(text: str, kind: str, pattern: Column, matches: str, accepted: str) -> Column:
    """Spans in code points of the accepted ones of all matches: gaps and matches in turn make up the text."""
    gaps = F.slice(F.split(F.col(text), pattern, -1), 1, F.size(matches))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    pairs = F.zip_with(gaps, matches, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    rows = F.zip_with(pairs, accepted, lambda x, ok: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), ok.alias("ok")))
    found = F.aggregate(rows, empty, step)["spans"]
    return F.when(F.exists(accepted, lambda x: x), found).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, table: list[float], least: float = 8.0) -> DataFrame:
    """The columns of `docs` with spans: (start, rank, end, kind), in code points, end exclusive, by start and kind.

    Runs of 20 characters or more are of kind random if the ratio of their best stretch is `least` or more. A null text has no spans. Rows stand alone: repeated rows have the same spans, an empty table
    gives an empty one, and a text of any length is one value. An older column named spans is replaced.
    """
    frame = docs.drop("spans").withColumn("__t", F.coalesce("text", F.lit("")))
    found = {
        "assign": (ASSIGN, None),
        "access": (ACCESS, None),
        "hex": (HEX, None),
        "random": (RUN, F.expr(f"transform(__m_random, x -> {ratio('x', table)} >= {least}D)")),
    }
    frame = frame.select("*", *[F.regexp_extract_all("__t", F.lit(p), F.lit(0)).alias(f"__m_{k}") for k, (p, _) in found.items()])
    yes = lambda k: F.transform(f"__m_{k}", lambda x: F.lit(True))
    values = F.when(F.size("__m_assign") > 0, F.transform(F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 6)).otherwise(F.array().cast("array<boolean>"))
    frame = frame.select("*", *[(values if k == "assign" else yes(k) if own is None else own).alias(f"__ok_{k}") for k, (_, own) in found.items()])
    spans = F.concat(*[_spans("__t", k, F.lit(p), f"__m_{k}", f"__ok_{k}") for k, (p, _) in found.items()])
    return frame.select(*[docs[c] for c in docs.columns if c != "spans"], F.array_sort(spans).alias("spans"))


def redacted(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`scanned` with every span of its texts replaced by the mark; spans that touch or overlap share one."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.substring("text", (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = (x["start"] > acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(done["out"], F.expr("substr(text, cast(__at as int) + 1)")))
    return scanned.withColumn("__at", done["at"]).withColumn("text", text).drop("__at")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
