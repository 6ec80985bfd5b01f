"""Metrics of rankings, latencies and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_ranks(ranking: DataFrame, chunks: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, first_rank): the best rank whose chunk (doc, page_start, page_end) holds an expected page (qid,
    page) of the question; null where none does. Every question has a row."""
    hits = ranking.select("qid", "doc", "rank").join(chunks.select("doc", "page_start", "page_end"), "doc").join(expected, "qid").where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    return questions.select("qid").join(hits.groupBy("qid").agg(F.min("rank").alias("first_rank")), "qid", "left")


def ranking_metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """n, hit_at_1/3/5, mrr, avg_first_rank of first ranks. A miss counts as 0; the average is over hits, and
    infinite without any; without questions all are 0 but for that."""
    hit = lambda k: F.coalesce(F.avg((F.coalesce("first_rank", F.lit(1 << 30)) <= k).cast("double")), F.lit(0.0)).alias(f"hit_at_{k}")
    mrr = F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr")
    mean = F.coalesce(F.avg("first_rank"), F.lit(float("inf"))).alias("avg_first_rank")
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), hit(1), hit(3), hit(5), mrr, mean)


def deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """Other minus base, of two one-row metrics."""
    names = ("hit_at_1", "hit_at_3", "hit_at_5", "mrr")
    b = base.select(*[F.col(c).alias(f"base_{c}") for c in names])
    return other.crossJoin(b).select(*[(F.col(c) - F.col(f"base_{c}")).alias(f"delta_{c}") for c in names])


def percentile(c: str, p: float) -> Column:
    """Exact, between neighbours in proportion; NaN for nothing."""
    return F.coalesce(F.percentile(c, F.lit(p / 100)), F.lit(float("nan")))


def median_or(c: str, empty: float = -1.0) -> Column:
    return F.coalesce(F.median(c), F.lit(empty))


def mean_or(c: str, empty: float = -1.0) -> Column:
    return F.coalesce(F.avg(c), F.lit(empty))


def at_places(rows: DataFrame, c: str, places: dict[str, Column], *by: str, parts: int = 256) -> DataFrame:
    """A row for each group with values: n, their number, and for each of `places`, a whole number made from n, the
    value at that place of the sorted values, from 0.

    Equal values are counted first. Cuts from a summary of the different ones divide them into `parts` buckets, whose
    counts tell in which a place lies; only that bucket is gone through in order. No group comes together in a task.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    values = rows.where(F.col(c).isNotNull()).select(key.alias("k"), F.col(c).alias("v")).groupBy("k", "v").agg(F.count("*").alias("n"))
    cuts = values.groupBy(F.col("k").alias("of")).agg(F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(100 * parts)).alias("cuts"))
    dealt = values.join(cuts, F.col("k") == F.col("of")).select("k", "v", "n", F.size(F.filter("cuts", lambda x: x <= F.col("v"))).alias("bucket"))
    sums = dealt.groupBy("k", "bucket").agg(F.sum("n").alias("m"))
    group = Window.partitionBy("k")
    before = F.coalesce(F.sum("m").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.select(F.col("k").alias("of"), F.col("bucket").alias("in"), "m", before.alias("before"), F.sum("m").over(group).alias("n"))
    wanted = placed.select("of", "in", "m", "before", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("bigint").alias("place")) for name, place in places.items()])).alias("w"))
    wanted = wanted.where((F.col("w.place") >= F.col("before")) & (F.col("w.place") < F.col("before") + F.col("m")))
    wanted = wanted.select("of", "in", F.col("n").alias("all"), "w.name", (F.col("w.place") - F.col("before")).alias("left"))
    met = dealt.join(wanted, (F.col("k") == F.col("of")) & (F.col("bucket") == F.col("in")))
    order = Window.partitionBy("k", "bucket", "name").orderBy("v")
    hit = met.withColumn("upto", F.sum("n").over(order)).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
    found = hit.groupBy("k").agg(F.max("all").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])
    return found.select(*[F.col("k")[x].alias(x) for x in by], "n", *places)


def nearest_rank(rows: DataFrame, c: str, p: float, *by: str) -> DataFrame:
    """The value at index round(p (n - 1)) of the sorted values, halves to even; a group of none has no row."""
    return at_places(rows, c, {"value": F.bround(F.lit(p) * (F.col("n") - 1))}, *by).select(*by, "value")


def latencies(rows: DataFrame, c: str, *by: str) -> DataFrame:
    """n, mean, median and exact percentiles p50, p95 and p99, between neighbours in proportion. Without a value mean and
    median are -1, the others NaN."""
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    places = {f"{k}_{end}": f(at(p)) for k, p in shares.items() for end, f in (("low", F.floor), ("high", F.ceil))}

    def between(k: str, p: float) -> Column:
        low, high, part = F.col(f"{k}_low").cast("double"), F.col(f"{k}_high").cast("double"), at(p) - F.floor(at(p))
        return F.when(part == 0, low).otherwise(low * (1 - part) + high * part)

    found = at_places(rows, c, places, *by).select(*[F.col(x).alias(f"__{x}") for x in by], *[between(k, p).alias(k) for k, p in shares.items()])
    plain = rows.groupBy(*by).agg(F.count(c).alias("n"), mean_or(c).alias("mean"))
    same = F.lit(True)
    for x in by:
        same = same & F.col(x).eqNullSafe(F.col(f"__{x}"))
    nan = F.lit(float("nan"))
    return plain.join(found, same, "left").select(*by, "n", "mean", F.coalesce("p50", F.lit(-1.0)).alias("median"), *[F.coalesce(k, nan).alias(k) for k in shares])


def answer_metrics(answers: DataFrame, *by: str) -> DataFrame:
    """Of answers (not_found, cited, context_pages, expected_pages, tokens, and supported and attempts if they
    are there). Rates are over all answers, over those that cite, and over those with expectations, one at
    least; tokens by their median and nearest rank of 0.95. An answer hallucinates if it cites any page outside its context."""
    n = F.greatest(F.count("*"), F.lit(1))
    count = lambda c: F.sum(c.cast("int"))
    cites = F.size("cited") > 0
    asked = F.size(F.coalesce("expected_pages", F.array().cast("array<int>"))) > 0
    out = [
        F.count("*").alias("n"),
        (count(~F.col("not_found")) / n).alias("non_empty_rate"),
        (count(cites) / n).alias("cites_rate"),
        (count(cites & (F.size(F.array_except("cited", "context_pages")) > 0)) / F.greatest(count(cites), F.lit(1))).alias("hallucination_rate"),
        (count(asked & F.arrays_overlap("cited", "expected_pages")) / F.greatest(count(asked), F.lit(1))).alias("expected_page_hit_rate"),
        median_or("tokens").alias("p50_tokens"),
    ]
    if "supported" in answers.columns:
        out += [(count(F.col("supported")) / n).alias("supported_rate"), F.avg("attempts").alias("avg_attempts")]
    late = nearest_rank(answers, "tokens", 0.95, *by).withColumnRenamed("value", "p95_tokens")
    found = answers.groupBy(*by).agg(*out)
    return (found.join(late, list(by), "left") if by else found.join(late, F.lit(True), "left")).fillna(-1, ["p95_tokens"])


def context_pages(chunks: DataFrame) -> DataFrame:
    """(qid, context_pages): all pages of the chunks (qid, page_start, page_end)."""
    return chunks.groupBy("qid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("page_start", "page_end"))))).alias("context_pages"))


def model_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Of runs (ok, total_s, tokens, eval_s, quality, passed): counts, times, tokens per second where both are
    known, and quality over scored runs (quality of 0 or more)."""
    good, scored = F.col("ok"), F.col("ok") & (F.col("quality") >= 0)
    rate = F.when(good & (F.col("eval_s") > 0) & (F.col("tokens") > 0), F.col("tokens") / F.col("eval_s"))
    return runs.groupBy(*by).agg(
        F.count_if(good).alias("ok"),
        F.count_if(~good).alias("errors"),
        F.coalesce(F.avg(F.when(good, F.col("total_s"))), F.lit(-1.0)).alias("avg_total_s"),
        F.coalesce(F.median(F.when(good, F.col("total_s"))), F.lit(-1.0)).alias("p50_total_s"),
        F.coalesce(F.avg(F.when(good, F.col("tokens"))), F.lit(-1.0)).alias("avg_tokens"),
        F.coalesce(F.avg(rate), F.lit(-1.0)).alias("avg_tokens_per_s"),
        F.count_if(scored).alias("scored"),
        F.coalesce(F.avg(F.when(scored, F.col("quality"))), F.lit(-1.0)).alias("quality_avg"),
        F.coalesce(F.median(F.when(scored, F.col("quality"))), F.lit(-1.0)).alias("quality_p50"),
        F.coalesce(F.avg(F.when(scored, F.col("passed").cast("double"))), F.lit(-1.0)).alias("pass_rate"),
    )
