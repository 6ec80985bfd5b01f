"""Text generators and what surrounds them: prompts, verify-and-repair, summaries, model benches, gold scores.

A generator is made once for each task and takes a list of prompts; models are plug-ins, and a stub that
depends on the prompt alone stands in for tests. An HTTP generator speaks to a local completion server.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import answers as A
from ..functions import text as T


class Generator(Protocol):
    """Answers: texts, or a server's whole payloads with `response`, durations in nanoseconds and token counts."""

    def __call__(self, prompts: list[str]) -> list[str | dict]: ...


def stub() -> Generator:
    """Cites the first page that the prompt shows, or finds nothing."""
    def answer(prompt: str) -> str:
        page = re.search(r"\[p(\d+)-p\d+\]", prompt)
        return f"See the passage. [p{page[1]}]" if page else "NOT_FOUND"

    return lambda prompts: [answer(p) for p in prompts]


def http(base_url: str, model: str, timeout: float = 120.0, full: bool = False) -> Callable[[], Generator]:
    """A generator behind POST /api/generate, without streaming, at temperature 0. A base of .../v1 is refused;
    one of .../api is taken as is. A body that is no JSON is the answer. With `full` the whole payload is, and a
    body that is no JSON an error."""
    base = base_url.rstrip("/").removesuffix("/api")
    if base.endswith("/v1"):
        raise ValueError("this speaks the native API, not /v1")

    def one(prompt: str) -> str | dict:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False, "options": {"temperature": 0}}).encode()
        request = urllib.request.Request(f"{base}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as response:
            raw = response.read().decode("utf-8", "replace")
        if full:
            return json.loads(raw)
        try:
            return str(json.loads(raw).get("response", ""))
        except ValueError:
            return raw

    return lambda: lambda prompts: [one(p) for p in prompts]


_RESULT = "struct<text: string, total_s: double, error: string, load_s: double, prompt_eval_s: double, eval_s: double, prompt_tokens: bigint, tokens: bigint>"


def _measured(answer: str | dict | None, elapsed: float, error: str | None) -> tuple:
    """A row of _RESULT. What a payload doesn't tell is -1 s and no tokens; without its total, time elapsed counts."""
    own = answer if isinstance(answer, dict) else {}
    seconds = lambda key: own[key] / 1e9 if own.get(key) is not None else -1.0
    total = seconds("total_duration")
    text = str(own.get("response", "")) if own else answer
    return text, total if total >= 0 else elapsed, error, *map(seconds, ("load_duration", "prompt_eval_duration", "eval_duration")), int(own.get("prompt_eval_count") or 0), int(own.get("eval_count") or 0)


def generated(prompt: Column, make: Callable[[], Generator] = stub, batch: int = 16, retries: int = 0, backoff_s: float = 0.8, warmup: int = 0) -> Column:
    """_RESULT for each prompt. A prompt that fails after all tries has an error and no text. Each task first
    asks its first `warmup` prompts for nothing."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, cold = make(), warmup
        for prompts in batches:
            for p in prompts.fillna("")[:cold]:
                try:
                    model([p])
                except Exception:  # the same prompt comes again, and then it counts
                    pass
            rows, cold = [], 0
            for p in prompts.fillna(""):
                began, text, error = time.perf_counter(), None, None
                for k in range(retries + 1):
                    try:
                        (text,), error = model([p]), None
                        break
                    except Exception as e:  # a plug-in may raise anything; it becomes the row's error
                        error = f"{type(e).__name__}: {e}"
                        if k < retries:
                            time.sleep(backoff_s * (k + 1))
                rows.append(_measured(text, time.perf_counter() - began, error))
            yield pd.DataFrame(rows, columns=[c.split(":")[0] for c in _RESULT[7:-1].split(", ")])

    return F.pandas_udf(run, _RESULT)(prompt)


#: The three templates: strict JSON, sections, and nothing but the context.
TEMPLATES = {
    "strict_json": 'Answer from the context alone. Return one JSON object: {"answer": ..., "citations": ["p1", ...]}. If the context lacks the answer, answer NOT_FOUND.\n\nContext:\n{context}\n\nQuestion: {question}\n',
    "sections": "Answer in three parts: Answer, Evidence, Limits. Cite pages as [p1].\n\nContext:\n{context}\n\nQuestion: {question}\n",
    "grounded": "Use only sentences of the context, each with its page as [p1]. Without support say NOT_FOUND.\n\nContext:\n{context}\n\nQuestion: {question}\n",
}


def prompts(questions: DataFrame, contexts: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(qid, variant, prompt): every template filled for every question (qid, text) with its context (qid, context)."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(v).alias("template")) for k, v in templates.items()])).alias("t")
    asked = questions.join(contexts, "qid", "left").select("qid", "text", F.coalesce("context", F.lit("")).alias("context"), rows)
    return asked.select("qid", F.col("t.variant").alias("variant"), A.filled(F.col("t.template"), F.col("text"), F.col("context")).alias("prompt"))


VERDICT = "supported boolean, issues array<string>, fix string"


def verdict(c: Column) -> Column:
    """A verifier's JSON; anything that isn't an object with `supported` is not supported."""
    parsed = F.from_json(T.strip(F.coalesce(c, F.lit(""))), VERDICT)
    return F.struct(F.coalesce(parsed["supported"], F.lit(False)).alias("supported"), F.coalesce(parsed["issues"], F.array(F.lit("parse error"))).alias("issues"), parsed["fix"].alias("fix"))


def verified(answers: DataFrame, verify: Callable[[], Generator], regenerate: Callable[[], Generator], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(..., answer, supported, attempts): answers (prompt, answer) verified; what isn't supported becomes the
    verifier's fix, or else a new answer, and is verified once more. `keep` materialises a frame, so that
    generators aren't asked twice for what two branches read."""
    question = lambda a: F.concat(F.lit("Verify. Return JSON with supported, issues, fix.\n\n"), F.col("prompt"), F.lit("\n\nAnswer:\n"), F.col(a))
    first = keep(answers.withColumn("v", verdict(generated(question("answer"), verify)["text"])))
    good = first.where("v.supported").select(*answers.columns, F.lit(True).alias("supported"), F.lit(1).alias("attempts"))
    bad = first.where("not v.supported")
    strict = F.concat(F.lit("Answer strictly from the context.\n\n"), F.col("prompt"))
    fix = F.nullif(T.strip(F.coalesce("v.fix", F.lit(""))), F.lit(""))
    fixed = bad.where(fix.isNotNull()).withColumn("answer", fix)
    anew = bad.where(fix.isNull()).withColumn("answer", F.coalesce(generated(strict, regenerate)["text"], F.lit("")))
    again = fixed.unionByName(anew).withColumn("v", verdict(generated(question("answer"), verify)["text"]))
    return good.unionByName(again.select(*answers.columns, F.col("v.supported").alias("supported"), F.lit(2).alias("attempts")))


def summarised(chunks: DataFrame, make: Callable[[], Generator], sentences: int = 3) -> DataFrame:
    """Chunks with a summary before their text."""
    prompt = F.concat(F.lit(f"Summarise in at most {sentences} sentences.\n\n"), T.summary_input(F.col("text")))
    summary = T.summary_output(F.coalesce(generated(prompt, make)["text"], F.lit("")))
    return chunks.withColumn("text", T.augmented(F.col("text"), summary))


def bench(prompts: DataFrame, models: dict[str, Callable[[], Generator]], repeats: int = 3, warmup: int = 0) -> DataFrame:
    """(id, model, repeat, the fields of _RESULT, ok, tokens_per_s) of every prompt (id, prompt) for every model,
    `repeats` times, after `warmup` prompts in each task."""
    asked = prompts.select("id", "prompt", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    out = None
    for name, make in models.items():
        got = asked.select("id", F.lit(name).alias("model"), "repeat", generated(F.col("prompt"), make, warmup=warmup).alias("r"))
        rate = F.when(F.col("eval_s") > 0, F.col("tokens") / F.col("eval_s")).otherwise(-1.0)
        rows = got.select("id", "model", "repeat", "r.*").withColumn("ok", F.col("error").isNull()).withColumn("tokens_per_s", rate)
        out = rows if out is None else out.unionByName(rows)
    return out


@F.pandas_udf(IntegerType())
def _pattern_hits(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """How many of a row's patterns occur in any case. They are data and may not compile, which built-in functions don't forgive."""

    def hit(pattern: str, text: str) -> bool:
        try:
            return re.search(pattern, text, re.IGNORECASE) is not None
        except re.error:
            return False

    return pd.Series([sum(hit(p, t) for p in ps if p is not None) for t, ps in zip(texts, patterns, strict=True)])


def gold_scores(responses: DataFrame, gold: DataFrame) -> DataFrame:
    """(..., checks, quality, passed): the share of gold checks that a response (id, text) passes; -1 without
    gold or checks. Each check counts once: phrases that must or must not be there, patterns in any case (one
    that doesn't compile fails), JSON that parses, its keys, its arrays' lengths, and the F1 of integers."""
    joined = responses.join(gold, "id", "left")
    low, text = T.safe_lower(F.col("text")), F.coalesce("text", F.lit(""))
    parsed = F.try_parse_json(T.strip(text))
    obj = F.when(parsed.isNotNull(), F.to_json(parsed))
    none = F.array().cast("array<string>")
    yes = lambda array, test: F.size(F.filter(F.coalesce(F.col(array), none), test))
    n = lambda array: F.size(F.coalesce(F.col(array), none))
    json_on = F.coalesce("expect_json", F.lit(False))
    keys = F.coalesce(F.json_object_keys(obj), none)
    values = F.from_json(obj, "map<string, string>")
    lengths = F.coalesce(F.map_entries("json_array_key_len"), F.array().cast("array<struct<key: string, value: int>>"))
    length_ok = F.size(F.filter(lengths, lambda e: F.coalesce(F.json_array_length(F.try_element_at(values, e["key"])), F.lit(-1)) == e["value"]))
    want = F.coalesce("expected_int_list", F.array().cast("array<int>"))
    got = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"-?[0-9]{1,9}"), F.lit(0)), lambda x: x.cast("int")))
    hit = F.size(F.array_intersect(want, got))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * hit, F.size(F.array_distinct(want)) + F.size(got)), F.lit(0.0))
    threshold = F.coalesce("pass_threshold", F.lit(0.8))
    total = n("expected_contains") + n("forbidden_contains") + n("expected_regex") + F.when(json_on, 1 + n("json_required_keys") + F.size(lengths)).otherwise(0) + (F.size(want) > 0).cast("int")
    passes = yes("expected_contains", lambda x: F.contains(low, F.lower(x))) + yes("forbidden_contains", lambda x: ~F.contains(low, F.lower(x))) + _pattern_hits(text, F.coalesce("expected_regex", none))
    passes = passes + F.when(json_on, parsed.isNotNull().cast("int") + yes("json_required_keys", lambda x: F.array_contains(keys, x)) + length_ok).otherwise(0) + ((F.size(want) > 0) & (f1 >= threshold)).cast("int")
    scored = joined.select(*[responses[c] for c in responses.columns], total.alias("checks"), passes.alias("__passes"), threshold.alias("__t"))
    quality = F.when(F.col("checks") == 0, F.lit(-1.0)).otherwise(F.col("__passes") / F.col("checks").cast("double"))
    return scored.withColumn("quality", quality).withColumn("passed", (F.col("quality") >= F.col("__t")) & (F.col("quality") >= 0)).drop("__passes", "__t")
