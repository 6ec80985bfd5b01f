"""Answer, verify, repair, over all questions at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import generation as G
from ..operators import metrics as M
from . import retrieval as P


def _checker() -> G.Generator:
    """Supports answers that cite a page."""
    return lambda prompts: [json.dumps({"supported": "[p" in p.rpartition("Answer:")[2], "fix": ""}) for p in prompts]


def stub_answers(pages: DataFrame, questions: DataFrame, chunking: dict) -> DataFrame:
    """Metrics of the stub generator with and without a verifying step."""
    inputs = P.answer_inputs(pages, questions, chunking, retrieval={"type": "bm25"})
    template = {"grounded": G.TEMPLATES["grounded"]}
    asked = G.prompts(questions, inputs, template).join(inputs.select("qid", "context_pages"), "qid", "left")
    wanted = P.expected_pages(pages, questions).groupBy("qid").agg(F.collect_set("page").alias("expected_pages"))
    first = asked.join(wanted, "qid", "left").withColumn("answer", F.coalesce(G.generated(F.col("prompt"))["text"], F.lit("")))
    first = first.persist()
    plain = first.withColumn("supported", F.lit(None).cast("boolean")).withColumn("attempts", F.lit(1)).withColumn("pipeline", F.lit("baseline"))
    repaired = G.verified(first, _checker, G.stub, keep=DataFrame.persist).withColumn("pipeline", F.lit("multistep"))
    answer = F.col("answer")
    both = plain.unionByName(repaired).select("pipeline", A.not_found(answer).alias("not_found"), A.cited_pages(answer).cast("array<bigint>").alias("cited"), "context_pages", "expected_pages", F.size(T.tokens(answer)).alias("tokens"), "supported", "attempts")
    return M.answer_metrics(both, "pipeline")
