"""Answers of text generators: citations, refusals, contexts, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def not_found(c: Column) -> Column:
    """Blank, NOT_FOUND in any case, or with `answer: NOT_FOUND` in it."""
    c = strip(F.coalesce(c, F.lit("")))
    return (c == "") | (F.upper(c) == "NOT_FOUND") | c.rlike(r"(?i)\banswer\s*:\s*NOT_FOUND\b")


def cited_pages(c: Column) -> Column:
    """Pages that an answer cites, each once, as they come: those of the `citations` of a JSON object
    (strings like p12), then all of [pA] and [pA-pB], ends in either order, all pages between."""
    c = F.coalesce(c, F.lit(""))
    trimmed = strip(c)
    listed = F.when(trimmed.startswith("{"), F.from_json(F.to_json(F.try_variant_get(F.try_parse_json(trimmed), "$.citations", "variant")), "array<string>"))
    in_json = F.flatten(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.slice(F.regexp_extract_all(x, F.lit(r"p\s*([0-9]{1,4})"), F.lit(1)), 1, 1)))
    spans = F.regexp_extract_all(c, F.lit(r"\[p\s*[0-9]{1,4}(?:\s*-\s*p?\s*[0-9]{1,4})?\]"), F.lit(0))
    ends = F.transform(spans, lambda x: F.transform(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("int")))
    pages = F.flatten(F.transform(ends, lambda e: F.sequence(F.array_min(e), F.array_max(e))))
    return F.array_distinct(F.concat(F.transform(in_json, lambda n: n.cast("int")), pages))


def context(chunks: Column, each: int = 3500, most: int = 10_000) -> Column:
    """Of an array of (rank, page_start, page_end, text), by rank: [pS-pE] and the text for each, cut at
    `each` characters, with blank lines between, cut at `most`."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
    piece = lambda x: F.concat(F.lit("[p"), x["page_start"].cast("string"), F.lit("-p"), x["page_end"].cast("string"), F.lit("]\n"), cut(strip(x["text"]), each))
    return cut(F.array_join(F.transform(F.array_sort(chunks), piece), "\n\n"), most)


def filled(template: Column, question: Column, found: Column) -> Column:
    """A template with {question} and {context} filled in at once: what a value brings along isn't a slot."""
    parts = F.split(template, r"(?=\{question\}|\{context\})|(?<=\{question\})|(?<=\{context\})")
    return F.array_join(F.transform(parts, lambda x: F.when(x == "{question}", question).when(x == "{context}", found).otherwise(x)), "")
