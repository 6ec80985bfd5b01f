"""Personal data: base patterns, and terms that give protected entities away.

The entities are what the base patterns find, told apart by kind and value. The corpus tells how much a
term near an entity reveals of it: with documents as events, PMI(e, t) = log2(n_et N / (n_e n_t)) is what
term t says of entity e, and IC(e) = -log2(n_e / N) is all there is to say. A term that stands beside e in
two different texts at least and whose PMI reaches `generalise` of IC(e) is generalised, and one that
reaches `remove` of it is removed, wherever it stands beside e. Counts are over all documents.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, pieces, saved

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Every ip and card lies in such a run.
_DIGITS = re.compile(r"[0-9][0-9. -]*")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each `@` looked at once, as the part before it can't hold another."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value) of base matches that hold, by start and kind; values are in a form of their own."""
    out = [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)] if "@" in text else []
    for run in _DIGITS.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(int(x) <= 255 for x in m[0].split(".") if len(x) < 9) and all(len(x.lstrip("0")) < 4 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end(), m[0]))
        if b - a >= 12:
            for m in _CARD.finditer(text, a, b):
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def contexts(text: str, spans: list[tuple[int, int, int, str]], window: int) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end): the `window` words nearest on either side of each span, however far they
    stand off, lower-cased; words that a span reaches into are left out."""
    found = [m.span() for m in _WORDS.finditer(text)]
    begins, ends = [x for x, _ in found], [x for _, x in found]
    beside = {}
    taken: set[int] = set()
    for a, _, b, _ in spans:
        # words up to `before` end at a or earlier, those from `after` on begin at b or later
        before, after = bisect_right(ends, a), bisect_left(begins, b)
        taken.update(range(before, after))
        beside[a, b] = [*range(max(before - window, 0), before), *range(after, min(after + window, len(found)))]
    return [(f"{KINDS[rank]}:{value}", text[slice(*found[k])].lower(), *found[k]) for a, rank, b, value in spans for k in beside[a, b] if k not in taken]


def found(docs: DataFrame, window: int = 6) -> DataFrame:
    """For every row of `docs` (doc_id, text): id (of the row), doc_id, hash (of the text), its text if it has
    spans, else its sha256, spans (start, rank, end) of base kinds, and near (entity, term, start, end),
    entities as hashes."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])), pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text"):
            spans, near, texts, digests = [], [], [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                own = base_spans(text)
                texts.append(text if own else None)
                digests.append(None if own else hashlib.sha256(text.encode()).hexdigest())
                spans.append([{"start": a, "rank": k, "end": b} for a, k, b, _ in own])
                near.append([{"entity": xxhash.xxh64_intdigest(e) - (1 << 63), "term": w, "start": a, "end": b} for e, w, a, b in contexts(text, own, window)] if own else [])
            ids = pa.array(range(row, row + len(spans)), types[0])
            row += len(spans)
            arrays = [ids, batch.column("doc_id").cast(types[1]), batch.column("hash"), *(pa.array(x, t) for x, t in zip((texts, digests, spans, near), types[3:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "doc_id", "hash", "text", "sha256", "spans", "near"])

    schema = "id bigint, doc_id bigint, hash bigint, text string, sha256 string, spans array<struct<start: bigint, rank: int, end: bigint>>, near array<struct<entity: bigint, term: string, start: bigint, end: bigint>>"
    return mapped(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), run, schema)


def document_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(term, n): the number of rows of `docs` whose text has the term. Each task counts up to `most` terms at a time before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return batch

        for batch in pieces(batches, "text"):
            for t in batch.column("text"):
                for w in set(_WORDS.findall((t.as_py() or "").lower())):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) >= most:
                    yield out()
        if counts:
            yield out()

    return mapped(docs.select("text"), run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(rows: DataFrame, docs: DataFrame, generalise: float = 0.8) -> DataFrame:
    """(entity, term, share): the pairs whose PMI reaches `generalise` of the entity's information, with the share that it reaches."""
    total = rows.count()
    pairs = rows.select("hash", F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("x")).select("hash", "x.entity", "x.term")
    both = pairs.groupBy("entity", "term", "hash").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("texts")).where("texts > 1")
    entities = rows.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    counted = both.join(entities, "entity").join(document_counts(docs).withColumnRenamed("n", "n_t"), "term")
    share = F.try_divide(F.log2(F.try_divide(F.col("n_et") * F.lit(float(total)), F.col("n_e") * F.col("n_t"))), F.log2(F.try_divide(F.lit(float(total)), F.col("n_e"))))
    return counted.where(F.col("n_e") < total).withColumn("share", F.round(share, 9)).where(F.col("share") >= generalise).select("entity", "term", "share")


def scan(docs: DataFrame, window: int = 6, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """For every row of `docs` (doc_id, text): doc_id, hash (the text's XXH64), spans (start, rank, end,
    action) in code points, end exclusive, by start and rank, with base matches first among terms, and
    text, for rows with spans, or sha256, the digest of other texts. Ranks number
    KINDS. The action is mask for base spans, generalise or remove for terms.

    A null text is an empty one and has no spans. Repeated rows are rows of their own, which count as
    documents; that a term stands beside an entity in copies of one text alone proves nothing. An empty
    table gives an empty one. doc_id must be a whole number or null. Columns other than doc_id and text are
    left aside.
    """
    rows = saved(found(docs, window), "pii")
    pairs = saved(disclosing(rows, docs, generalise), "disclosing").select(F.col("entity").alias("e"), F.col("term").alias("t"), "share")
    near = rows.select("id", F.explode("near").alias("x")).select("id", "x.*")
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    term = F.struct("start", F.lit(KINDS.index("term")).alias("rank"), "end", action.alias("action"))
    told = near.join(pairs, (F.col("entity") == F.col("e")) & (F.col("term") == F.col("t"))).select("id", term.alias("x"))
    terms = told.groupBy(F.col("id").alias("of")).agg(F.collect_set("x").alias("terms"))
    base = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.lit("mask").alias("action")))
    # of two entities beside a term, removal prevails: one span for each place
    once = F.expr("filter(terms, x -> x.action = 'remove' or not exists(terms, y -> y.start = x.start and y.action = 'remove'))")
    both = F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, once))
    return rows.join(terms, F.col("id") == F.col("of"), "left").select("doc_id", "hash", F.array_sort(both).alias("spans"), "text", "sha256")


def sanitised(text: str, spans: list) -> str:
    """The text with its spans (start, rank, end, action) replaced: base spans by their kind, generalised terms
    by their first letter, removed ones by nothing but dots. A span that overlaps one before is left out."""
    out, at = [], 0
    for start, rank, end, action in spans:
        if start < at:
            continue
        out.append(text[at:start])
        out.append(f"[{KINDS[rank].upper()}]" if action == "mask" else f"{text[start]}..." if action == "generalise" else "...")
        at = end
    return "".join([*out, text[at:]])


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their texts sanitised by their spans."""
    for batch in pieces(batches, "text"):
        texts = [None if t is None else sanitised(t, [tuple(x.values()) for x in s or []]) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, text) with texts sanitised: the spans are joined to the rows by doc_id and the text's hash."""
    spans = scan(docs, **settings).dropDuplicates(["doc_id", "hash"]).select(F.col("doc_id").alias("of"), F.col("hash").alias("h"), "spans")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    joined = rows.join(spans, rows.doc_id.eqNullSafe(F.col("of")) & (F.col("hash") == F.col("h"))).select("doc_id", "text", "spans")
    return mapped(joined, _replaced, joined.schema).select("doc_id", "text")


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    done = lambda action: F.size(F.filter("spans", lambda x: x["action"] == action)).cast("bigint").alias(f"n_{action}d")
    base = F.filter("spans", lambda x: x["rank"] < KINDS.index("term"))
    rows = mapped(scanned, _replaced, scanned.schema)
    clean = F.when(F.col("text").isNull(), F.col("sha256")).otherwise(F.sha2("text", 256)).alias("sanitised_sha256")
    return rows.select("doc_id", *map(count, range(4)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), done("generalise"), done("remove"), clean)
