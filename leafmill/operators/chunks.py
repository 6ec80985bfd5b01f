"""Chunkers. Pages are rows (doc_key, page, text); chunks are rows of CHUNK, ordered by `ord` within doc_key.

Windows and sections are column expressions and window functions. Chunkers whose chunks depend on where they begin
are cut in blocks, as operators.chains tells, so that one document of any length keeps all tasks busy. Where a plug-in
is asked for each chunk's end, a document's units are folded in order, as a stream.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import units as U
from ..session import stored
from . import chains
from . import lexical as L

CHUNK = "doc_key string, ord bigint, chunk_id string, text string, page_start bigint, page_end bigint, section_title string, strategy string, chunk_size int, overlap int"
_COLUMNS = [c.split(" ")[0] for c in CHUNK.split(", ")]
#: `ord` is a section, page or chunk number times this, plus the number within it.
_STRIDE = 1 << 20


def _chunk(**own: Column) -> list[Column]:
    kinds = dict(c.split(" ") for c in CHUNK.split(", "))
    return [own.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in _COLUMNS]


def _id(prefix: str, number: Column, digits: int = 4) -> Column:
    return F.format_string(f"{prefix}%0{digits}d", number)


def tokenized(pages: DataFrame) -> DataFrame:
    """`pages` with `t`, the tokens of the normalised text, joined by line breaks: for those who cut the same pages in several ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chains.slices(whole, "normal"):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], L.listed(batch.column("normal"))], names=[*batch.schema.names[:-1], "t"])

    normal = pages.withColumn("normal", T.normalized(F.coalesce("text", F.lit(""))))
    return normal.mapInArrow(run, StructType([*pages.schema.fields, *StructType.fromDDL("t string").fields]))


def naive(pages: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Token windows of each page, beginning every size - overlap tokens, those within the last one included. Of pages with
    tokens, as tokenized() has them, the windows have theirs too."""
    step, known = max(1, size - overlap), "t" in pages.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chains.slices(whole, whole.schema.names[2]):
                row, number, text, tokens = _windows(batch.column(2) if known else L.listed(batch.column(2)), size, step)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(number, pa.int32()), text, *([tokens] if known else [])], names=["doc_key", "page", "i", "w", *(["t"] if known else [])])

    texts = pages.select("doc_key", "page", "t") if known else _normalized(pages)
    windows = texts.mapInArrow(cut, StructType([texts.schema["doc_key"], texts.schema["page"], *StructType.fromDDL("i int, w string" + ", t string" * known).fields]))
    chunk_id = F.concat(_id("p", F.col("page")), F.lit("_"), _id("n", F.col("i")))
    return windows.select(*_chunk(doc_key=F.col("doc_key"), ord=F.col("page") * _STRIDE + F.col("i"), chunk_id=chunk_id, text=F.col("w"), page_start=F.col("page"), page_end=F.col("page"), strategy=F.lit("naive_tokens"), chunk_size=F.lit(size), overlap=F.lit(overlap)), *(["t"] if known else []))


def _windows(joined: pa.Array, size: int, step: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(row, number, text, tokens) of the windows of texts of joined tokens. All texts are closed up at once, and a window is what
    stands there from its first token to its last."""
    texts = ["" if x is None else x for x in joined.to_pylist()]
    rows = np.array([i for i, x in enumerate(texts) if x], np.int64)
    whole = "\n".join(x for x in texts if x).encode("utf-8", "surrogatepass")
    if not len(rows):
        return rows, rows, pa.array([], pa.string()), pa.array([], pa.string())
    b = np.frombuffer(whole, np.uint8)
    breaks = np.flatnonzero(b == 10)
    begin, end = np.append(0, breaks + 1), np.append(breaks, len(b))
    shut = (end - begin == 1) & np.isin(b[begin], np.frombuffer(b".,:;?!)]}", np.uint8))
    shut[0] = False
    stays = np.ones(len(b), bool)
    stays[begin[shut] - 1] = False
    closed = np.where(b == 10, np.uint8(32), b)[stays].tobytes()
    gone = np.cumsum(shut)
    # the tokens of each text, and of each window
    n = np.array([texts[i].count("\n") + 1 for i in rows.tolist()], np.int64)
    many = -(-n // step)
    of = np.repeat(np.arange(len(rows)), many)
    number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    base = np.cumsum(n) - n
    first = base[of] + number * step
    last = np.minimum(first + size, base[of] + n[of]) - 1
    tokens = [whole[x:y] for x, y in zip(begin[first].tolist(), end[last].tolist(), strict=True)]
    text = [closed[x:y] for x, y in zip((begin - gone)[first].tolist(), (end - gone)[last].tolist(), strict=True)]
    text = [x[:1] + x[2:] if x[:2] in (b"( ", b"[ ", b"{ ") else x for x in text]
    return rows[of], number, *(pa.array(x, pa.binary()).view(pa.string()) for x in (text, tokens))


def page_index(pages: DataFrame, strategy: str = "page_index") -> DataFrame:
    """One chunk for each page, its text as it is."""
    page = F.col("page")
    return pages.select(*_chunk(doc_key=F.col("doc_key"), ord=page * _STRIDE, chunk_id=F.concat(F.lit("page/"), page.cast("string")), text=F.coalesce("text", F.lit("")), page_start=page, page_end=page, strategy=F.lit(strategy)), *(["t"] if "t" in pages.columns else []))


def late(pages: DataFrame) -> DataFrame:
    """Page chunks that are cut at query time."""
    return page_index(pages, "late_chunking")


def lines(pages: DataFrame) -> DataFrame:
    """(doc_key, page, line, text, heading): the lines of normalised pages that aren't blank."""
    split = pages.select("doc_key", "page", F.posexplode(F.split(T.normalized(F.coalesce("text", F.lit(""))), "\n")).alias("line", "x"))
    stripped = split.select("doc_key", "page", "line", T.strip(F.col("x")).alias("text")).where("text <> ''")
    return stripped.withColumn("heading", T.is_heading(F.col("text")))


def tree(pages: DataFrame, parent_max: int = 900, size: int = 450, overlap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(parents, children, with a parent_id) of the sections between headings.

    A parent is its section's first tokens, its children are windows over all of them. Each line knows
    where its tokens stand in the section, and enters the windows that it reaches into, so no row is larger
    than a window, and no task holds a document or a section. Sections without tokens have no number.
    """
    step = max(1, size - overlap)
    split = stored(_page_lines(pages))
    own = split.groupBy("doc_key", "page").agg(F.max("k").alias("k"), F.sum("n").alias("u"), F.max("h").alias("h"))
    placed = chains.running(own, "doc_key", "page", "k", "u").withColumn("h", F.col("h") + F.col("before_u"))
    placed = chains.running(placed.select("doc_key", "page", "before_k", "before_u", "h"), "doc_key", "page", "h", how=F.max).drop("h", "all_h")
    at = lambda c: F.col(f"before_{c}") + F.col(c)
    # tokens of the document before the last heading, which may stand on an earlier page
    begun = F.greatest("before_h", F.coalesce(F.col("before_u") + F.col("h"), F.lit(0)))
    marked = split.join(placed, ["doc_key", "page"]).select("doc_key", "page", "line", "text", "heading", "t", "n", at("k").alias("sec"), (at("u") - begun).alias("o"))
    titles = marked.where("heading").select("doc_key", "sec", T.heading_title(F.col("text")).alias("section_title"))
    body = marked.where("not heading and n > 0").select("doc_key", "sec", "page", "o", "t", "n")
    sections = body.groupBy("doc_key", "sec").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.lit(1).alias("one"))
    sections = chains.running(sections, "doc_key", "sec", "one").select("doc_key", "sec", "page_start", "page_end", F.col("before_one").alias("number")).join(titles, ["doc_key", "sec"], "left")

    def gathered(width: int, first: Column, last: Column, every: int) -> DataFrame:
        entered = body.select("doc_key", "sec", "o", "t", "n", F.explode(F.sequence(first, last)).alias("i"))
        lo, hi = F.greatest("o", F.col("i") * every), F.least(F.col("o") + F.col("n"), F.col("i") * every + width)
        some = F.array_join(F.slice(F.split("t", "\n"), (lo - F.col("o") + 1).cast("int"), (hi - lo).cast("int")), "\n")
        part = entered.where(hi > lo).select("doc_key", "sec", "i", F.struct("o", F.when(hi - lo == F.col("n"), F.col("t")).otherwise(some).alias("t")).alias("part"))
        whole = part.groupBy("doc_key", "sec", "i").agg(F.array_sort(F.collect_list("part")).alias("parts"))
        return whole.select("doc_key", "sec", "i", F.replace(F.array_join(F.transform("parts", lambda x: x["t"]), "\n"), F.lit("\n"), F.lit(" ")).alias("w")).join(sections, ["doc_key", "sec"])

    common = {"doc_key": F.col("doc_key"), "text": T.closed_up(F.col("w")), "page_start": F.col("page_start"), "page_end": F.col("page_end"), "section_title": F.col("section_title")}
    parent_id = _id("p", F.col("number"))
    heads = gathered(parent_max, F.lit(0), F.lit(0), parent_max)
    parents = heads.select(*_chunk(ord=F.col("number") * _STRIDE, chunk_id=parent_id, strategy=F.lit("tree_parent"), **common))
    first = F.greatest(F.lit(0), F.ceil((F.col("o") - (size - 1)) / step)).cast("int")
    last = F.floor((F.col("o") + F.col("n") - 1) / step).cast("int")
    windows = gathered(size, first, last, step)
    child_id = F.concat(parent_id, F.lit("/"), _id("c", F.col("i")))
    children = windows.select(*_chunk(ord=F.col("number") * _STRIDE + F.col("i"), chunk_id=child_id, strategy=F.lit("tree_child"), chunk_size=F.lit(size), overlap=F.lit(overlap), **common), parent_id.alias("parent_id"))
    return parents, children


def _page_lines(pages: DataFrame) -> DataFrame:
    """Lines as lines() has them, headings with their text and others with their tokens `t`, joined by line breaks, `n` of them. Of each: the headings of
    its page so far (k), the tokens before it on its page (u), and those before the last heading there so far (h), if any.
    Rows that repeat a page are one page, line by line."""
    normal = _normalized(pages)
    rows = normal.groupBy("doc_key", "page").agg(F.collect_list("text").alias("texts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                each = [U.lines(x[0] if len(x) == 1 else "\n".join(_merged(x))) for x in batch.column("texts").to_pylist()]
                rows = list(itertools.chain.from_iterable(each))
                if not rows:
                    continue
                of = np.repeat(np.arange(len(each)), [len(x) for x in each])
                first = np.searchsorted(of, of)
                heading = np.array([U.is_heading(x) for x in rows])
                tokens = L.listed(pa.array(["" if m else x for x, m in zip(rows, heading.tolist(), strict=True)], pa.string()))
                n = np.array([x.count("\n") + 1 if x else 0 for x in tokens.to_pylist()], np.int64)
                before = np.cumsum(n) - n
                u, k = before - before[first], np.cumsum(heading) - (np.cumsum(heading) - heading)[first]
                last = np.maximum.accumulate(np.where(heading, np.arange(len(rows)), -1))
                own = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(np.arange(len(rows)) - first, pa.int32()), pa.array([x if m else None for x, m in zip(rows, heading.tolist(), strict=True)], pa.string()), pa.array(heading), tokens, pa.array(n), pa.array(k), pa.array(u), pa.array(u[last], mask=last < first)],
                    names=["doc_key", "page", "line", "text", "heading", "t", "n", "k", "u", "h"],
                )

    own = StructType.fromDDL("line int, text string, heading boolean, t string, n bigint, k bigint, u bigint, h bigint")
    return rows.mapInArrow(cut, StructType([normal.schema["doc_key"], normal.schema["page"], *own.fields]))


def _merged(texts: list[str]) -> list[str]:
    """The first lines of all texts, then the second ones, and so on."""
    every = sorted((i, x) for text in texts for i, x in enumerate(text.split("\n")))
    return [x for _, x in every]


def folded(rows: DataFrame, order: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Chunks that `fold` makes of each doc_key's rows, which come in order, without doc_key."""
    dealt = rows.repartition("doc_key").sortWithinPartitions("doc_key", *order)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        chunks = ((key, *chunk) for key, own in itertools.groupby(stream, key=lambda r: r[0]) for chunk in fold(r[1:] for r in own))
        while part := list(itertools.islice(chunks, 256)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, CHUNK)


def _detokenize(tokens: list[str]) -> str:
    """As functions.text.detokenized, for folds."""
    text = " ".join(tokens)
    for mark in ".,:;?!)]}":
        text = text.replace(f" {mark}", mark)
    return text[0] + text[2:] if text[:1] in ("(", "[", "{") and text[1:2] == " " else text


def structured(pages: DataFrame, most: int = 800, least: int = 120, block: int = chains.BLOCK) -> DataFrame:
    """Sections between headings, and wherever `most` tokens have come together.

    A section longer than that is cut; what is left below `least` tokens behind a cut is dropped. Headings
    themselves are titles only.
    """

    def follow(b: chains.Block) -> tuple[np.ndarray, np.ndarray]:
        own, n = np.arange(b.own), len(b.at)
        heading = b.heading
        heads = np.append(np.flatnonzero(heading), n)
        full = np.searchsorted(b.sums[1:], b.before[own] + most)
        head = heads[np.searchsorted(heads, own)]
        following = np.where(heading[own], own + 1, np.minimum(np.where(head <= full, head, full + 1), n))
        return following, ~heading[own] & (b.sums[following] > b.before[own])

    def emit(b: chains.Block, start: int, end: int, number: int, title: str | None) -> Iterator[tuple]:
        full = (np.flatnonzero(b.size[start:end]) + start).tolist()
        held = [t for i in full for t in b.text[i].split("\n")]
        title = None if title is None else title.strip().strip(":")
        for part, at in enumerate(range(0, len(held), most)):
            piece = held[at : at + most]
            if part and len(piece) < least:
                return
            yield number * _STRIDE + part, f"s{number:04d}_c{part:04d}", _detokenize(piece), b.page[full[0]], b.page[end - 1], title, "structured_headings", None, None

    def cut(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, pa.Array]:
        """Lines: headings as they are, and the tokens of every other one; no token holds a line break."""
        each = [U.lines(x) for x in texts]
        rows = list(itertools.chain.from_iterable(each))
        marks = [U.is_heading(x) for x in rows]
        tokens = L.listed(pa.array(["" if m else x for x, m in zip(rows, marks, strict=True)], pa.string())).to_pylist()
        size = np.array([x.count("\n") + 1 if x else 0 for x in tokens], np.int32)
        return np.array([len(x) for x in each]), [x if m else t for x, m, t in zip(rows, marks, tokens, strict=True)], size, pa.array(marks, pa.bool_())

    rows = chains.pieces(_normalized(pages), cut, most, block).withColumnRenamed("mark", "known")
    return chains.chained(rows, follow, emit, CHUNK, most, block)


def _normalized(pages: DataFrame) -> DataFrame:
    return pages.select("doc_key", "page", T.normalized(F.coalesce("text", F.lit(""))).alias("text"))


def units(pages: DataFrame) -> DataFrame:
    """(doc_key, page, unit, text, n): headings and sentences of the pages, with their token counts."""
    split = pages.select("doc_key", "page", F.posexplode(T.units(F.coalesce("text", F.lit("")))).alias("unit", "text"))
    return split.withColumn("n", T.token_count(F.col("text")))


class Similarity(Protocol):
    """How alike two texts are; stands for an embedder whose vectors are multiplied."""

    def __call__(self, before: str, text: str) -> float: ...


def term_cosine(before: str, text: str) -> float:
    """Cosine of the counts of lower-cased words."""
    a, b = Counter(before.lower().split()), Counter(text.lower().split())
    norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(n * b[w] for w, n in a.items()) / norm if norm else 0.0


def _cosines(texts: list[str], first: np.ndarray) -> np.ndarray:
    """term_cosine of each text and the one before, none where `first` is set; texts hold no line breaks. All are counted at once."""
    out = np.full(len(texts), np.nan)
    each = [x.split() for x in "\n".join(texts).lower().split("\n")] if texts else []
    words = pa.array(itertools.chain.from_iterable(each), pa.string()).dictionary_encode()
    many = len(words.dictionary) + 1
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    keys, counts = np.unique(row * many + words.indices.to_numpy(), return_counts=True)
    row = keys // many
    norm = np.bincount(row, counts * counts, len(texts))
    if len(keys):
        at = np.searchsorted(keys, keys - many)
        both = keys[at] == keys - many
        dots = np.bincount(row[both], (counts[both] * counts[at[both]]), len(texts))
        size = np.sqrt(norm[1:] * norm[:-1])
        out[1:] = np.divide(dots[1:], size, out=np.zeros(len(size)), where=size > 0)
    else:
        out[1:] = 0.0
    out[first] = np.nan
    return out


#: How alike each of some texts and the one before it are, none where `first` is set.
Alike = Callable[[list[str], np.ndarray], np.ndarray]


def _alike(similarity: Similarity, embedder: Callable | None) -> Alike:
    made: list = []

    def products(texts: list[str], first: np.ndarray) -> np.ndarray:
        if not made:
            made.append(embedder())
        out = np.full(len(texts), np.nan)
        if len(texts):
            vectors = np.asarray(made[0](texts), dtype=float)
            out[1:] = (vectors[1:] * vectors[:-1]).sum(axis=1)
        out[first] = np.nan
        return out

    def each(texts: list[str], first: np.ndarray) -> np.ndarray:
        return np.array([np.nan if begins else similarity(texts[i - 1], texts[i]) for i, begins in enumerate(first.tolist())], float)

    return products if embedder is not None else _cosines if similarity is term_cosine else each


def _unit_pieces(pages: DataFrame, reach: int, block: int, alike: Alike | None = None) -> DataFrame:
    """Units as pieces; how alike each is to the one before it on its page is its mark."""

    def cut(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, pa.Array]:
        each = [U.units(x) for x in texts]
        counts = np.array([len(x) for x in each], np.int64)
        rows = list(itertools.chain.from_iterable(each))
        first = np.zeros(len(rows), bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        marks = pa.nulls(len(rows), pa.float64()) if alike is None else pa.array(alike(rows, first), pa.float64(), from_pandas=True)
        return counts, rows, L.token_counts(rows), marks

    return chains.pieces(_normalized(pages), cut, reach, block, "double").withColumnRenamed("mark", "known")


def semantic(pages: DataFrame, most: int = 450, least: int = 80, threshold: float = 0.55, similarity: Similarity = term_cosine, embedder: Callable | None = None, block: int = chains.BLOCK) -> DataFrame:
    """Units put together until they would pass `most` tokens or turn to something else, both only from
    `least` tokens on. A last chunk of under max(20, least // 2) tokens joins the one before.

    With an `embedder`, which operators.embed describes, units are alike by the product of their vectors; else by
    `similarity` of their texts. Units of a page are compared where they are cut, in batches, those at pages' ends in blocks.
    """
    compared = _alike(similarity, embedder)

    def follow(b: chains.Block) -> tuple[np.ndarray, np.ndarray]:
        own, n = np.arange(b.own), len(b.at)
        alike = b.known.copy()
        alike[0] = 1.0
        ends = np.flatnonzero(np.isnan(alike))
        pairs = [b.text[i] for end in ends.tolist() for i in (end - 1, end)]
        alike[ends] = compared(pairs, np.arange(len(pairs)) % 2 == 0)[1::2]
        turns = np.append(np.flatnonzero(alike < threshold), n)
        enough = np.maximum(np.searchsorted(b.before, b.before[own] + least), own + 1)
        full = np.searchsorted(b.sums[1:], b.before[own] + most, "right")
        return np.minimum(np.maximum(enough, full), turns[np.searchsorted(turns, np.minimum(enough, n))]).clip(max=n), np.ones(b.own, bool)

    def emit(b: chains.Block, start: int, end: int, number: int, _: str | None) -> Iterator[tuple]:
        first, last = b.page[start], b.page[end - 1]
        short = number > 0 and b.ends(end) and b.sums[end] - b.before[start] < max(20, least // 2)
        yield number * _STRIDE, f"s{number:04d}_p{first:04d}-{last:04d}", " ".join(b.text[start:end]), first, last, None, "semantic_similarity", most, None, bool(short)

    reach = max(most, least)
    chunks = chains.chained(_unit_pieces(pages, reach, block, compared), follow, emit, f"{CHUNK}, short boolean", reach, block)
    # a short last chunk and the one before it, or a chunk by itself
    place = (F.col("ord") - F.when(F.col("short"), _STRIDE).otherwise(0)).alias("__place")
    parts = chunks.groupBy("doc_key", place).agg(F.array_sort(F.collect_list(F.struct(*_COLUMNS[1:]))).alias("x"))
    own = {"text": F.array_join(F.transform("x", lambda x: x["text"]), " "), "page_end": F.element_at("x", -1)["page_end"]}
    return parts.select("doc_key", *[own.get(c, F.col("x")[0][c]).alias(c) for c in _COLUMNS[1:]])


class Chooser(Protocol):
    """Picks a boundary: of the units at hand, the candidates (end, tokens) and the one to fall back on, an
    end, or None to fall back."""

    def __call__(self, units: list[str], candidates: list[tuple[int, int]], pick: int) -> int | None: ...


def boundary(pages: DataFrame, most: int = 450, least: int = 80, window: int = 6, chooser: Chooser | None = None, block: int = chains.BLOCK) -> DataFrame:
    """Chunks whose ends a chooser picks near where `most` tokens come together.

    Ends within `window` units of there with `least` tokens or more are candidates. Without a choice, or
    with one below `least` or above 1.35 times `most` tokens, it is the largest that fits `most`, the first
    of equals, or else the smallest. A chooser that raises makes no choice. It is asked once for each chunk, so its
    documents are gone through in order, each in one task; without one they are cut in blocks.
    """
    if chooser is None and 0 < least <= most:
        return _unchosen(pages, most, least, window, block)

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple[str, int, int]] = []

        def reach(n: int) -> bool:
            """Takes units until n are at hand."""
            while len(held) < n and (row := next(rows, None)) is not None:
                held.append((row[2], row[0], row[3]))
            return len(held) >= n

        number = 0
        while reach(1):
            soft, total = 1, held[0][2]
            while total < most and reach(soft + 1):
                total += held[soft][2]
                soft += 1
            end = _end(held, soft, reach, most, least, window, chooser) if reach(soft + 1) else len(held)
            number += 1
            text = " ".join(x[0] for x in held[:end])
            yield number * _STRIDE, f"llm_{number:05d}", text, held[0][1], held[end - 1][1], None, "llm_boundary", most, 0
            del held[:end]

    return folded(units(pages), ["page", "unit"], fold)


def _unchosen(pages: DataFrame, most: int, least: int, window: int, block: int) -> DataFrame:
    """boundary() without a chooser."""

    def follow(b: chains.Block) -> tuple[np.ndarray, np.ndarray]:
        own, sums = np.arange(b.own), b.sums
        wanted = b.before[own] + most
        soft = np.searchsorted(sums, wanted)
        seen = np.minimum(soft, len(sums) - 1)
        # the last end that fits, and the first one with as many tokens
        fits = np.where(sums[seen] == wanted, seen, np.maximum(seen - 1, own))
        lowest = own + np.maximum(1, soft - own - window)
        end = np.where((fits >= lowest) & (sums[fits] - b.before[own] >= least), np.maximum(np.searchsorted(sums, sums[fits]), lowest), seen)
        return np.where((soft >= len(sums)) | (int(b.at[0]) + soft >= b.total), seen, end), np.ones(b.own, bool)

    def emit(b: chains.Block, start: int, end: int, number: int, _: str | None) -> Iterator[tuple]:
        yield (number + 1) * _STRIDE, f"llm_{number + 1:05d}", " ".join(b.text[start:end]), b.page[start], b.page[end - 1], None, "llm_boundary", most, 0

    rows = _unit_pieces(pages, most, block).withColumn("known", F.lit(None).cast("string"))  # nothing is compared
    return chains.chained(rows, follow, emit, CHUNK, most, block)


def _end(held, soft, reach, most, least, window, chooser) -> int:
    reach(soft + window)
    sums = [0, *itertools.accumulate(x[2] for x in held)]
    ends = range(max(1, soft - window), min(len(held), soft + window) + 1)
    candidates = [(e, sums[e]) for e in ends if sums[e] >= least]
    if not candidates:
        end = max(1, soft)
        total = sum(x[2] for x in held[:end])
        while total < least and reach(end + 1):
            total += held[end][2]
            end += 1
        return end
    fit = [c for c in candidates if c[1] <= most]
    pick = max(fit, key=lambda c: c[1])[0] if fit else min(candidates, key=lambda c: c[1])[0]
    if chooser is None:
        return pick
    try:
        end = chooser([x[0] for x in held], candidates, pick)
    except Exception:
        return pick
    return end if end is not None and 0 < end < len(sums) and least <= sums[end] <= 1.35 * most else pick


def build(pages: DataFrame, config: dict, **plugins) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Chunks by a configuration: `strategy`, and the chunker's own keys. Trees come as (parents, children)."""
    kind = config.get("strategy")
    number = lambda key, default: int(config.get(key, default))
    if kind == "naive_tokens":
        return naive(pages, int(config["chunk_size"]), int(config["overlap"]))
    if kind == "page_index":
        return page_index(pages)
    if kind == "late_chunking":
        return late(pages)
    if kind == "structured_headings":
        return structured(pages, number("max_tokens", 800), number("min_tokens", 120))
    if kind == "tree_parent_child":
        return tree(pages, number("parent_max_tokens", 900), number("child_chunk_size", 450), number("child_overlap", 100))
    if kind in ("semantic", "semantic_similarity"):
        return semantic(pages, number("max_tokens", 450), number("min_tokens", 80), float(config.get("similarity_threshold", 0.55)), plugins.get("similarity", term_cosine), plugins.get("embedder"))
    if kind in ("llm_boundary", "llm_boundary_summary"):
        return boundary(pages, number("max_tokens", 450), number("min_tokens", 80), number("boundary_window", 6), plugins.get("chooser"))
    raise ValueError(f"no chunker {kind!r}")
