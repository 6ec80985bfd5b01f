"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words of letters and their first 4 and 5 letters, which word forms share,
each once, hashed to 2^24 buckets. The machine scores
w0 + sum of w_i + sum over pairs of <v_i, v_j>: the weights w add up like those of a linear model, and the
factors v let two terms together mean more than each alone, such as an insult with the naming of a group.

It is fitted on a sample of `Settings.sample` labelled rows at most, whatever the size of the table: those of
the smallest hashes. Of the `Settings.vocabulary` buckets that most of them hold, two kinds are chosen: those
on which the label depends most by themselves (chi-square), and, among the `Settings.candidates` most common
ones, those of the pairs whose rows differ most from what the two say each by itself, so that terms which
matter together only are there for the factors. Weights and factors are fitted by AdaGrad on the log loss.
The model is some hundred buckets, so its size is bounded too, and it is sent with the tasks that score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import mapped, pieces, saved

_FIND = re.compile(r"[^\W\d_]+").findall
#: Rows of texts or of pairs that the fit lays out at once, and terms that it looks up at once: it runs in the driver.
_BLOCK, _TERMS = 256, 1 << 17


@dataclass(frozen=True)
class Settings:
    #: So many labelled rows are fitted on, at most.
    sample: int = 6_000
    #: So many buckets, held by most rows of the sample, are looked at, at most; those of whole texts count.
    vocabulary: int = 1 << 16
    bits: int = 24
    features: int = 512
    #: So many of them are looked at in pairs; of these, buckets of so many pairs are chosen at most, each at least so many deviations off.
    candidates: int = 2048
    pairs: int = 64
    deviations: float = 7.0
    least_rows: int = 4
    factors: int = 6
    epochs: int = 30
    batch: int = 256
    rate: float = 0.5
    l2: float = 2e-5
    l2_factors: float = 2e-4
    seed: int = 7


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _hashes(word: str, mask: int) -> set[int]:
    """Buckets of a word's terms; its beginnings are marked, so that they are not words."""
    return {zlib.crc32(x.encode()) & mask for x in (word, *(f"{word[:k]}*" for k in (4, 5) if len(word) >= k))}


def terms(text: str | None, bits: int = 24) -> np.ndarray:
    """Different buckets of the text's terms, ascending."""
    if not text:
        return np.empty(0, np.int64)
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((x for w in set(_FIND(text.lower())) for x in _hashes(w, mask)), np.int64))


@dataclass(frozen=True)
class Machine:
    bits: int
    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts, with a (row, column) for each of the model's buckets in them."""
        return 1 / (1 + np.exp(-np.clip(self._raw(rows, columns, n)[0], -40, 40)))

    def _raw(self, rows, columns, n):
        linear = np.bincount(rows, self.weights[columns], n)
        v = self.factors[columns]
        sums = np.stack([np.bincount(rows, v[:, f], n) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(rows, (v * v).sum(axis=1), n)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def telling_pairs(labels: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int, settings: Settings) -> np.ndarray:
    """Columns, of n, of the pairs whose texts' labels differ most from what both columns say by themselves."""
    if n < 2:
        return np.empty(0, np.int64)
    both, bad = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    order = np.argsort(rows, kind="stable")
    begin = np.searchsorted(rows[order], np.arange(0, len(labels) + _BLOCK, _BLOCK))
    for k, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
        part = labels[k * _BLOCK : (k + 1) * _BLOCK].astype(np.float32)
        held = np.zeros((len(part), n), np.float32)
        held[rows[order[a:b]] - k * _BLOCK, columns[order[a:b]]] = 1
        both += held.T @ held
        bad += held.T @ (held * part[:, None])
    p, seen = labels.mean(), np.diag(both).copy()
    alone = np.diag(bad) / np.maximum(seen, 1) - p
    found, most = [], []
    for a in range(0, n, _BLOCK):
        each = both[a : a + _BLOCK]
        z = np.abs(bad[a : a + _BLOCK] - each * (p + alone[a : a + _BLOCK, None] + alone[None, :])) / np.sqrt(np.maximum(each, 1) * p * (1 - p))
        # terms that stand together only are one term
        z[(each < settings.least_rows) | (each > 0.9 * np.minimum(seen[a : a + _BLOCK, None], seen[None, :]))] = 0
        z = np.triu(z, 1 + a)
        at = np.flatnonzero(z >= settings.deviations)
        found.append(at + a * n)
        most.append(z.reshape(-1)[at])
    at, z = np.concatenate(found), np.concatenate(most)
    at = at[np.argsort(-z, kind="stable")[: settings.pairs]]
    return np.unique(np.stack(np.unravel_index(at, (n, n))))


def _gradients(machine: Machine, rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, settings: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean log loss with its penalties: by the bias, the weights and the factors."""
    d, k = machine.factors.shape
    raw, sums = machine._raw(rows, columns, len(labels))
    error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels) / len(labels)
    own, per = machine.factors[columns], error[rows]
    dw = np.bincount(columns, per, d) + settings.l2 * machine.weights
    dv = np.stack([np.bincount(columns, per * (sums[rows, f] - own[:, f]), d) for f in range(k)], axis=1) + settings.l2_factors * machine.factors
    return float(error.sum()), dw, dv


def fit(labels: np.ndarray, rows: np.ndarray, buckets: np.ndarray, settings: Settings) -> Machine:
    """labels of the texts; a (row, bucket) for each different term in them."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        always = float(labels.mean()) if n else 0.0
        return Machine(settings.bits, np.empty(0, np.int64), float(np.log((always * n + 1) / ((1 - always) * n + 1))), np.zeros(0), np.zeros((0, settings.factors)))
    known = np.unique(buckets)
    inverse, seen, bad = np.empty(len(buckets), np.int32), np.zeros(len(known), np.int64), np.zeros(len(known))
    for a in range(0, len(buckets), _TERMS):
        own = np.searchsorted(known, buckets[a : a + _TERMS])
        inverse[a : a + _TERMS] = own
        seen += np.bincount(own, minlength=len(known))
        bad += np.bincount(own, labels[rows[a : a + _TERMS]], len(known))
    p = labels.mean()
    chi = np.where(seen >= settings.least_rows, (bad - p * seen) ** 2 / (p * (1 - p) * seen), -1)
    chosen = np.argsort(-chi, kind="stable")[: min(settings.features, int((chi >= 0).sum()))]
    common = np.argsort(-seen, kind="stable")[: min(settings.candidates, int((seen >= settings.least_rows).sum()))]
    rank = np.full(len(known), -1, np.int32)
    rank[common] = np.arange(len(common))
    looked = rank[inverse] >= 0
    paired = telling_pairs(labels, rows[looked], rank[inverse][looked], len(common), settings)
    chosen = np.union1d(chosen, common[paired])
    place = np.full(len(known), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    keep = place[inverse] >= 0
    rows, columns = rows[keep], place[inverse][keep]
    order = np.argsort(rows, kind="stable")
    rows, columns = rows[order], columns[order]
    begin = np.searchsorted(rows, np.arange(n + 1))
    rng = np.random.default_rng(settings.seed)
    d, k = len(chosen), settings.factors
    machine = Machine(settings.bits, known[chosen], 0.0, np.zeros(d), rng.normal(0, 0.01, (d, k)))
    bias, gw, gv, gb = float(np.log(p / (1 - p))), np.full(d, 1e-6), np.full((d, k), 1e-6), 1e-6
    for _ in range(settings.epochs):
        shuffled = rng.permutation(n)
        for at in range(0, n, settings.batch):
            part = shuffled[at : at + settings.batch]
            sizes = begin[part + 1] - begin[part]
            index = np.repeat(begin[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            r, c = np.repeat(np.arange(len(part)), sizes), columns[index]
            now = Machine(settings.bits, machine.buckets, bias, machine.weights, machine.factors)
            db, dw, dv = _gradients(now, r, c, labels[part], settings)
            gw += dw * dw
            gv += dv * dv
            gb += db**2
            machine.weights[:] -= settings.rate * dw / np.sqrt(gw)
            machine.factors[:] -= 0.2 * settings.rate * dv / np.sqrt(gv)
            bias -= settings.rate * db / np.sqrt(gb)
    return Machine(settings.bits, machine.buckets, bias, machine.weights, machine.factors)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    """Fits on rows of `labels` (doc_id, toxic) that are not held out, with their texts from `docs`.

    Rows with a null doc_id or label are left aside, as are labels without a document; a document that has
    several labels counts with each. With labels of one kind only, every score is their share.
    """
    usable = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__of"), F.col("toxic").cast("double").alias("label"))
    sampled = saved(usable.orderBy(F.xxhash64("__of"), "__of", "label").limit(settings.sample), "sample")
    rows = F.broadcast(sampled)
    texts = docs.select("doc_id", "text").join(rows, F.col("doc_id") == F.col("__of")).select("label", "text", F.xxhash64("text", "doc_id").alias("at"))
    bits = settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("at"), pa.array([terms(t.as_py(), bits) for t in batch.column("text")], pa.list_(pa.int32()))], names=["label", "at", "terms"])

    # a doc_id may repeat without end: the bound on rows holds for texts too
    found = saved(mapped(texts, run, "label double, at bigint, terms array<int>").orderBy("at", "label").limit(settings.sample), "terms")
    often = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= settings.least_rows)
    known = np.sort(often.orderBy(F.col("n").desc(), "term").limit(settings.vocabulary).select("term").toArrow()["term"].to_numpy().astype(np.int32))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.intersect1d(x.values.to_numpy(), known, assume_unique=True).astype("<i4").tobytes() for x in batch.column("terms")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("at"), pa.array(kept, pa.binary())], names=["label", "at", "terms"])

    got = mapped(found, looked_up, "label double, at bigint, terms binary").toArrow().sort_by([(c, "ascending") for c in ("at", "label", "terms")])
    sizes = pc.binary_length(got["terms"]).to_numpy() // 4
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    buckets, at = np.empty(len(rows), np.int32), 0
    for x in got["terms"]:
        own = np.frombuffer(x.as_buffer(), "<i4")
        buckets[at : at + len(own)] = own
        at += len(own)
    labels = got["label"].to_numpy()
    del got
    return fit(labels, rows, buckets, settings)


def _scores(texts: list[str | None], machine: Machine, memo: dict[str, tuple[int, ...]], most: int = 200_000) -> np.ndarray:
    """memo: the model's columns of each word met; emptied when full."""
    mask = (1 << machine.bits) - 1
    column = {int(b): i for i, b in enumerate(machine.buckets)}
    rows, columns = [], []
    for k, text in enumerate(texts):
        if not text:
            continue
        own = set(_FIND(text.lower()))
        new = [w for w in own if w not in memo]
        if new:
            if len(memo) + len(new) > most:
                memo.clear()
                new = own
            for w in new:
                memo[w] = tuple(column[b] for b in _hashes(w, mask) if b in column)
        found = {c for hit in map(memo.__getitem__, own) if hit for c in hit}
        rows += [k] * len(found)
        columns += found
    return machine.score(np.array(rows, np.int64), np.array(columns, np.int64), len(texts))


def scored(docs: DataFrame, machine: Machine, below: float | None = None) -> DataFrame:
    """The columns of `docs` with score, from 0 to 1; with `below`, those of `docs` alone, rows of a lower
    score only.

    The text alone makes the score. Null and empty texts have no terms and score the model's bias. Rows
    stand alone: repeated rows score alike, and an empty table gives an empty one. An older column named
    score is replaced, except with `below`.
    """
    frame = docs if below is not None else docs.drop("score")
    schema = frame.schema if below is not None else StructType([*frame.schema.fields]).add("score", DoubleType())
    memo: dict[str, tuple[int, ...]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = _scores(batch.column("text").to_pylist(), machine, memo)
            yield batch.filter(pa.array(scores < below)) if below is not None else pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return mapped(frame, run, schema)
