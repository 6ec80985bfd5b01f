"""Embedders: plug-ins that turn texts into vectors, made once a task; a hashed stand-in; and a registry of them."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval as R

class Embedder(Protocol):
    """Vectors of texts, a row for each."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


Maker = Callable[[], Embedder]
#: UTF-8 with A-Z in lower case, and a blank for what is no digit, letter or beyond ASCII.
_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def hashed(dim: int = 64) -> Maker:
    """The stand-in for a model: counts of words, A-Z in lower case, in the bucket that the first 32 bits of
    their MD5 name, at length 1. A text without words is all zeros."""

    def make() -> Embedder:
        #: Buckets of words met, forgotten when there are many.
        known: dict[bytes, int] = {}

        def embed(texts: list[str]) -> np.ndarray:
            each = [text.encode().translate(_BYTES).split() for text in texts]
            words = list(itertools.chain.from_iterable(each))
            new = set(words) - known.keys()
            if len(known) + len(new) > 400_000:
                known.clear()
                new = set(words)
            for word in new:
                known[word] = int.from_bytes(hashlib.md5(word).digest()[:4]) % dim
            row = np.repeat(np.arange(len(texts)), [len(x) for x in each])
            place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            return R.unit(np.bincount(row * dim + place, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float))

        return embed

    return make


#: What makes an embedder of each type from a configuration's other keys. Models are plug-ins: whoever has one adds it.
MAKERS: dict[str, Callable[..., Maker]] = {"hashed": hashed}
#: Names that mean one type.
SAME = {"st": "sentence_transformers", "sbert": "sentence_transformers", "sentence_transformer": "sentence_transformers"}


def register(kind: str, maker: Callable[..., Maker]) -> None:
    """From now on configurations of this type are made by `maker`, which gets their other keys by name."""
    MAKERS[kind] = maker


def build(config: dict | None) -> Maker | None:
    """The embedder that a configuration names; None for TF-IDF, which is an index. A type that nobody has
    registered is an error."""
    keys = dict(config or {})
    kind = _kind(config)
    keys.pop("type", None)
    if kind == "tfidf":
        return None
    kind = SAME.get(kind, kind)
    if kind not in MAKERS:
        raise ValueError(f"no embedder {kind!r}; there are {sorted(MAKERS)}")
    return MAKERS[kind](**keys)


def for_boundaries(chunking: dict, embedding: dict | None = None) -> Maker:
    """The embedder of semantic chunking: its own, else that of retrieval unless it is TF-IDF, else a sentence
    transformer. TF-IDF can't be its own."""
    choices = (chunking.get("semantic_embedder"), embedding if _kind(embedding) != "tfidf" else None, {"type": "sentence_transformers"})
    named = next(c for c in choices if c)
    if _kind(named) == "tfidf":
        raise ValueError("semantic chunking compares vectors; TF-IDF has none")
    return build(named)


def _kind(config: dict | None) -> str:
    return str((config or {}).get("type", "tfidf")).lower()


def embedded(text: Column, make: Maker) -> Column:
    """The vector of each text, null as an empty one, as doubles."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), dtype=float)), index=texts.index)

    return F.pandas_udf(run, "array<double>")(text)


def best(docs: DataFrame, questions: DataFrame, make: Maker, k: int, how: str = "cosine") -> DataFrame:
    """(qid, doc, score, rank): the k best documents (doc, text) of every question (qid, text) by their vectors.
    Each text is embedded once."""
    vec = embedded(F.col("text"), make).alias("vec")
    return R.nearest(questions.select("qid", vec).persist(), docs.select("doc", vec).persist(), k, how)
