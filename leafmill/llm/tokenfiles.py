"""Token-id output: Arrow files whose batches hold fixed-size lists, for zero-copy access to sequences.

`write_tokens` deals the documents out by ranges of doc_id (and of the text's hash, where doc_ids repeat). Each range becomes two Arrow IPC files in a
shared folder: NAME.tokens.arrow, with a row for every sequence of `length` ids (`tokens`, a fixed-size
list of the smallest unsigned type that holds the vocabulary) and a `mask` (a fixed-size list of booleans,
false behind the last id), and NAME.docs.arrow with doc_id, offset and n_tokens of each document in it.
All batches of a file but the last have the same number of rows, so sequence number i is found by a
division. A task writes under names of its own attempt, and only those of the attempts that count enter
the manifest: a lost executor leaves files that nothing refers to.
"""

from __future__ import annotations

import array
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo, byte_symbols
from .common import filesystem, fresh_path, mapped, pieces

MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint"
_LATIN_LETTERS, _LATIN_NUMBERS, _LATIN_SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
#: The library's byte-level split, with its classes spelt out for characters up to U+00FF.
_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN_LETTERS}]+| ?[{_LATIN_NUMBERS}]+| ?[^{_LATIN_SPACE}{_LATIN_LETTERS}{_LATIN_NUMBERS}]+|[{_LATIN_SPACE}]+(?![^{_LATIN_SPACE}])|[{_LATIN_SPACE}]+"
).findall


class ByteBpe:
    """Ids of the tokenizers library for a byte-level BPE file, each word encoded by it once while it is kept."""

    def __init__(self, path: str, cache: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.tokenize, self.symbols, self.code = self.whole.model.tokenize, byte_symbols(), "H" if self.dtype.itemsize == 2 else "I"
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.cache, self.memo = cache, Memo(self._word, {})

    def _word(self, word: str) -> bytes:
        """Ids of one word of the split; the library's model takes it in the symbols of its bytes."""
        if word.isascii() and word.isprintable() and " " not in word[1:]:
            symbols = "Ġ" + word[1:] if word[0] == " " else word
        else:
            symbols = "".join(map(self.symbols.__getitem__, word.encode()))
        return array.array(self.code, [t.id for t in self.tokenize(symbols)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, in the bytes of `dtype`."""
        if len(self.memo) > self.cache:
            self.memo = Memo(self._word, self.memo)
        get, out = self.memo.__getitem__, []
        for text in texts:
            plain = not any(x in text for x in self.added)
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                plain = False
            if plain:
                out.append(b"".join(map(get, _SPLIT(text))))
            else:
                out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes())
        return out


_LOADED: dict[str, ByteBpe] = {}


class _Writer:
    """One token file, written as ids come."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.dtype, self.length, self.full, self.buffer, self.n = dtype, length, rows * length * dtype.itemsize, bytearray(), 0

    def add(self, ids: bytes) -> None:
        self.n += len(ids) // self.dtype.itemsize
        self.buffer += ids
        while len(self.buffer) >= self.full:
            self._batch(bytes(self.buffer[: self.full]))
            del self.buffer[: self.full]

    def _batch(self, ids: bytes) -> None:
        values = np.frombuffer(ids, self.dtype)
        n = -(-len(values) // self.length) * self.length
        mask = np.arange(n) < len(values)
        if n > len(values):
            values = np.concatenate([values, np.zeros(n - len(values), self.dtype)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.buffer:
            self._batch(bytes(self.buffer))
        self.out.close()


class TokenFile:
    """Random access to a token file: `sequence(i)` and `tokens(start, n)`. Sequences are views of the file's
    bytes where the file is on a local file system or a mounted one, else of one batch read."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.source = pa.memory_map(at) if isinstance(fs, LocalFileSystem) else fs.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("tokens").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.at, self.batch = -1, None

    def _load(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch = self._load(i // self.rows)
        row = i % self.rows
        return (batch.column("tokens").slice(row, 1).flatten().to_numpy(), batch.column("mask").slice(row, 1).flatten())

    def tokens(self, start: int, n: int) -> np.ndarray:
        size, out, end = self.rows * self.length, [], start + n
        while start < end:
            k, at = divmod(start, size)
            out.append(self._load(k).column("tokens").flatten().to_numpy()[at : at + end - start])
            start += len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)

    def masked(self) -> int:
        """The number of ids that the masks count; raises ValueError if another id stands before one of them."""
        n = 0
        for k in range(self.file.num_record_batches):
            mask = self._load(k).column("mask").flatten()
            here = pc.sum(mask).as_py() or 0
            if here and (n != k * self.rows * self.length or not mask[here - 1].as_py()):
                raise ValueError(f"masks with a gap in batch {k}")
            n += here
        return n

    def close(self) -> None:
        self.source.close()


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = 1024, rows: int = 256, end: int = 0, partitions: int | None = None, file_chars: int = 256 << 20) -> list:
    """Writes the token files of `docs` (doc_id, text) and returns the manifest: rows (base, path, n_docs,
    n_tokens) in ascending doc_id order, `base` counting the ids of the files before.

    A null text is an empty one; id `end` closes every document. Null doc_ids come first; rows of equal
    doc_id are ordered by the text's XXH64, and equal rows are all written, dealt to several files if they are
    many. An empty table has an empty manifest. The manifest has a row for each file: one for each of
    `partitions` ranges, by default enough for files of about `file_chars` characters.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    if partitions is None:
        total = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-total // file_chars))
    order = [F.col("doc_id").asc_nulls_first(), F.col("at")]
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("at"), F.spark_partition_id().alias("from"))
    dealt = marked.repartitionByRange(partitions, *order, F.col("from")).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = ByteBpe(tokenizer)
        bpe = _LOADED[tokenizer]
        close = np.array([end], bpe.dtype).tobytes()
        out = None
        for batch in pieces(batches, "text", 4 << 20):
            if out is None:
                fs, at = filesystem(f"{folder}/{uuid.uuid4().hex}")
                fs.create_dir(os.path.dirname(at), recursive=True)
                out, offset, n_docs = _Writer(sink := fs.open_output_stream(f"{at}.tokens.arrow"), bpe.dtype, length, rows), 0, 0
                index = pa.ipc.new_file(index_sink := fs.open_output_stream(f"{at}.docs.arrow"), _DOCS)
            ids = [x + close for x in bpe.encode([t or "" for t in batch.column("text").to_pylist()])]
            n = np.array([len(x) // bpe.dtype.itemsize for x in ids], np.int64)
            for x in ids:
                out.add(x)
            starts = offset + np.concatenate([[0], np.cumsum(n)[:-1]])
            index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(n)], schema=_DOCS))
            offset, n_docs = offset + int(n.sum()), n_docs + len(ids)
        if out is not None:
            for x in (out, index, sink, index_sink):
                x.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{os.path.basename(at)}"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([offset], pa.int64())})

    found = mapped(dealt, run, MANIFEST).collect()
    base, out = 0, []
    for x in sorted(found):
        out.append((base, x.path, x.n_docs, x.n_tokens))
        base += x.n_tokens
    return out


_DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


def read_tokens(spark: SparkSession, manifest: list) -> DataFrame:
    """One row for each document of the files: doc_id, start (the ids of all documents before it), n_tokens,
    ids_crc32 (unsigned, of its ids as little-endian 32-bit integers), all read from the files. The masks of a
    file must count the ids that the manifest does; ValueError else."""
    n = len(manifest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                base, path, _, n_tokens = manifest[k]
                fs, at = filesystem(f"{path}.docs.arrow")
                tokens = TokenFile(f"{path}.tokens.arrow")
                if tokens.masked() != n_tokens:
                    raise ValueError(f"{path} has not the ids that its manifest counts")
                with fs.open_input_file(at) as source:
                    index = pa.ipc.open_file(source)
                    for j in range(index.num_record_batches):
                        docs = index.get_batch(j)
                        crc = [
                            zlib.crc32(tokens.tokens(s, m).astype("<u4").tobytes())
                            for s, m in zip(docs.column("offset").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True)
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [docs.column("doc_id"), pa.array(docs.column("offset").to_numpy() + base), docs.column("n_tokens"), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                tokens.close()

    return mapped(spark.range(0, n, 1, max(n, 1)), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
