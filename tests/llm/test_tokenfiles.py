import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from leafmill.llm import tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


def h64(text):
    x = xxhash.xxh64_intdigest((text or "").encode(), 42) if text is not None else 42
    return x - (1 << 64) if x >> 63 else x


def test_words_encode_like_whole_texts():
    own, tokenizer = tokenfiles.ByteBpe(PATH, cache=50), Tokenizer.from_file(PATH)
    texts = ["".join(p) for p in (("a  b", "\n", " c"), ("é 'll ", "\t\t"), ("<|endoftext|>x",), ("日本 語",), ("  ",), ("",), ("\x85 ²³ _",), (" x" * 90,))]
    texts += [chr(c) + "a " + chr(c) * 2 + "\n" for c in range(0x300)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_round_trip(spark, frame, odd):
    tokenizer = Tokenizer.from_file(PATH)
    manifest = tokenfiles.write_tokens(frame(odd), PATH, length=64, rows=4, partitions=3)
    got = [tuple(r) for r in tokenfiles.read_tokens(spark, manifest).collect()]
    want, start = [], 0
    for i, text in sorted(odd, key=lambda x: (x[0] is not None, x[0] or 0, h64(x[1]))):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    base, path, n_docs, n_tokens = manifest[-1]
    assert base + n_tokens == start


def test_sequences_are_views(spark, frame, odd):
    manifest = tokenfiles.write_tokens(frame(odd), PATH, length=64, rows=4, partitions=1)
    file = tokenfiles.TokenFile(manifest[0][1] + ".tokens.arrow")
    values, mask = file.sequence(5)
    assert len(values) == len(mask) == 64 and not values.flags.owndata
    assert values.tolist() == file.tokens(5 * 64, 64).tolist()
    last = (manifest[0][3] - 1) // 64
    assert sum(file.sequence(last)[1].to_pylist()) == manifest[0][3] - last * 64


def test_empty(spark, frame):
    assert tokenfiles.write_tokens(frame([]), PATH) == []
    assert tokenfiles.read_tokens(spark, []).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65])
def test_file_of_any_length(tmp_path, n):
    at = str(tmp_path / "x.arrow")
    with open(at, "wb") as f:
        out = tokenfiles._Writer(f, np.dtype("<u2"), 8, 2)
        out.add(np.arange(n, dtype="<u2").tobytes())
        out.close()
    assert tokenfiles.TokenFile(at).tokens(0, n).tolist() == list(range(n))


def test_rows_of_one_doc_id_are_dealt_out(spark, frame):
    """By text's hash, and equal rows by where they come from; files of few characters are many."""
    rows = [(1, f"text {k}") for k in range(300)] + [(2, "the same")] * 600
    manifest = tokenfiles.write_tokens(frame(rows).repartition(6), PATH, length=16, rows=2, partitions=8)
    assert len(manifest) > 4 and max(n for _, _, n, _ in manifest) < 400
    got = sorted(map(tuple, tokenfiles.read_tokens(spark, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1] * 300 + [2] * 600
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert len(tokenfiles.write_tokens(frame(rows), PATH, file_chars=100)) > 20


def test_masks_are_read(spark, frame):
    manifest = tokenfiles.write_tokens(frame([(1, "a b c")]), PATH, length=8, rows=2, partitions=1)
    base, path, n_docs, n_tokens = manifest[0]
    assert tokenfiles.TokenFile(path + ".tokens.arrow").masked() == n_tokens
    with pytest.raises(Exception, match="manifest counts"):
        tokenfiles.read_tokens(spark, [(base, path, n_docs, n_tokens + 1)]).collect()
