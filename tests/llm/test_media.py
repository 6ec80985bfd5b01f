import glob
import hashlib
import json
import math
import zipfile
import zlib

import pytest

from leafmill.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 100_000])
def test_png_round_trip(n):
    data = bytes(i * 7 % 256 for i in range(n))
    png = media.to_png(data)
    payload, length = media.from_png(png)
    assert payload == media.padded(data) and length == n and len(payload) % 64 == 0 and payload
    damaged = bytearray(png)
    damaged[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(damaged))


def want(text):
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64 or (0 if data else 64))
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_archives(spark, frame, odd):
    folder = media.store(frame(odd))
    for options in ({}, {"rangeBytes": 500, "batchBytes": 100}):
        rows = media.digests(media.load(spark, folder, **options)).collect()
        got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
        assert got == sorted((str(i), *want(t)) for i, t in odd)
    forms = {}
    for r in rows:
        forms.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature, r.n_bytes))
    assert sum(len(x) for x in forms.values()) == len({t or "" for _, t in odd})


def test_damaged_members_fail_alone(spark, frame):
    folder = media.store(frame([(i, f"text {i} " * 50) for i in range(20)]).coalesce(1))
    path = folder.removeprefix("file://")
    name = json.load(open(glob.glob(f"{path}/manifest-*.json")[0]))[0][0]
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(120)
        f.write(b"\0\0\0\0")
    rows = media.load(spark, folder, onError="row", tries=2).collect()
    assert len(rows) == 20 and sum(r.error is not None for r in rows) == 1
    assert next(r for r in rows if r.error).doc_id == 0
    with pytest.raises(Exception, match="member at 0"):
        media.load(spark, folder, tries=1).collect()


def test_a_member_is_tried_again(monkeypatch, spark, frame):
    folder = media.store(frame([(1, "a"), (2, "b")]).coalesce(1))
    reader = media.MediaReader(folder, {"tries": "2"})
    calls, read = [], media.MediaReader._bytes

    def flaky(self, path, offset, size, crc, again):
        calls.append((offset, again))
        if offset == 0 and not again:
            raise OSError("lost")
        return read(self, path, offset, size, crc, again)

    monkeypatch.setattr(media.MediaReader, "_bytes", flaky)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [1, 2] and calls[:2] == [(0, False), (0, True)] and len(calls) == 3


def test_empty(spark, frame):
    assert media.load(spark, media.store(frame([]))).collect() == []


def test_writes_add_up_unless_they_overwrite(spark, frame):
    folder = media.store(frame([(1, "a"), (2, "b")]))
    assert media.store(frame([(3, "c")]), folder) == folder
    assert sorted(r.doc_id for r in media.load(spark, folder).collect()) == [1, 2, 3]
    frame([(4, "d")]).select("doc_id", "text").write.format("media_archive").mode("overwrite").save(folder)
    assert [r.doc_id for r in media.load(spark, folder).collect()] == [4]


def described(payload):
    """The feature, sample by sample."""
    n = len(payload)
    mean = sum(payload) / n
    shares = [payload.count(bytes([v])) / n for v in range(256)]
    return {"rows": n // 64, "mean": mean * 1000, "dev": 1000 * math.sqrt(sum((v - mean) ** 2 for v in payload) / n), "entropy": -1000 * sum(p * math.log2(p) for p in shares if p), "step": 1000 * sum(abs(a - b) for a, b in zip(payload, payload[1:])) / max(n - 1, 1)}


def test_features_and_stored_forms(spark, frame, odd):
    """Features against their definition; media_sha256 is the digest of members as zipfile reads them."""
    texts = [x for x in odd if len(x[1] or "") < 2000]
    folder = media.store(frame(texts))
    stored = {}
    for path in glob.glob(folder.removeprefix("file://") + "/*.zip"):
        with zipfile.ZipFile(path) as z:
            for name in z.namelist():
                stored.setdefault(name.split(".")[1], set()).add(hashlib.sha256(z.read(name)).hexdigest())
    rows = media.digests(media.load(spark, folder)).collect()
    assert all(r.media_sha256 in stored["null" if r.doc_id is None else str(r.doc_id)] for r in rows)
    for r in media.load(spark, folder).collect():
        got = {k: int(v) for k, v in (x.split("=") for x in r.feature.split(";"))}
        exact = described(bytes(r.payload))
        assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) <= 1 for k in got), (r.doc_id, got, exact)
