import math
import random

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank string"


def brute(rows, k, every):
    """rows: (vec_id, vector)."""
    ok = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in ok:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=10, **sizes):
    table = spark.createDataFrame([(i, v, 1, 0.5, "x") for i, v in rows], SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(table, k, every, **sizes).select("query_id", "rank", "vec_id", "score").collect())


def clustered(rng, n, groups=6, dim=8, spread=0.05):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for i in range(n)]


def with_copies(rng, n):
    rows = clustered(rng, n)
    hot = rows[3][1]
    return [(i, hot if i % 3 == 0 else v) for i, v in rows]


@pytest.mark.parametrize("sizes", [{"cell_rows": 20, "block_rows": 7}, {"cell_rows": 10_000}, {"cell_rows": 1, "block_rows": 1000}])
def test_against_brute_force(spark, sizes):
    rng = random.Random(3)
    rows = with_copies(rng, 240) + [(1000 + i, [rng.choice([0.0, 0.5, -0.5]) for _ in range(8)]) for i in range(60)]
    rows += [(2000, None), (2010, [0.5, None] * 4), (2020, [float("nan")] * 8), (2030, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2040, []), (2050, [1.0, 2.0]), (0, rows[0][1]), (0, rows[0][1]), (-10, [2.0] * 8)]
    rng.shuffle(rows)
    assert run(spark, rows, **sizes) == brute(rows, 5, 10)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (7, [0.25])]) == [(0, 1, 7, 256 * 64)]
    assert run(spark, [(0, [1e18, 1.0]), (1, [1e18, 1.0])]) == [(0, 1, 1, (1 << 63) - 1)]


def test_bounds_leave_cells_out(spark):
    """Where vectors cluster, queries travel to few blocks; the results stay those of brute force."""
    rng = random.Random(4)
    rows = clustered(rng, 600, groups=12, dim=16, spread=0.01)
    assert run(spark, rows, cell_rows=50) == brute(rows, 5, 10)
    table = spark.createDataFrame([(i, v, 1, 0.5, "x") for i, v in rows], SCHEMA)
    data = topk.quantised(table).persist()
    cells = topk.Cells(np.array([r.vec for r in data.where("vec_id < 36").select("vec").collect()]))
    homes = topk.assigned(data, cells).toPandas()
    n = len(cells.pivots)
    cells.radius, cells.norm, cells.blocks = np.zeros(n), np.zeros(n), np.zeros(n, int)
    for cell, own in homes.groupby("cell"):
        cells.radius[cell], cells.norm[cell], cells.blocks[cell] = own.far.max(), own.norm.max(), 1
    asked = homes[homes.vec_id % 10 == 0]
    scores = {i: sorted((int(np.dot(v, w)) for w in homes.vec), reverse=True)[5] for i, v in zip(asked.vec_id, asked.vec, strict=True)}
    groups = np.tile([0.0, 0.0, np.inf], (n, 1))
    for cell, own in asked.groupby("cell"):
        groups[cell] = own.far.max(), own.norm.max(), min(scores[i] for i in own.vec_id)
    frame = spark.createDataFrame([(int(r.vec_id), 0, [int(x) for x in r.vec], int(r.cell), float(r.norm), float(scores[r.vec_id])) for r in asked.itertuples()], "qid bigint, qh bigint, vec array<bigint>, cell int, norm double, least double")
    sent = {(r.qid, r.block) for r in topk.reached(frame, cells, groups).collect()}
    own = dict(zip(homes.vec_id, homes.cell, strict=True))
    vec = dict(zip(homes.vec_id, homes.vec, strict=True))
    first = cells.first()
    for q in asked.vec_id:
        for i, w in vec.items():
            if int(np.dot(vec[q], w)) >= scores[q] and own[i] != own[q]:
                assert (q, first[own[i]]) in sent
    assert len(sent) < len(asked) * (cells.blocks > 0).sum() / 2


def test_products_and_ties():
    a = np.array([[1 << 40, 3], [2, -1]])
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in a] for r in a]
    assert topk.products(a, a).tolist() == [[min(x, (1 << 63) - 1) for x in r] for r in want]
    scores = np.array([[5, 7, 7, 5, 7, 1] * 9, [0] * 54])
    assert topk.best(scores, 4).tolist() == [[1, 2, 4, 7], [0, 1, 2, 3]]
    assert topk.best(np.array([[np.iinfo(np.int64).min, 0]]), 3).tolist() == [[1, 0]]
    assert topk.matrix(pa.array([[1], [], [1, 2]], pa.list_(pa.int64()))).tolist() == [[1, 0], [0, 0], [1, 2]]
