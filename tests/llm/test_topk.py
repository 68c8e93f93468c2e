import math
import random

import numpy as np

from cairnflow.llm import topk

SCHEMA = "id long, e array<float>, v int, dim string"


def brute(rows, k):
    have = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = {}
    for q, a in have:
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in have if i != q)
            out[q] = [(i, -n) for n, i in s[:k]]
    return out


def got(spark, rows, k, block=4096):
    v = topk.whole_vectors(spark.createDataFrame(rows, SCHEMA), "id", "e", 1024)
    out = {}
    for r in sorted(topk.top_k(v, v.where("id % 100 = 0"), k, block).collect()):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_equals_brute_force_with_ties_nulls_and_several_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], 1, "x") for i in range(700)]
    rows += [(1000 + i, rows[5][1], 1, "x") for i in range(60)]  # ties
    rows += [(2000, None, 1, "x"), (2001, [1.0] * 7 + [None], 1, "x"), (2100, [float("nan")] * 8, 1, "x"), (2101, [float("inf")] * 8, 1, "x"), (2200, [0.0] * 8, 1, "x"), (2201, [900.0] * 8, 1, "x")]
    for block in (4096, 100):
        assert got(spark, rows, 10, block) == brute(rows, 10)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0], 1, "x"), (1, [0.5, 0.5], 1, "x")]
    assert got(spark, rows, 10) == brute(rows, 10)
    assert got(spark, [(0, None, 1, "x")], 10) == {}


def test_rows_without_an_id_take_no_part(spark):
    rows = [(i, [float(i % 7), 1.0], 1, "x") for i in range(0, 300, 50)]
    assert got(spark, [*rows, (None, [9.0, 9.0], 1, "x"), (None, [0.0, 0.0], 1, "x")], 10) == brute(rows, 10)


def test_huge_components(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 0.0]), (2, [-1e18, 5.0]), (3, [1.0, 1.0]), (100, [3e15, 3e15]), (4, [2e15, 2e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.whole_vectors(df, "vec_id", "embedding", 1024)
    got = {}
    for r in topk.top_k(v, v.where("id % 100 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    limit = 2**63
    fixed = {k: [max(-limit, min(limit - 1, int(1024 * x))) for x in c] for k, c in rows}
    for q, found in got.items():
        exact = {k: max(-limit, min(limit - 1, sum(a * b for a, b in zip(fixed[q], c, strict=True)))) for k, c in fixed.items() if k != q}
        assert found == sorted(exact.items(), key=lambda x: (-x[1], x[0]))


def test_many_groups_and_blocks_of_wide_vectors(spark, monkeypatch):
    """Blocks and groups shrink with the width; results don't change."""
    monkeypatch.setattr(topk, "ROW_VALUES", 8 * 90)
    monkeypatch.setattr(topk, "QUERY_VALUES", 8 * 2)
    rng = random.Random(4)
    rows = [(i * 10, [rng.gauss(0, 0.3) for _ in range(8)], 1, "x") for i in range(300)]
    rows += [(7 + i, [0.1, -0.2], 1, "x") for i in range(20)] + [(100_000, [0.3, 0.4], 1, "x")]  # another width
    v = topk.whole_vectors(spark.createDataFrame(rows, SCHEMA), "id", "e", 1024)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v, v.where("id % 100 = 0"), 10).collect())
    want = []
    for width in (8, 2):
        for q, best in brute([r for r in rows if len(r[1]) == width], 10).items():
            want += [(q, i + 1, *b) for i, b in enumerate(best)]
    assert found == sorted(want)
