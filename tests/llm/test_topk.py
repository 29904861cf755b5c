import math
import random

import numpy as np
import pytest

from siftlens.llm import topk as d
from siftlens.llm.topk import op1_topk, top_k


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = {}
    for q, a in ok:
        for i, b in ok if q % every == 0 else ():
            if i != q:
                best[q, i] = max(best.get((q, i), -(1 << 62)), sum(x * y for x, y in zip(a, b, strict=False)))
    lists = {}
    for (q, i), s in best.items():
        lists.setdefault(q, []).append((-s, i))
    return sorted((q, r + 1, i, -s) for q, found in lists.items() for r, (s, i) in enumerate(sorted(found)[:k]))


def check(df, **options):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, **options).collect())
    assert got == brute([(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()])


def test_supplied_vectors(spark, shared, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    check(df)
    assert op1_topk(spark, data).columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("group_bytes", [1 << 20, 60])
def test_ties_repeats_nulls(spark, shared, group_bytes):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.1, -0.2, 0.3]) for _ in range(3)], 1) for i in range(120)] + [(i, [0.5] * 3, 1) for i in range(400, 460)] + [(7, [0.1, 0.1], 1), (50, [9.0] * 3, 0)]
    rows += [(1000, None, 1), (1050, [1.0, None, 2.0], 1), (1100, [math.nan] * 3, 1), (1150, [math.inf] * 3, 1), (None, [1.0] * 3, 1), (450, [0.5] * 3, 1)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), group_bytes=group_bytes)


def test_repeated_rows_leave_room_for_other_ids(spark, shared):
    rows = [(i, [0.5, 1.0]) for i in [1] * 6 + [2, 3, 4, 5, 6, 50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    check(df)
    assert top_k(df).count() == 5
    check(df.union(df).coalesce(1))


def test_large_components(spark, shared):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.5, -3.0, 1e6, -5e6, 524288.0]) for _ in range(4)]) for i in range(130)]
    rows += [(203, [3e13, 0.0, 0.0, -2.0]), (201, [1e17, -1e17, 1e-3, 1.0]), (202, [-1e17, 0.0, 0.0, 0.0]), (250, [1.0, 1.0, 0.5, 0.5]), (300, [0.0, 0.0, 1e14, 0.0])]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id < 200 or vec_id = 250"))
    small = [(i, [1.0, 1.0, v[2] / 1e6, v[3] / 1e6] if i % 50 == 0 else [x / 1e6 for x in v]) for i, v in rows[:130]]
    check(spark.createDataFrame(small + [r for r in rows[130:] if r[0] != 300], "vec_id long, embedding array<double>"))


def test_scores_beyond_a_long_are_an_error(spark, shared):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        top_k(df).collect()


def test_few_and_none(spark, shared):
    df = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    check(df)
    check(df.where("vec_id = 3"))
    check(df.where("false"))


def test_thresholds_skip_work():
    """Of vectors with some long ones, phase 2 leaves few pairs to be resolved, and none that reaches the cutoff out."""
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 60, (3000, 64)) * rng.gamma(2, 1, (3000, 1)))
    q = np.floor(rng.normal(0, 60, (40, 64)))
    scores = q @ v.T
    floor = np.sort(scores, axis=1)[:, -5]
    row, col = d._reaching(q, v, np.ones(scores.shape, bool), floor, (d._left(q), d._left(v)))
    assert len(row) < 0.1 * scores.size
    assert (d._resolved(q, v, row, col) == scores[row, col]).all()
    assert {*zip(*np.nonzero(scores >= floor[:, None]), strict=True)} <= {*zip(row, col, strict=True)}
