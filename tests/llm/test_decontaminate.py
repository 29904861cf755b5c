import hashlib
import re

import numpy as np
import pytest
from conftest import lowered

from siftlens.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(texts, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lowered(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for i, t in texts:
        w, hit, held = WORD.findall(lowered(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    held |= found
        out.append((i, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_suffix_array_and_index():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 4, 500)
    seq[-1] = 0
    ends = seq == 0
    rank = np.where(ends, np.cumsum(ends) - 1, seq + ends.sum())
    assert d.suffix_array(seq).tolist() == sorted(range(500), key=lambda k: rank[k:].tolist())
    index = d.FMIndex(seq)
    for n in (1, 2, 4):
        patterns = rng.integers(1, 4, (20, n))
        alive, low, high = index.search(patterns.ravel(), np.arange(20) * n, n)
        for p, a, b in zip(alive, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b))) == [k for k in range(500 - n) if (seq[k : k + n] == patterns[p]).all()]
        for p in set(range(20)) - set(alive.tolist()):
            assert not [k for k in range(500 - n) if (seq[k : k + n] == patterns[p]).all()]


def test_supplied_documents(spark, shared, data, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, d.op4_decontaminate(spark, data).collect()), key=repr) == brute(texts, items)


@pytest.mark.parametrize("block_bytes", [16 << 20, 20])
def test_short_repeated_and_missing(spark, rows, block_bytes):
    texts = [(1, "The of the OF a"), (2, None), (3, ""), (4, "x the"), (5, "a b " * 3000), (5, "a b " * 3000), (None, "é the"), (6, "K the İ")]
    items = [(1, "the"), (2, "a b"), (3, ""), (4, " ".join(["a b"] * 10)), (5, "a b"), (6, None), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.digest(d.decontaminate(rows(texts), bench, block_bytes=block_bytes))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts, [("null" if i is None else i, t) for i, t in items])
    assert {r["n_hit"] for r in d.digest(d.decontaminate(rows(texts), bench.where("false"))).collect()} == {0}
    assert d.decontaminate(rows(texts).where("false"), bench).count() == 0


def test_a_large_benchmark_stays_small(spark):
    """Windows are arrays: of a million words, well under what as many Python objects would take."""
    import tracemalloc

    rng = np.random.default_rng(0)
    items = [(str(k), " ".join(map(str, rng.integers(0, 50_000, 2000)))) for k in range(500)]
    tracemalloc.start()
    phrases = d.Phrases(items)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(len(g[1]) for g in phrases.groups) > 990_000 and peak < 150e6


def test_sql_form(spark, shared, data):
    from siftlens.llm import queries
    from test_oracle import compare

    for name, sql in queries.oracle_sql().items():
        compare(spark, data, queries.queries()[name], sql)
