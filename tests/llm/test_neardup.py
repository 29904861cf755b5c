import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import lowered

from siftlens.llm import neardup as d

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts):
    sets = []
    for _, t in texts:
        w = WORD.findall(lowered(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent, held = list(range(len(texts))), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in held.get(x, ())).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(k), root(j)), key=lambda x: texts[x][0])
                parent[b] = a
        for x in s:
            held.setdefault(x, []).append(k)
    return sorted((i, len(sets[k]), texts[root(k)][0], texts[root(k)][0] == i) for k, (i, _) in enumerate(texts))


def check(df, texts):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())
    assert got == brute(texts)


def test_supplied_documents(spark, shared, data, texts):
    check(d.op10_neardup(spark, data), texts)


def test_chains_groups_and_missing(rows):
    rng = random.Random(3)
    word = lambda: str(rng.randint(0, 10**6))
    base = [word() for _ in range(80)]
    texts = [(1, None), (2, ""), (3, " \t "), (4, "A b"), (5, "a  B\n"), (6, "é é é é é é"), (7, "É é é é é é"), (8, "w " * 20_000), (9, "W " * 20_001)]
    for k in range(10, 100):
        w = list(base)
        for j in rng.sample(range(80), k % 5):
            w[j] = "x" + word()
        texts.append((k, " ".join(w)))
    w = base[:]
    for k in range(200, 240):
        w = [*w[2:], f"n{k}", f"m{k}"]
        texts.append((k, " ".join(w)))
    check(d.near_duplicates(rows(texts)), texts)


def test_repeated_rows_and_ids(spark, rows):
    text = "one two three four five six seven"
    df = rows([(3, text), (3, text), (5, text.upper()), (5, "other words that are not the same at all"), (None, text)])
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in d.near_duplicates(df).collect())
    assert got == [(0, 3, None, True), (3, 3, 3, True), (3, 3, 3, True), (5, 3, 3, False), (5, 5, 5, True)]
    assert d.near_duplicates(df.where("false")).count() == 0


def test_stage_keeps_one_of_each_group(spark, rows):
    df = rows([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (4, None)])
    out = d.stage(spark, df, "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4] and out.columns == df.columns


def test_stage_judges_rows_that_share_an_id_apart(spark, rows):
    text, other = "one two three four five six seven", "other words that are not the same at all"
    df = rows([(3, text), (3, text), (5, text.upper()), (5, other), (None, text), (None, text), (8, None), (8, None), (9, other), (4, "w x y z")])
    out = d.stage(spark, df, "")
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == [(0, text), (0, text), (3, text), (4, "w x y z"), (5, other), (8, ""), (8, "")]


@pytest.mark.parametrize("share", [0.75, 0.9])
def test_sketches_estimate_similarity(share):
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 600
        both = rng.integers(1, 1 << 63, round(2 * n * share / (1 + share)), dtype=np.uint64)
        sets = [np.unique(np.concatenate([both, rng.integers(1, 1 << 63, n - len(both), dtype=np.uint64)])) for _ in range(2)]
        _, sketch = d.signatures(sets)
        assert int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum()) <= d.MOST_DIFFERENT


def test_a_large_bucket_of_a_common_passage(spark, shared, monkeypatch):
    """Texts that share half of their words with all others, with some real links among them."""
    monkeypatch.setattr(d, "HOT", 8)
    monkeypatch.setattr(d, "ROUNDS", 0)
    passage = " ".join(f"p{k}" for k in range(60))
    own = lambda k: [f"o{k}x{j}" for j in range(30)]
    texts = [(k, passage + " " + " ".join(own(k))) for k in range(600)]
    texts += [(1000 + k, passage + " " + " ".join(own(k)[:-4] + [f"z{k}"])) for k in range(0, 600, 50)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in d.near_duplicates(df).collect()}
    assert found == {i: i - 1000 if i >= 1000 else i for i, _ in texts}


@pytest.mark.parametrize("marks", [1 << 24, 1 << 15])
def test_a_large_bucket_around_the_threshold(rows, monkeypatch, marks):
    """Changed copies of one text, of several lengths, most pairs of which are just below or above the threshold; with a
    small bitmap, nearly all shingles count as frequent or share a mark with one that does."""
    monkeypatch.setattr(d, "HOT", 8)
    monkeypatch.setattr(d, "ROUNDS", 0)
    monkeypatch.setattr(d, "MARKS", marks)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(300):
        w = list(base)
        for j in rng.sample(range(150), rng.choice([1, 3, 4, 5, 6])):
            w[j] = f"x{k}y{j}"
        texts.append((k, " ".join(w[: rng.choice([120, 135, 150])])))
    check(d.near_duplicates(rows(texts)), texts)
