import itertools

import numpy as np
import pytest

from siftlens.llm import langid


@pytest.fixture(scope="module")
def field(documents):
    return langid._fitted(documents)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    scores, steps = rng.normal(size=(7, 3)).astype("f4"), rng.normal(size=(3, 3)).astype("f4")

    def plain(s):
        out = np.zeros(s.shape)
        for path in itertools.product(range(3), repeat=len(s)):
            w = np.exp(sum(s[i, k] for i, k in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, k in enumerate(path):
                out[i, k] += w
        return out / out.sum(1, keepdims=True)

    got = langid.forward_backward(scores, np.array([2, 0, 4, 1]), steps)
    assert np.allclose(got, np.concatenate([plain(scores[:2]), plain(scores[2:6]), plain(scores[6:])]), atol=1e-5)


def test_held_out_accuracy(spark, documents, data):
    found = langid.op2_langid(spark, data).join(documents.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 50").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_rows_and_letters(spark, data, documents):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = langid.op2_langid(spark, data).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))


def test_short_rows_teach():
    """Languages of three-word rows only."""
    field = langid.fit([(lang, text) for lang, text in (("a", "the old house"), ("b", "das alte haus")) for _ in range(20)])
    assert [x[0] for x in field.label(["old house", "das haus", "x", "12"])][:2] == ["a", "b"]
    assert [x[0] == "und" for x in field.label(["old house", "das haus", "x", "12"])] == [False, False, False, True]


def test_labels_as_a_plain_form_gives_them(field):
    """One word at a time: features summed, then forward-backward over all paths."""
    text = "the thing and das haus"
    words = langid.Words(text, field.lexicon)
    slots, sizes = words.flat()
    scores = np.array([field.weights[s].sum(axis=0) for s in np.split(slots, np.cumsum(sizes)[:-1])])
    total = np.zeros_like(scores, dtype=float)
    for path in itertools.product(range(len(field.langs)), repeat=len(scores)):
        w = np.exp(sum(float(scores[i, k]) for i, k in enumerate(path)) + sum(float(field.steps[a, b]) for a, b in zip(path, path[1:], strict=False)))
        for i, k in enumerate(path):
            total[i, k] += w
    means = (total / total.sum(axis=1, keepdims=True)).mean(axis=0)
    (lang, score, n, _, _), = field.label([text])
    assert n == 5 and lang == field.langs[int(means.argmax())] and abs(score - means.max()) < 1e-4


def test_words_of_a_switching_text(field):
    (lang, score, words, switches, _), *_ = field.label(["the thing of and that was with for " * 5 + "der die und ist nicht schung keit zu " * 5])
    assert words == 80 and switches >= 1 and score < 0.9 and lang in field.langs


def test_edge_cases(rows, field):
    df = rows([(1, None), (2, ""), (3, "12 !?"), (4, "the"), (4, "the"), (None, "the"), (5, "the thing " * 30_000)])
    found = sorted(((r["doc_id"] or 0), r["lang_pred"], r["n_words"]) for r in langid.identify(df, field).collect())
    assert found[1:4] == [(1, "und", 0), (2, "und", 0), (3, "und", 0)]
    assert found[4] == found[5] and found[4][2] == 1 and found[6][2] == 60_000
    assert langid.identify(df.where("false"), field).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit([])).collect()} == {"und"}


def test_pieces_end_between_words():
    text = "ab cd " * 9
    pieces = list(langid._pieces(text, 7))
    assert "".join(pieces) == text and len(pieces) > 5
    assert not any(a[-1].isalpha() and b[:1].isalpha() for a, b in zip(pieces, pieces[1:], strict=False))


def test_stage_keeps_switching_texts(spark, documents, data, field):
    """An even mixture of all languages has no large share."""
    some = {}
    for r in documents.where("lang is not null and n_chars > 400").orderBy("doc_id").collect():
        some.setdefault(r["lang"], r["text"])
    mixed = " ".join(" ".join(t.split()[:30]) for t in some.values())
    more = spark.createDataFrame([(10**9, mixed, None, "s", len(mixed)), (10**9 + 1, "12 34", None, "s", 5)], documents.schema)
    found = langid.identify(more, field).where(f"doc_id = {10**9}").first()
    assert found["lang_pred"] != langid.UNDETERMINED and found["score"] < 0.35
    assert [r["doc_id"] for r in langid.stage(spark, documents.union(more), data).where(f"doc_id >= {10**9}").collect()] == [10**9]


def test_stage_keeps_all_where_nothing_could_be_fitted(spark, documents, data):
    df = documents.limit(20).selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    assert langid.stage(spark, df, data).count() == df.count()
