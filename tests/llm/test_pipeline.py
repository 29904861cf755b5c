"""The pipeline's stages, each on what its predecessor kept."""

import corpus_pipeline
from test_packing import check

from siftlens.llm import decontaminate, neardup, secrets
from siftlens.llm.common import stored


def test_stages(spark, shared, data, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, data), name)
        assert out.columns == documents.columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert after.keys() <= before.keys()
        kept[name] = before, after
        docs = out
    before, after = kept["language_id"]
    assert all(any(c.isalpha() for c in t) for t in after.values()) and len(after) > 0.95 * len(before)
    before, after = kept["near_dedup"]
    texts = spark.createDataFrame(list(before.items()), "doc_id long, text string")
    assert after.keys() == {r["doc_id"] for r in neardup.near_duplicates(texts).collect() if r["kept"]}
    before, after = kept["decontaminate"]
    texts = spark.createDataFrame(list(before.items()), "doc_id long, text string")
    found = decontaminate.digest(decontaminate.decontaminate(texts, spark.read.parquet(f"{data}/benchmark.parquet"))).collect()
    assert after == {k: before[k] for k in (r["doc_id"] for r in found if not r["contaminated"])}
    before, after = kept["secrets"]
    assert before.keys() == after.keys()
    texts = spark.createDataFrame(list(after.items()), "doc_id long, text string")
    assert {r["n_access"] + r["n_hex"] for r in secrets.digest(secrets.scan_secrets(texts)).collect()} == {0}
    check(corpus_pipeline.STAGES[-1][1](spark, docs, data), sorted(after.items()))


def test_run(spark, shared, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_lost_words_are_kept_true(spark, shared, documents, data):
    docs = spark.createDataFrame([(1, "password=abcdefgh", "en", "s", 17), (2, "clean", "en", "s", 99)], documents.schema)
    out = {r["doc_id"]: r for r in secrets.stage(spark, docs, data).collect()}
    assert out[1]["n_chars"] == len(out[1]["text"]) == 8 and out[2]["n_chars"] == 99


def test_stages_with_odd_rows(spark, shared, data):
    """Column names with dots and clashes, ids that repeat or are null, one id with two texts, null and empty texts."""
    words = " ".join(f"wort{k}" for k in range(40))
    rows = [(1, words, "de"), (2, words, "de"), (3, None, None), (4, "", "de"), (5, words, "en"), (5, "quite another text of some words here", "en"), (6, "same row twice over", "en"), (6, "same row twice over", "en"), (None, "no id at all", "en"), (7, "12 34", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1.0, "x", 3) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, `a.b` double, row string, `c0` int")
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: sorted(((r["doc_id"], r["text"], r["a.b"]) for r in stages[name](spark, docs, data).collect()), key=repr) for name in list(stages)[:-1]}
    every = sorted(((i, t, 1.0) for i, t, _ in rows), key=repr)
    assert kept["language_id"] == [r for r in every if any(c.isalpha() for c in r[1] or "")]
    assert kept["decontaminate"] == kept["secrets"] == every
    gone = [(2, words, 1.0), (5, words, 1.0), (6, "same row twice over", 1.0)]
    assert sorted(kept["near_dedup"] + gone, key=repr) == every
    assert all(stages[name](spark, docs, data).columns == docs.columns for name in list(stages)[:-1])
    assert sorted(r["doc_id"] or 0 for r in stages["packing"](spark, docs, data).collect()) == sorted(i or 0 for i, _, _ in rows)
    for name, stage in stages.items():
        assert stage(spark, docs.where("false"), data).count() == 0, name
