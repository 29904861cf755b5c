import numpy as np
import pytest

from siftlens.llm import quality


def test_gradients_are_slopes():
    net = quality.Network()
    texts, truth = ["some text of a kind, " * 7 + "ends", "zq"], np.array([1.0, 0.0])
    g = net.gradients(texts, truth)

    def loss():
        s = net.score(texts)
        return -np.mean(truth * np.log(s) + (1 - truth) * np.log(1 - s))

    for name, at in (("w2", (3,)), ("w1", (4, 2)), ("b1", (1,)), ("b2", (0,))):
        kept = net.p[name][at]
        net.p[name][at] = kept + 0.01
        up = loss()
        net.p[name][at] = kept - 0.01
        down = loss()
        net.p[name][at] = kept
        assert (up - down) / 0.02 == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def test_chunks_cover_everything():
    text = "".join(chr(33 + k % 90) for k in range(1500))
    chunks, counts, sizes = quality.chunked([text, "", None])
    assert counts.tolist()[1:] == [1, 1] and sizes.tolist() == [1500, 0, 0]
    seen = "".join(chr(x - 1) for row in chunks[: counts[0] - 1] for x in row[: quality.STRIDE]) + "".join(chr(x - 1) for x in chunks[counts[0] - 1] if x)
    assert seen == text


def test_held_out_ranking():
    clean = [("".join(np.random.default_rng(k).choice(list("abcdefgh  "), 300)), 1) for k in range(60)]
    junk = [("$$$ " * 60 + str(k), 0) for k in range(60)]
    net = quality.fit(clean[:40] + junk[:40], steps=60)
    assert net.score([t for t, _ in clean[40:]]).min() > net.score([t for t, _ in junk[40:]]).max()


def test_edge_cases(rows):
    df = rows([(1, None), (2, ""), (3, "a" * 300_000), (4, "x"), (4, "x"), (None, "ß𝒳")])
    found = quality.score_quality(df, quality.Network()).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert len(found) == 6 and by[1] == by[2] and by[4][0] == by[4][1] and all(0 <= r["score"] <= 1 for r in found)
    assert quality.score_quality(df.where("false"), quality.Network()).count() == 0


def test_a_sample_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.sample(documents, none, ~quality._held_out("id"), "doc_id", "text", "quality", 5) == ([], {})
    assert len(quality.fit([]).score(["x"])) == 1


def test_the_query_on_the_supplied_table(spark, data, documents):
    """Rows, held-out rows, and better held-out decisions than always the frequent label."""
    import zlib

    found = {r["doc_id"]: r for r in quality.op3_quality(spark, data).collect()}
    assert found.keys() == {r["doc_id"] for r in documents.select("doc_id").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for i, r in found.items())
    marks = [(found[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r["doc_id"] in found]
    held = [(r, q) for r, q in marks if r["held_out"] and q is not None]
    share = sum(q for _, q in held) / len(held)
    assert sum(r["predicted"] == q for r, q in held) / len(held) >= max(share, 1 - share)
    good, bad = [r["score"] for r, q in held if q], [r["score"] for r, q in held if not q]
    assert sum(g > b for g in good for b in bad) > 0.8 * len(good) * len(bad)


def test_scores_as_a_plain_convolution_gives_them():
    net, text = quality.Network(), "some text, ünd more of it " * 30
    raw = [0 if k >= len(text.encode()) else text.encode()[k] + 1 for k in range(len(text.encode()) + quality.CHUNK)]
    n = max(1, -(-(len(text.encode()) - (quality.CHUNK - quality.STRIDE)) // quality.STRIDE))
    chunks = []
    for c in range(n):
        best = np.full(quality.FILTERS, -np.inf)
        for place in range(quality.PLACES):
            at = c * quality.STRIDE + place * quality.STEP
            best = np.maximum(best, net.p["embed"][raw[at : at + quality.SEEN]].ravel() @ net.p["filters"])
        chunks.append(np.maximum(best + net.p["bias"], 0))
    features = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), [np.log1p(len(text.encode())) / 4]])
    hidden = np.tanh(features @ net.p["w1"] + net.p["b1"])
    assert net.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(hidden @ net.p["w2"] + net.p["b2"][0]))), abs=1e-5)


def test_very_long_texts_are_pooled_in_stretches(monkeypatch):
    net, text = quality.Network(), "a long text of many chunks " * 4000
    whole = net.score([text, "x"])
    monkeypatch.setattr(quality, "LONG", 7)
    assert net.score([text, "x"]) == pytest.approx(whole, abs=1e-5)
