import re

from conftest import lowered

from siftlens.llm import licenses as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    w = WORD.findall(lowered(text))
    places = [(k, label) for phrase, label in d.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(found, texts):
    rows = found.collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in texts), key=repr)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in rows)


def test_supplied_documents(spark, shared, data, texts):
    check(d.op6_licenses(spark, data), texts)


def test_edge_cases(rows):
    texts = [(1, None), (1, "mit license MIT-License apache license"), (1, "mit license MIT-License apache license"), (None, "cc by cc by"), (2, ""), (3, "mit"), (6, "ééé ßß É"), (7, "apache license " * 20_000)]
    texts += [(4, "Kelvin Knu general public license GNU General, Public\nLicense mitİ license")]
    check(d.digest(d.scan_licenses(rows(texts))), texts)
    assert d.scan_licenses(rows(texts).where("false")).count() == 0


def test_notices_with_words_left_out_and_put_in(rows):
    text = "Permission is hereby granted, free of charge, to any person x obtaining a copy of this software and documentation files"
    found = {r["doc_id"]: r for r in d.digest(d.scan_licenses(rows([(1, text), (2, "free of charge to any person")]))).collect()}
    assert found[1]["labels"] == "mit" and 0.6 <= found[1]["score"] < 1 and found[1]["n_base"] == 0
    assert found[2]["labels"] == "" and found[2]["score"] == 0


def test_spans_are_verified_in_order(rows):
    """The words of a notice in another order, though on near diagonals, are no notice; long and one-word templates work."""
    long_ = [f"w{k}" for k in range(400)]
    swapped = [w for k in range(0, 400, 4) for w in (long_[k + 2], long_[k + 3], long_[k], long_[k + 1])]
    texts = [(1, "x " + " ".join(long_[:150] + long_[152:]) + " y"), (2, " ".join(swapped)), (3, "solo flight"), (4, " ".join(reversed(long_)))]
    found = {r["doc_id"]: r for r in d.scan_licenses(rows(texts), notices=[(" ".join(long_), "long")]).collect()}
    assert [(n["start"], n["end"]) for n in found[1]["notices"]] == [(1, 399)] and found[1]["score"] == (399 - 3) / 399
    assert not found[2]["notices"] and not found[4]["notices"]
    one = {r["doc_id"]: r for r in d.scan_licenses(rows(texts), phrases=[("solo", "s"), ("w3 w0", "p")], notices=[(" ".join(long_), "long")]).collect()}
    assert [tuple(p) for p in one[3]["places"]] == [(0, "s")] and [tuple(p) for p in one[2]["places"]] == [(1, "p")] and one[1]["notices"]
