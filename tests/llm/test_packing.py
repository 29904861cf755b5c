import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_tokenfile import library

from siftlens.llm import packing as d
from siftlens.llm.tokens import Encoder, vocabulary_path


@pytest.mark.parametrize("histogram", [{}, {1024: 5, 1000: 3, 24: 2, 12: 4}, {500: 7, 3: 1000}, {k: k * 37 % 50 for k in range(1, 1024)}, {600: 4, 212: 8}])
def test_plans_hold_every_piece_once(histogram):
    plan, seen = d.plan_packing(histogram), Counter()
    for pattern, times in plan:
        assert times > 0 and sum(pattern) <= 1024
        for n in pattern:
            seen[n] += times
    assert seen == Counter({k: v for k, v in histogram.items() if v})


def test_exact_gaps_are_filled():
    assert sorted(d.plan_packing({600: 4, 212: 8})) == [((600, 212, 212), 4)]
    assert sorted(d.plan_packing({700: 1, 200: 1, 100: 1, 24: 1})) == [((700, 200, 100, 24), 1)]
    assert d.plan_packing({512: 3}) == [((512, 512), 1), ((512,), 1)]


def check(found, texts):
    lib, sequences, pieces = library(d.VOCABULARY), {}, {}
    rows = found.collect()
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    stated = {}
    for i, t in texts:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        stated.setdefault(i, []).extend((k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in stated.items()}
    return len(sequences), sum(r["length"] for r in rows)


def test_supplied_documents(spark, shared, data, texts):
    n, tokens = check(d.op8_pack(spark, data), texts)
    assert n < 1.1 * tokens / 1024 + 2


def test_edge_cases(rows):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (4, "same"), (4, "same"), (None, "x")]
    df = rows(texts)
    check(d.pack(df, vocabulary_path(d.VOCABULARY)), texts)
    assert d.pack(df.where("false"), vocabulary_path(d.VOCABULARY)).count() == 0


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_stretches_give_the_librarys_ids(name, spaces):
    rng, lib, own = random.Random(1), library(name), Encoder(vocabulary_path(name), spaces)
    some = [" ", " ", "\0", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", ".", ",", ".\n", "_", "²", "'", "a", "B", "é", "'s", "'ll", "1", "23", "!!", "<|endoftext|>", "日本", "́", "İ", "Σ", "𝒳", " the", "\r\n"]
    for _ in range(4000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 14)))
        assert own.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_of_new_stretches_give_the_librarys_ids(name, spaces):
    """Words, punctuation and ends of lines in one stretch, many to a text; a word of the word vocabulary is not sent alone."""
    rng, lib, own = random.Random(2), library(name), Encoder(vocabulary_path(name), spaces)
    some = ["the", "Xqz", "éen", "ÀÇ", "İ", "ŉ", "ǅ", "ªº", "µ", "ß", "ſ", "ƻ", ",", ".", "!!", "'", "'s", "|", "_", "\n", "\n", "²", "7", "-", "́", "日"]
    texts = [" ".join("".join(rng.choice(some) for _ in range(rng.randint(1, 5))) for _ in range(40)) for _ in range(400)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids

    class Counted:
        sent = 0

        def encode_batch_fast(self, inputs, **kw):
            self.sent += len(inputs)
            return own.parted.encode_batch_fast(inputs, **kw)

    fresh = Encoder(vocabulary_path(name), spaces)
    fresh.library, fresh.parted = Counted(), Counted()
    fresh.encode([" ".join("x" + "".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(1000))])
    assert fresh.library.sent + fresh.parted.sent < 30
