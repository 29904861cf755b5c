import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from siftlens.llm import counting as d
from siftlens.llm.tokens import vocabulary_path


def library(pieces):
    none = ("\ue000\ue001", min(s for _, s in pieces))  # the unknown piece, which no text holds
    t = Tokenizer(models.Unigram([none, *pieces], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


@pytest.fixture(scope="module")
def pieces():
    return d.pieces_of(vocabulary_path(d.VOCABULARY))


def test_supplied_documents(spark, shared, data, texts, pieces):
    stated = {i: len(e.ids) for (i, _), e in zip(texts, library(pieces).encode_batch([t for _, t in texts]), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in d.op9_token_counts(spark, data).collect()} == stated


@pytest.mark.parametrize("seed", range(5))
def test_ties_of_small_vocabularies(seed):
    rng = random.Random(seed)
    toy = list({**{"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))): float(-rng.randint(0, 4)) for _ in range(30)}}.items())
    lib, own = library(toy), d.Counter(toy)
    for _ in range(1500):
        text = "".join(rng.choice("abbac  ") for _ in range(rng.randint(0, 12)))
        assert own.count([text])[0][0] == len(lib.encode(text).ids)


def test_edge_cases(rows, pieces):
    lib, texts = library(pieces), [(1, None), (2, ""), (3, "☃☃ x  y "), (4, "a" * 50_000), (5, "the the"), (5, "the the"), (None, "▁<s>\x00")]
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in d.count_tokens(rows(texts), pieces).collect()), key=repr)
    assert got == sorted(((i, len(lib.encode(t or "").ids)) for i, t in texts), key=repr)
    assert d.count_tokens(rows(texts).where("false"), pieces).count() == 0


def test_marks_of_the_vocabulary_are_text(pieces):
    assert not {"<s>", "</s>", "<unk>", "<0x0A>"} & {p for p, _ in pieces}
    assert d.Counter(pieces).count(["<0x0A>"])[0][0] > 1


def test_a_long_word_is_bounded(pieces):
    import tracemalloc

    counter, word = d.Counter(pieces), "abcd" * 100_000
    tracemalloc.start()
    tokens, _ = counter.best(word)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert tokens > 0 and peak < 4 * len(word) + 1e6  # the matcher holds the word itself
