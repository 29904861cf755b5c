import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftlens.llm import tokenfile as d
from siftlens.llm.common import stored
from siftlens.llm.tokens import vocabulary_path


def library(name):
    return Tokenizer.from_file(vocabulary_path(name))


def check(found, texts):
    lib, at, stated = library(d.VOCABULARY), 0, []
    for i, t in texts:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        stated.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == stated


@pytest.mark.parametrize("ids", [[], [5], [7] * 5000, [1, 2, 3, 40000] * 3000, [1 << 31, 5], "uniform", "skewed"])
def test_round_trip(ids):
    rng = np.random.default_rng(0)
    ids = np.array({"uniform": rng.integers(0, 65536, 9000), "skewed": rng.zipf(1.3, 30000) % 49408}.get(ids, ids) if isinstance(ids, str) else ids, "<u4")
    data = d.compress(ids)
    assert (d.expand(data) == ids).all() and len(d.expand(data)) == len(ids)


def test_what_repeats_is_small():
    assert len(d.compress(np.tile(np.arange(20, dtype="<u4"), 1500))) < 8_000


def test_faults_are_found():
    data = bytearray(d.compress(np.arange(5000, dtype="<u4") % 700))
    data[-5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        d.expand(bytes(data))
    with pytest.raises(ValueError, match="not a segment"):
        d.expand(b"junk" + bytes(20))


def test_blocks_are_independent_and_lanes_bounded(monkeypatch):
    """The same bytes whatever is coded in step, and a block's bytes alone give its ids."""
    ids = (np.random.default_rng(1).zipf(1.4, 30_000) % 5000).astype("<u4")
    data = d.compress(ids)
    monkeypatch.setattr(d, "LANES", 3)
    assert d.compress(ids) == data and (d.expand(data) == ids).all()


def test_fewer_bits_than_order_0(texts):
    """Against the entropy of the ids of all supplied documents, and against zlib on the same blocks."""
    from siftlens.llm.tokens import Encoder

    ids = np.concatenate([np.append(x, 2) for x in Encoder(vocabulary_path(d.VOCABULARY), False).encode([t for _, t in texts])]).astype("<u4")
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = 8 * len(d.compress(ids)) / len(ids)
    packed = sum(len(zlib.compress(ids[k : k + d.BLOCK].astype("<u2").tobytes(), 9)) for k in range(0, len(ids), d.BLOCK))
    assert bits < -(share * np.log2(share)).sum() and bits < 0.85 * 8 * packed / len(ids)


def test_supplied_documents(spark, shared, data, texts):
    check(d.op7_token_file(spark, data), texts)


def test_edge_cases(rows):
    texts = [(None, "x"), (1, None), (2, ""), (3, "Hello <|endoftext|> World's"), (3, "Hello <|endoftext|> World's"), (4, "ab́c 1²! \x1c\x85 " * 3000)]
    path = vocabulary_path(d.VOCABULARY)
    check(d.read_ids(stored(d.write_ids(rows(texts), path, parts=3), "ids")), texts)
    assert d.read_ids(stored(d.write_ids(rows(texts).where("false"), path), "ids")).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [7] * 5000, [1 << 31, 5, 5], "skewed"])
def test_the_jvms_coder_gives_the_same_bytes(spark, ids):
    rng = np.random.default_rng(2)
    ids = np.array(rng.zipf(1.3, 30000) % 49408 if isinstance(ids, str) else ids, "<u4")
    coder, data = d._coder(spark), d.compress(ids)
    assert bytes(coder["Writing"].call(bytearray(ids.tobytes()), bytearray(d._stated(ids)[1]))) == data
    half = len(ids) // 2
    df = spark.createDataFrame([(bytearray(data), [half, len(ids) - half])], "data binary, sizes array<int>")
    found = df.select(d._coded(spark, "Reading", d.T.ArrayType(d.T.LongType()), "data", "sizes")).first()[0]
    assert found == [zlib.crc32(ids[:half].tobytes()), zlib.crc32(ids[half:].tobytes())]


def test_a_query_does_not_code_in_python(spark, shared, data, monkeypatch):
    """A million ids are written and read in seconds; in Python that takes ten."""
    import time

    ids = (np.random.default_rng(3).zipf(1.3, 1 << 20) % 49408).astype("<u4")
    coder, head = d._coder(spark), d._stated(ids)[1]
    coder["Writing"].call(bytearray(ids[:9000].tobytes()), bytearray(d._stated(ids[:9000])[1]))
    df = spark.createDataFrame([(bytearray(ids.tobytes()), bytearray(head))], "tokens binary, head binary").cache()
    df.count()
    began = time.perf_counter()
    data = df.select(d._coded(spark, "Writing", d.T.BinaryType(), "tokens", "head")).first()[0]
    assert time.perf_counter() - began < 5 and (len(data) < 3 * len(ids))
    damaged = bytearray(data)
    damaged[-5] ^= 1
    with pytest.raises(Exception, match="damaged"):
        spark.createDataFrame([(damaged, [1 << 20])], "data binary, sizes array<int>").select(d._coded(spark, "Reading", d.T.ArrayType(d.T.LongType()), "data", "sizes")).collect()


def test_arrays_of_texts_are_encoded_as_the_library_does():
    """Slices, nulls, letters that are composed with what follows, marks at stretches' ends, special tokens in either case."""
    import pyarrow as pa

    from siftlens.llm.tokens import Encoder

    odd = ["the", "The", "END.", "cat,", "a.'s", "it's.", "3,", 'x".', ",", ".", "H̱", "J̌", "Å.", "İa,", "İ", "́", "é.", "ΣΑΣ.", "中.", " ", "\t", "\r", "\n", " ", "", "<|endoftext|>", "<|EndOfText|>", "K,", "don't,", "|", "#", "\U0001f600."]
    rng = np.random.default_rng(5)
    texts = [None, "", "a", "b.", " ", "\n", ", x", *("".join(w + s for w, s in zip(rng.choice(odd, k), rng.choice([" ", "\n", "", "  "], k), strict=True)) for k in rng.integers(1, 30, 3000))]
    lib, tokens = library(d.VOCABULARY), Encoder(vocabulary_path(d.VOCABULARY), False, 2000)
    for a, b in ((0, 0), (0, 2), (1, 900), (900, 907), (907, len(texts))):
        ids, counts = tokens.encode_array(pa.array(texts, pa.string()).slice(a, b - a))
        stated = [lib.encode(t or "", add_special_tokens=False).ids for t in texts[a:b]]
        assert counts.tolist() == list(map(len, stated)) and ids.tolist() == [x for some in stated for x in some]


def test_a_stretch_is_looked_up_once_an_array():
    """Not once for each place: that took most of Python's time."""
    import pyarrow as pa

    from siftlens.llm.tokens import Encoder

    class Counted(dict):
        gets = 0

        def get(self, *key):
            Counted.gets += 1
            return super().get(*key)

    tokens = Encoder(vocabulary_path(d.VOCABULARY), False)
    tokens.known = Counted()
    ids, counts = tokens.encode_array(pa.array(["The cat, the dog.\nthe cat"] * 1000, pa.string()))
    assert len(ids) == 8000 and set(counts.tolist()) == {8} and Counted.gets < 20


@pytest.mark.parametrize("n", [1, 4096, 4097, 8192, 12289, 20480])
def test_the_jvm_codes_blocks_in_step(spark, n):
    """Two at a time, of unlike lengths: the same bytes as in Python, and read again."""
    rng = np.random.default_rng(n)
    ids = np.where(np.arange(n) // 4096 % 2 == 0, rng.zipf(3.0, n) % 50, rng.integers(0, 3000, n)).astype("<u4")
    coder, data = d._coder(spark), d.compress(ids)
    assert bytes(coder["Writing"].call(bytearray(ids.tobytes()), bytearray(d._stated(ids)[1]))) == data
    found = spark.createDataFrame([(bytearray(data), [n])], "data binary, sizes array<int>").select(d._coded(spark, "Reading", d.T.ArrayType(d.T.LongType()), "data", "sizes")).first()[0]
    assert found == [zlib.crc32(ids.tobytes())]
