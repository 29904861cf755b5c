"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A file's rows are segments: the ids of whole documents, in order, as blocks of BLOCK ids. An id is a path through the
segment's tree of ids, in which frequent ids lie near the root; each turn of the path is a binary decision. Three
predictions of it, of order 0 (how often ids of either side occur in the segment, which its head states), of order 1 and
of order 2 (how the same turn went after the last id, or the last two, in this block), are mixed: each is taken by its
logit, with weights that adapt to what has come true, a set for each confidence of the two counters. The mixed
probability drives a binary range coder. All is done in integers, so every machine gives the same bytes.

A block starts from nothing but the segment's head. It carries checksums of its bytes and its ids, so a fault is found and
stays within a block. `compress` and `expand` code the blocks of a segment in step, as lanes of numpy arrays; a lane's
model never sees another's. The query's tables are coded by TokenCoder.java, two blocks in step: the same bytes, but some
fifty times as fast. It is compiled by the compiler that Spark itself uses for its plans.

Documents are dealt by ranges of their id, so the segments in order hold them in ascending order; ties of an id are dealt
by a hash of the text. A segment has SEGMENT ids, and more where its last document is long.
"""

import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlens.llm.common import cuts_by_bytes, quoted, released, stored, table
from siftlens.llm.tokens import encoder, vocabulary_path

VOCABULARY, END = "word_bpe_49k.json", 2
#: Ids of a block, and those from which on a segment ends with its document; blocks coded in step; bytes of text encoded
#: at a time; segments whose places are broadcast at most, beyond which the join is left to the planner.
BLOCK, SEGMENT, LANES, PASS_BYTES, MOST_PLACES = 4096, 1 << 22, 1024, 1 << 22, 1_000_000
MAGIC = b"SLT2"

#: Bits of a lane's table of counters for each order; the most a counter counts; bits of a probability.
_SLOT_BITS, _MOST_SEEN, _P = 14, 12, 12
_RATE = 10
_P32, _LOW32, _FRESH, _MIX, _TOP_SLOT = np.uint32(_P), np.uint32(4095), np.uint16(0xFFF0), np.uint32(0x85EBCA6B), np.uint32(32 - _SLOT_BITS)
#: Sixteenths of powers of two by eighths, so that frequencies are stated in one byte each.
_EIGHTHS = [16, 17, 19, 21, 23, 25, 27, 29]


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """By state (probability and count of a counter): logit, class of confidence, and the next state for either turn; by
    logit: probability."""
    logit = np.array([0, *(max(-2047, min(2047, round(256 * log(p / (4096 - p))))) for p in range(1, 4096))], np.int32)
    squash = np.array([max(1, min(4095, round(4096 / (1 + exp(-x / 256))))) for x in range(-2047, 2048)], np.uint32)
    p, n = np.divmod(np.arange(1 << 16), 16)
    rate = np.array([round(65536 / (k + 1.6)) for k in range(16)])[n]
    after = np.stack([p + (((turn * 4095 - p) * rate + (1 << 15)) >> 16) for turn in (0, 1)], axis=1)
    after = np.clip(after, 1, 4095) << 4 | np.minimum(n + 1, _MOST_SEEN)[:, None]
    sure = np.array([0, 1, 1, 2, 2, 2, *[3] * 10])[n]
    return logit[p], sure.astype(np.int64), np.ascontiguousarray(after.astype(np.uint16).T), squash


class _Tree:
    """Ids as leaves by their stated weights, rare ones deep. Turns are numbered from the root, 0."""

    def __init__(self, weights: np.ndarray):
        n = self.n = len(weights)
        order = np.argsort(weights, kind="stable").tolist()
        leaf, inner = [(int(weights[k]), ~k) for k in order], []  # leaves are below zero
        at, made, sides, total = 0, 0, [], []
        for _ in range(n - 1):
            two = []
            for _ in range(2):
                if at < n and (made == len(inner) or leaf[at][0] <= inner[made][0]):
                    two.append(leaf[at])
                    at += 1
                else:
                    two.append(inner[made])
                    made += 1
            inner.append((two[0][0] + two[1][0], len(sides)))
            sides.append((two[0][1], two[1][1]))
            total.append((two[1][0], inner[-1][0]))
        # The last one made is the root.
        turn = np.array(sides, np.int64).reshape(-1, 2)[::-1]
        self.next = np.ascontiguousarray(np.where(turn < 0, turn, n - 2 - turn)).ravel()
        share = np.array(total, np.float64).reshape(-1, 2)[::-1]
        p = np.clip(share[:, 0] * 4096 // np.maximum(share[:, 1], 1), 1, 4095).astype(np.int64)
        self.first = (p << 4).astype(np.uint16)
        self.logit = _tables()[0][self.first]
        self.mark = np.arange(max(1, n - 1), dtype=np.uint32) * np.uint32(0x9E3779B1)
        # The way to each leaf, a level of all ways at a time.
        self.code, self.depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
        nodes, codes, depth = np.zeros(int(n > 1), np.int64), np.zeros(int(n > 1), np.int64), 0
        while len(nodes):
            nodes = np.concatenate([self.next[2 * nodes], self.next[2 * nodes + 1]])
            codes, depth = np.concatenate([codes << 1, codes << 1 | 1]), depth + 1
            ends = nodes < 0
            self.code[~nodes[ends]], self.depth[~nodes[ends]] = codes[ends], depth
            nodes, codes = nodes[~ends], codes[~ends]


class _Lanes:
    """The models and range coders of blocks that are still open."""

    def __init__(self, tree: _Tree, sizes: np.ndarray):
        n = len(sizes)
        self.tree, self.lane, self.left = tree, np.arange(n), sizes.copy()
        self.counters = [np.zeros(n << _SLOT_BITS, np.uint16) for _ in range(2)]
        self.weights = [np.full(n * 16, w, np.int32) for w in (20_000, 26_000, 32_000)]
        self.node, self.one, self.two = np.zeros(n, np.int64), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.past = [np.zeros(n, np.uint32) for _ in range(2)]
        self.low, self.high = np.zeros(n, np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
        self._based()

    def _based(self) -> None:
        self.base, self.sets = self.lane << _SLOT_BITS, self.lane << 4

    def predict(self) -> np.ndarray:
        """Where each lane's range is to be split: up to it the turn is 1."""
        logit, sure, _, squash = _tables()
        tree, node = self.tree, self.node
        turn = tree.mark.take(node)
        self.at = [self._slot(turn ^ h) for h in self.past]
        first, one, two = tree.first.take(node), self.counters[0].take(self.at[0]), self.counters[1].take(self.at[1])
        np.copyto(one, first, where=one == 0)
        np.copyto(two, one & _FRESH, where=two == 0)
        self.state = one, two
        self.set = sure.take(one)
        self.set *= 4
        self.set += sure.take(two)
        self.set += self.sets
        self.put = tree.logit.take(node), logit.take(one), logit.take(two)
        self.own = [w.take(self.set) for w in self.weights]
        mixed = self.own[0] * self.put[0]
        mixed += self.own[1] * self.put[1]
        mixed += self.own[2] * self.put[2]
        mixed >>= 16
        np.maximum(mixed, -2047, out=mixed)
        np.minimum(mixed, 2047, out=mixed)
        mixed += 2047
        self.p = squash.take(mixed)
        span = self.high - self.low
        split = (span >> _P32) * self.p
        span &= _LOW32
        span *= self.p
        span >>= _P32
        split += span
        split += self.low
        return split

    def _slot(self, h: np.ndarray) -> np.ndarray:
        h *= _MIX
        h >>= _TOP_SLOT
        return self.base + h

    def learn(self, bit: np.ndarray, split: np.ndarray) -> np.ndarray:
        """Take the turns (0 or 1); gives the places of lanes that have come to a leaf."""
        after = _tables()[2]
        turn = bit.view(bool)
        np.copyto(self.high, split, where=turn)
        split += np.uint32(1)
        np.copyto(self.low, split, where=~turn)
        wrong = bit.astype(np.int32)
        wrong <<= _P
        wrong -= self.p.view(np.int32)
        wrong *= _RATE
        for w, own, put in zip(self.weights, self.own, self.put, strict=True):
            put *= wrong
            put += 1 << 13
            put >>= 14
            own += put
            w[self.set] = own
        for counters, at, state in zip(self.counters, self.at, self.state, strict=True):
            counters[at] = np.where(turn, after[1].take(state), after[0].take(state))
        self.node *= 2
        self.node += bit
        self.node = self.tree.next.take(self.node)
        return np.flatnonzero(self.node < 0)

    def settle(self, ends: np.ndarray) -> np.ndarray:
        """Lanes at a leaf begin their next id; gives the leaves."""
        leaf = ~self.node[ends]
        self.node[ends] = 0
        self.two[ends] = self.one[ends]
        self.one[ends] = leaf.astype(np.uint32) + np.uint32(1)
        h = self.one[ends] * np.uint32(0xC2B2AE35)
        self.past[0][ends] = h ^ (h >> np.uint32(15))
        h = (h + self.two[ends]) * np.uint32(0x27D4EB2F) + np.uint32(1)
        self.past[1][ends] = h ^ (h >> np.uint32(13))
        self.left[ends] -= 1
        return leaf

    def keep(self, open_: np.ndarray) -> None:
        for name in ("lane", "left", "node", "one", "two", "low", "high"):
            setattr(self, name, getattr(self, name)[open_])
        self.past = [h[open_] for h in self.past]
        self._based()


def _settled(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Lanes whose next byte is certain."""
    return np.flatnonzero((low ^ high) < np.uint32(1 << 24))


def _stated(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The distinct ids of a segment, and how the head states them and their frequencies: a byte of an eighth of a power
    of two each."""
    if len(ids) and ids.max() < 1 << 20:
        known = np.flatnonzero(counts := np.bincount(ids)).astype("<u4")
        counts = counts[known]
    else:
        known, counts = np.unique(ids, return_counts=True)
    weight = np.array([_EIGHTHS[k % 8] << (k // 8) for k in range(8 * 40)], np.int64)
    steps = np.clip(np.searchsorted(weight, counts * 16, side="right") - 1, 0, 255).astype(np.uint8)
    return known, zlib.compress(np.diff(known.astype("<u4"), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + steps.tobytes(), 6)


def _known(head: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(head)
    n = len(raw) // 5
    gaps = np.ascontiguousarray(np.frombuffer(raw[: 4 * n], np.uint8).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint32), np.array([_EIGHTHS[k % 8] << (k // 8) for k in raw[4 * n :]], np.int64)


def _encoded(tree: _Tree, symbols: np.ndarray) -> list[bytes]:
    """The blocks of some symbols, as lanes."""
    sizes = _sizes(len(symbols))
    out, size = np.zeros((len(sizes), 2 * BLOCK), np.uint8), np.zeros(len(sizes), np.int64)
    lanes, begin = _Lanes(tree, sizes), np.arange(len(sizes)) * BLOCK
    code, depth = tree.code[symbols], tree.depth[symbols]
    own, left, step = code[begin], depth[begin], 0
    while len(lanes.lane):
        if step % 256 == 0 and size.max() + 1100 > out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], axis=1)
        step += 1
        split = lanes.predict()
        left -= 1
        ends = lanes.learn(((own >> left) & 1).astype(np.uint8), split)
        sure = _settled(lanes.low, lanes.high)
        while len(sure):
            to, low, high = lanes.lane[sure], lanes.low[sure], lanes.high[sure]
            out[to, size[to]] = low >> np.uint32(24)
            size[to] += 1
            lanes.low[sure], lanes.high[sure] = (low := low << np.uint32(8)), (high := high << np.uint32(8) | np.uint32(255))
            sure = sure[(low ^ high) < np.uint32(1 << 24)]
        if len(ends):
            lanes.settle(ends)
            at = begin[lanes.lane[ends]] + sizes[lanes.lane[ends]] - lanes.left[ends]
            more = lanes.left[ends] > 0
            own[ends[more]], left[ends[more]] = code[at[more]], depth[at[more]]
            if not more.all():
                done = ends[~more]
                for k in range(4):
                    out[lanes.lane[done], size[lanes.lane[done]] + k] = (lanes.low[done] >> np.uint32(24 - 8 * k)) & np.uint32(255)
                size[lanes.lane[done]] += 4
                open_ = np.flatnonzero(lanes.left > 0)
                lanes.keep(open_)
                own, left = own[open_], left[open_]
    return [row[:n].tobytes() for row, n in zip(out, size.tolist(), strict=True)]


def _decoded(tree: _Tree, blocks: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The symbols of some blocks, which are whole but for the last."""
    symbols, begin = np.zeros(int(sizes.sum()), np.int64), np.arange(len(blocks)) * BLOCK
    ends_at = np.cumsum([len(b) for b in blocks])
    raw, at, stop = np.frombuffer(b"".join(blocks) + bytes(8), np.uint8), ends_at - [len(b) for b in blocks], ends_at
    lanes, said = _Lanes(tree, sizes), np.zeros(len(blocks), np.uint32)
    for k in range(4):
        said = said << np.uint32(8) | raw[at + k]
    at += 4
    while len(lanes.lane):
        split = lanes.predict()
        ends = lanes.learn((said <= split).view(np.uint8), split)
        sure = _settled(lanes.low, lanes.high)
        while len(sure):
            to, low, high = lanes.lane[sure], lanes.low[sure], lanes.high[sure]
            said[sure] = said[sure] << np.uint32(8) | np.where(at[to] < stop[to], raw[np.minimum(at[to], len(raw) - 1)], 0)
            at[to] += 1
            lanes.low[sure], lanes.high[sure] = (low := low << np.uint32(8)), (high := high << np.uint32(8) | np.uint32(255))
            sure = sure[(low ^ high) < np.uint32(1 << 24)]
        if len(ends):
            place = begin[lanes.lane[ends]] + sizes[lanes.lane[ends]] - lanes.left[ends]
            symbols[place] = lanes.settle(ends)
            if not lanes.left[ends].all():
                open_ = np.flatnonzero(lanes.left > 0)
                lanes.keep(open_)
                said = said[open_]
    return symbols


def _sizes(total: int) -> np.ndarray:
    """How many of a number of ids each block has."""
    return np.minimum(BLOCK, total - BLOCK * np.arange(-(-total // BLOCK)))


def compress(ids: np.ndarray) -> bytes:
    """A segment of ids: magic, number of ids, a block's ids, number of blocks, bytes of the head; the head; for each block
    its bytes' number and two checksums; the blocks. At most LANES blocks are coded at a time."""
    ids = ids.astype("<u4")
    known, head = _stated(ids)
    tree = _Tree(_known(head)[1])
    some = [ids[a : a + LANES * BLOCK] for a in range(0, len(ids), LANES * BLOCK)]
    blocks = [b for part in some for b in (_encoded(tree, np.searchsorted(known, part)) if tree.n > 1 else [b""] * len(_sizes(len(part))))]
    heads = [struct.pack("<III", len(b), zlib.crc32(b), zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes())) for k, b in enumerate(blocks)]
    return MAGIC + struct.pack("<QIII", len(ids), BLOCK, len(blocks), len(head)) + head + b"".join(heads) + b"".join(blocks)


def expand(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError where a checksum fails."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    total, block, n_blocks, n_head = struct.unpack_from("<QIII", data, 4)
    if block != BLOCK:
        raise ValueError("blocks of another size")
    try:
        known, weights = _known(data[24 : 24 + n_head])
    except zlib.error as e:
        raise ValueError("the head is damaged") from e
    heads = [struct.unpack_from("<III", data, 24 + n_head + 12 * k) for k in range(n_blocks)]
    at, blocks = 24 + n_head + 12 * n_blocks, []
    for k, (n, crc, _) in enumerate(heads):
        blocks.append(data[at : at + n])
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError(f"block {k} is damaged")
        at += n
    tree, sizes, out = _Tree(weights), _sizes(total), [np.zeros(0, "<u4")]
    for a in range(0, n_blocks, LANES):
        own = sizes[a : a + LANES]
        symbols = _decoded(tree, blocks[a : a + LANES], own) if tree.n > 1 else np.zeros(int(own.sum()), np.int64)
        out.append(known[symbols].astype("<u4"))
    ids = np.concatenate(out)
    for k, (_, _, crc) in enumerate(heads):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) != crc:
            raise ValueError(f"block {k} does not give its ids")
    return ids


_jars: dict[str, dict] = {}


def _coder(spark: SparkSession) -> dict:
    """The classes of TokenCoder.java, compiled once for an application, and at hand on its executors."""
    app = spark.sparkContext.applicationId
    if app not in _jars:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(Path(__file__).with_name("TokenCoder.java").read_text())
        path = Path(tempfile.mkdtemp(prefix="siftlens-code-")) / "siftlens_coder.jar"
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(str(path))
        made = spark.sparkContext._gateway.new_array
        java = spark._jvm.java.lang
        own = {n: compiler.getClassLoader().loadClass(f"siftlens.TokenCoder${n}").getDeclaredConstructor(made(java.Class, 0)).newInstance(made(java.Object, 0)) for n in ("Writing", "Reading")}
        _jars[app] = own
    return _jars[app]


def _coded(spark: SparkSession, name: str, kind: T.DataType, *columns: str):
    """Writing or Reading of columns."""
    own = f"siftlens_token_{name.lower()}"
    spark._jsparkSession.udf().register(own, _coder(spark)[name], spark._jsparkSession.parseDataType(kind.json()))
    return F.call_function(own, *map(F.col, columns))


def _writing(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part, segment = encoder(path, False), TaskContext.get().partitionId(), 0
        held, ids, sizes, total = [], [], [], 0

        def listed(x: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

        def row() -> pa.RecordBatch:
            own = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([total], pa.int64()), listed(pa.concat_arrays(ids)), listed(pa.array(np.concatenate(sizes), pa.int32())), pa.array([own.tobytes()], pa.binary()), pa.array([_stated(own)[1]], pa.binary())],
                names=["part", "segment", "n_tokens", "ids", "sizes", "tokens", "head"],
            )

        for batch in batches:
            for a, b in cuts_by_bytes(batch.column("text"), PASS_BYTES, 1 << 14):
                some = batch.slice(a, b - a)
                new, counts = tokens.encode_array(some.column("text"))
                ends = np.cumsum(counts + 1) - 1
                ended = np.full(len(new) + len(counts), end, "<u4")
                own = np.ones(len(ended), bool)
                own[ends] = False
                ended[own] = new
                held.append(ended)
                ids.append(some.column("id"))
                sizes.append(counts + 1)
                total += len(ended)
                if total >= SEGMENT:
                    yield row()
                    segment, held, ids, sizes, total = segment + 1, [], [], [], 0
        if held:
            yield row()

    return released(run)


def write_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, parts: int | None = None) -> DataFrame:
    """The segments of all rows, in ascending order of id (null first): part, segment, n_tokens, ids, sizes, data. To be
    written as files, whose rows are segments.

    A null or empty text is the end id alone. Repeated rows are written each; rows that share an id follow each other in
    an order given by their texts' hashes. An empty table has no segments. Other columns are not read."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    fields = [T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.BinaryType()), T.StructField("head", T.BinaryType())]
    plain = rows.mapInArrow(_writing(vocabulary, end), T.StructType(fields))
    return plain.select("part", "segment", "n_tokens", "ids", "sizes", _coded(docs.sparkSession, "Writing", T.BinaryType(), "tokens", "head").alias("data"))


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            at, sizes = batch.column("before")[k].as_py(), batch.column("sizes")[k].values.to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(at + ends - sizes), pa.array(sizes), batch.column("crc")[k].values], names=["id", "start", "n_tokens", "ids_crc32"])


def read_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each file
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in sizes):
        before.append((part, total))
        total += n
    shifts = files.sparkSession.createDataFrame(before, "part int, shift long")
    order = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("part", "segment", "n_tokens").join(shifts, "part")
    places = places.select("part", "segment", (F.col("shift") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).alias("before"))
    kind = files.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    places = stored(places, "places")
    whole = files.join(F.broadcast(places) if places.count() <= MOST_PLACES else places, ["part", "segment"])
    whole = whole.select("before", "ids", "sizes", _coded(files.sparkSession, "Reading", T.ArrayType(T.LongType()), "data", "sizes").alias("crc"))
    return whole.mapInArrow(released(_reading), out).withColumnRenamed("id", id_col)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(stored(write_ids(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY)), "token_ids"))
