"""Benchmark decontamination by an FM-index over each shard of the training documents.

A shard is a bounded run of documents of one partition. Its words become integer symbols; words that no
benchmark phrase holds act as separators, as no phrase can reach across them. Over that sequence an FM-index is
built: suffix array, Burrows-Wheeler transform in a wavelet matrix with popcount ranks, and sampled suffix
positions. All phrases of the benchmark are searched backwards at once; occurrences are located by walking to a
sampled position, and merged into removal spans.

Documents never move: each partition makes its own indexes, so there is no shuffle. The benchmark reaches the
executors in blocks of about BLOCK_BYTES of text, whose windows are held once a worker, in arrays; a larger benchmark
takes more passes over the rows.
"""

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlens.llm.common import cuts_by_bytes, quoted, released, table, text_of, unpacked, whole

#: Words of one window, benchmark text of one pass, bytes of documents in one shard, distance of sampled suffixes.
WINDOW, BLOCK_BYTES, SHARD_BYTES, SAMPLE = 13, 8 << 20, 4 << 20, 8

#: Bytes to lower-case word bytes, all else to a space: digits, letters and what is beyond ASCII are word bytes.
_FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
#: Never part of UTF-8, so it can stand between documents.
_MARK = b"\xff"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector with popcounts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(seq), bits, []
        for shift in range(bits - 1, -1, -1):
            bit = (seq >> shift) & 1
            padded = np.zeros((self.n + 64) // 64 * 64, np.uint8)
            padded[: self.n] = bit
            blocks = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(blocks) + 1, np.int64)
            np.cumsum(np.bitwise_count(blocks), out=before[1:])
            zeros = self.n - int(before[-1])
            self.levels.append((shift, blocks, before, zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    @staticmethod
    def _ones(blocks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return before[block] + np.bitwise_count(blocks[block] & mask)

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` comes to lie when the sequence is dealt out by the bits of `symbol`."""
        for shift, blocks, before, zeros in self.levels:
            ones = self._ones(blocks, before, at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def symbol_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and where these come to lie."""
        symbol = np.zeros_like(at)
        for _, blocks, before, zeros in self.levels:
            bit = (blocks[at >> 6] >> (at & 63).astype(np.uint64)).astype(np.int64) & 1
            ones = self._ones(blocks, before, at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            symbol = symbol << 1 | bit
        return symbol, at


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence that ends with 0, in order; each 0 is a separator of its own, ordered by place.
    Prefix doubling that sorts only what is still tied."""
    n = len(seq)
    ends = seq == 0
    rank = np.where(ends, np.cumsum(ends) - 1, seq.astype(np.int64) + int(ends.sum()))
    order = np.argsort(rank, kind="stable")

    def grouped(keys: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks as the place of a group's first member; which members are not alone."""
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(keys)))
        return np.repeat(base[first], size), np.repeat(size > 1, size)

    places = np.arange(n)
    ranks, tied = grouped(rank[order], places)
    rank[order] = ranks
    places, step = places[tied], 1
    while len(places):
        members = order[places]
        key = rank[members] * (n + 1) + rank[np.minimum(members + step, n - 1)]
        inner = np.argsort(key, kind="stable")
        members = members[inner]
        order[places] = members
        ranks, tied = grouped(key[inner], places)
        rank[members] = ranks
        places, step = places[tied], step * 2
    return order


class FMIndex:
    """An index of a sequence of symbols from 1, with 0 between its runs and at its end."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(seq)
        bwt = seq[order - 1].astype(np.int64)
        top = int(seq.max(initial=1))
        self.n = len(seq)
        self.tree = WaveletMatrix(bwt, max(1, top.bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 2))]).astype(np.int64)
        symbols = np.arange(top + 1, dtype=np.int64)
        self.zero = self.tree.walk(symbols, np.zeros(top + 1, np.int64))
        # A run's first position is sampled as well, so no walk crosses a separator.
        keep = (order % sample == 0) | (bwt == 0)
        self.sampled, self.kept = keep, order[keep]
        self.kept_before = np.cumsum(keep) - 1

    def search(self, row: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of patterns of one length, which begin at `starts` of a row of symbols: which occur, and their intervals of
        suffixes."""
        alive = np.arange(len(starts))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for k in range(length - 1, -1, -1):
            symbol = row[starts[alive] + k].astype(np.int64)
            there = symbol < len(self.zero)
            alive, symbol, low, high = alive[there], symbol[there], low[there], high[there]
            base = self.first[symbol] - self.zero[symbol]
            low, high = base + self.tree.walk(symbol, low), base + self.tree.walk(symbol, high)
            there = low < high
            alive, low, high = alive[there], low[there], high[there]
        return alive, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes."""
        found, steps = np.empty_like(at), np.zeros_like(at)
        open_ = np.arange(len(at))
        at = at.copy()
        while len(open_):
            here = self.sampled[at[open_]]
            done = open_[here]
            found[done] = self.kept[self.kept_before[at[done]]] + steps[done]
            open_ = open_[~here]
            symbol, place = self.tree.symbol_at(at[open_])
            at[open_] = self.first[symbol] + place - self.zero[symbol]
            steps[open_] += 1
        return found


class Phrases:
    """The windows of benchmark items, in arrays: all items' words as symbols in a row, where each distinct window of a
    length begins, and the items that hold it. About 60 bytes a word while it is made."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        rows, of = [], []
        for item, text in items:
            words = words_of(text)
            if words:
                rows.append(np.fromiter((self.symbols.setdefault(w, len(self.symbols) + 1) for w in words), np.int32, len(words)))
                of.append(number[item])
        sizes = np.array([len(r) for r in rows], np.int64)
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        first, lengths = np.cumsum(sizes) - sizes, np.minimum(sizes, window)
        self.groups = []
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            n = sizes[own] - length + 1
            starts = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            self.groups.append((length, *self._distinct(starts, np.repeat(np.array(of, np.int32)[own], n), length)))
        self.shortest = min((g[0] for g in self.groups), default=0)

    def _distinct(self, starts: np.ndarray, items: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where distinct windows begin; the items of all windows, equal windows together; and where each one's begin.
        Windows are sorted by a hash and told apart by their symbols: those whose hashes collide stay apart."""
        hashes = np.zeros(len(starts), np.uint64)
        for k in range(length):
            hashes = (hashes ^ self.row[starts + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        order = np.lexsort((items, hashes))
        starts, items, hashes = starts[order], items[order], hashes[order]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        for k in range(length):
            fresh[1:] |= self.row[starts[1:] + k] != self.row[starts[:-1] + k]
        head = np.flatnonzero(fresh)
        return starts[head], items, np.append(head, len(starts))


_phrases: dict[str, Phrases] = {}


def _phrases_of(key: str, shared) -> Phrases:
    """Built once a worker; a worker keeps the last one only."""
    if key not in _phrases:
        _phrases.clear()
        _phrases[key] = Phrases(shared.value)
    return _phrases[key]


def _runs(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence to index, and the place in ids of each of its symbols: runs of known words that are long
    enough for the shortest window, each with a 0 behind it."""
    known = np.concatenate([[False], ids > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long_ = ends - starts >= least
    starts, sizes = starts[long_], (ends - starts)[long_] + 1
    total = int(sizes.sum())
    offset = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(starts, sizes) + np.arange(total) - offset
    seq = np.where(np.arange(total) - offset == np.repeat(sizes, sizes) - 1, 0, np.append(ids, 0)[place])
    return seq, place


def scan_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each text: its words, its removal spans (in words, end exclusive), and the items it holds."""
    data = (b" " + _MARK + b" ").join((t or "").encode().translate(_FOLD) for t in texts)
    words = data.split()
    known = {**phrases.symbols, _MARK: -1}
    ids = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
    del words, data
    marks = np.flatnonzero(ids < 0)
    begins = np.concatenate([[0], marks + 1])
    counts = np.append(marks, len(ids)) - begins
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(int(n), [], []) for n in counts]
    seq, place = _runs(ids, phrases.shortest) if phrases.groups else (np.zeros(0, np.int64), None)
    if not len(seq):
        return out
    index = FMIndex(seq)
    edge = np.zeros(len(ids) + 1, np.int64)
    held: dict[int, set[str]] = {}
    for length, starts, items, bounds in phrases.groups:
        which, low, high = index.search(phrases.row, starts, length)
        if not len(which):
            continue
        sizes = high - low
        rows = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        at = place[index.locate(rows)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        doc = np.searchsorted(begins, at, side="right") - 1
        pair = np.unique(doc * len(starts) + np.repeat(which, sizes))
        one, n = pair % len(starts), bounds[1:] - bounds[:-1]
        n = n[one]
        held_items = items[np.repeat(bounds[one] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        found = np.unique(np.repeat(pair // len(starts), n) * len(phrases.items) + held_items)
        for d, item in zip((found // len(phrases.items)).tolist(), (found % len(phrases.items)).tolist(), strict=True):
            held.setdefault(d, set()).add(phrases.items[item])
    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    of = np.searchsorted(begins, turns[::2], side="right") - 1
    for d, start, end in zip(of.tolist(), turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        out[d][1].append((start - int(begins[d]), end - int(begins[d])))
    for d, items in held.items():
        out[d][2].extend(sorted(items))
    return out


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(shared, key: str, at: int | None, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases_of(key, shared)
        for batch in batches:
            texts = text_of(batch, "own" if at is not None else "text", at)
            for a, b in cuts_by_bytes(texts, SHARD_BYTES, 1 << 16):
                part = batch.slice(a, b - a)
                found = scan_shard(texts.slice(a, b - a).to_pylist(), phrases)
                spans, items = [x[1] for x in found], [x[2] for x in found]
                if "spans" in part.schema.names:
                    old = part.column("spans").to_pylist()
                    spans = [_merged([(s["start"], s["end"]) for s in o], n) for o, n in zip(old, spans, strict=True)]
                    items = [sorted({*o, *n}) for o, n in zip(part.column("items").to_pylist(), items, strict=True)]
                columns = {"own": part.column("own")} | ({} if last or at is not None else {"text": part.column("text")})
                columns |= {
                    "n_words": pa.array([x[0] for x in found], pa.int64()),
                    "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _ARROW_SPANS),
                    "items": pa.array(items, pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return released(run)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep: bool = False,
) -> DataFrame:
    """Of each row of docs: its id (with keep, the whole row as struct `row` instead), n_words, spans (array of start and
    end in words: what is to be removed) and items (ids, as sorted strings, of the benchmark items with a window there).

    Null and empty texts have no words. Repeated rows each get their result. A benchmark row without text takes no part;
    one without an id is the item `null`, so that its windows still count. An empty benchmark hits nothing, an empty
    table gives no rows. Other columns of either table are not read, but with keep."""
    spark = docs.sparkSession
    item = F.coalesce(F.col(item_col).cast("string"), F.lit("null"))
    known = benchmark.select(item.alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.select(whole(docs).alias("own")) if keep else docs.select(quoted(id_col).alias("own"), quoted(text_col).alias("text"))
    own, at = out.schema["own"], docs.columns.index(text_col) if keep else None
    for k in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])
        last = k == blocks - 1
        fields = [own, *([] if last or keep else [T.StructField("text", T.StringType())])]
        fields += [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
        out = out.mapInArrow(_pass(shared, uuid.uuid4().hex, at, last), T.StructType(fields))
    return out.withColumnRenamed("own", "row" if keep else id_col)


def _hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _contaminated(hit: Column) -> Column:
    return (hit > 0) & (20 * hit >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's."""
    return found.select(
        "doc_id", "n_words", _hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    ).withColumn("contaminated", _contaminated(F.col("n_hit")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that the benchmark contaminates; texts that are null or have no words stay, repeated
    rows are judged each, and an empty table stays empty. A row goes through the pass once, as one struct: its text is
    neither shuffled nor sent twice."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return unpacked(found.where(~_contaminated(_hit())), docs)
