"""Best-fit packing by exact-complement hashing.

Pieces of documents are packed into sequences of a fixed capacity. Only their lengths matter for the plan, and these
are at most `capacity` different numbers: the plan is made over counts by length, so what reaches the driver is bounded
by the capacity, not by the corpus. For each length, longest first, the gap it leaves is looked up among the single,
pair and triple sums of the available lengths; a combination that fills a gap exactly is consumed as many times as the
counts allow. What is left is packed best-fit, again by counts.

A piece then finds its sequence by its rank among the pieces of its length. Ranks are taken within salted shares of
each length, as many as the most frequent length asks for, and shifted by the shares' sizes; full pieces need no rank.
"""

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlens.llm.common import cuts_by_bytes, quoted, released, stored, table
from siftlens.llm.tokens import REMEMBERED, crc_of, encoder, vocabulary_path

CAPACITY, END = 1024, 2
#: Bytes of text encoded at a time; pieces of one length that a task ranks, and shares at least; stretches that a worker of the pipeline remembers.
PASS_BYTES, SHARE, SALTS, STAGE_REMEMBERED = 2 << 20, 200_000, 64, 100_000
VOCABULARY = "byte_bpe_50k.json"


class _Sums:
    """Sums of one and of two available lengths, by the sum; a pair's second length is the partner of its first."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.lengths = sorted(counts, reverse=True)

    def _has(self, *lengths: int) -> bool:
        return all(self.counts.get(x, 0) >= lengths.count(x) for x in lengths)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts.get(gap, 0) else None

    def pair(self, gap: int, most: int | None = None, also: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        for a in self.lengths:
            if a < gap and (most is None or a <= most) and self._has(*also, a, gap - a):
                return (a, gap - a)
            if 2 * a < gap:
                return None
        return None

    def triple(self, gap: int, also: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        for a in self.lengths:
            if a >= gap or not self._has(*also, a):
                continue
            if 3 * a < gap:
                return None
            if found := self.pair(gap - a, a, (*also, a)):
                return (a, *found)
        return None


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, and how many sequences take each; every counted piece is in one."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    plan: list[tuple[tuple[int, ...], int]] = []
    if c := counts.pop(capacity, 0):
        plan.append(((capacity,), c))

    def consume(pattern: tuple[int, ...]) -> None:
        times = min(counts[n] // pattern.count(n) for n in pattern)
        plan.append((pattern, times))
        for n in pattern:
            counts[n] -= times
        for n in {*pattern}:
            if not counts[n]:
                del counts[n]

    for longest in sorted(counts, reverse=True):
        while counts.get(longest, 0):
            counts[longest] -= 1  # the piece whose gap is to be filled is not there for the filling
            sums, gap = _Sums(counts), capacity - longest
            found = sums.single(gap) or sums.pair(gap) or sums.triple(gap)
            counts[longest] += 1
            if not found:
                break
            consume((longest, *found))
    return plan + _best_fit(counts, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence with room for it; sequences alike are handled as one."""
    bins: dict[tuple[int, ...], int] = {}
    rooms: list[tuple[int, tuple[int, ...]]] = []  # by free room

    def put(pattern: tuple[int, ...], times: int) -> None:
        if pattern not in bins:
            insort(rooms, (capacity - sum(pattern), pattern))
        bins[pattern] = bins.get(pattern, 0) + times

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(rooms, (n, ()))
            if at == len(rooms):
                each = capacity // n
                full, rest = divmod(left, each)
                if full:
                    put((n,) * each, full)
                if rest:
                    put((n,) * rest, 1)
                break
            _, pattern = rooms[at]
            times = min(left, bins[pattern])
            bins[pattern] -= times
            if not bins[pattern]:
                del bins[pattern]
                rooms.pop(at)
            put((*pattern, n), times)
            left -= times
    return list(bins.items())


_PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType())])


def _pieces(path: str, capacity: int, end: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, True, remembered)
        for batch in batches:
            for a, b in cuts_by_bytes(batch.column("text"), PASS_BYTES, 512):
                part = batch.slice(a, b - a)
                rows: list[tuple[int, int, int, int, int]] = []
                for k, ids in enumerate(tokens.encode(part.column("text").to_pylist())):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    rows += [(k, n, s, e - s, crc_of(ids[s:e])) for n, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                at, piece, start, length, crc = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return released(run)


def _lookup(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which rank on a slot of a pattern holds, its first sequence, and the place in it."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    taken: dict[int, int] = {}
    for pattern, times in plan:
        at = 0
        for n in pattern:
            slots.setdefault(n, []).append((taken.get(n, 0), base, at))
            taken[n] = taken.get(n, 0) + times
            at += n
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) for n, s in slots.items()}


def _placing(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                first, base, at = slots[n]
                k = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = base[k] + rank[own] - first[k], at[k]
            names = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all rows of docs, packed: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone. Repeated rows are packed each; a null id is kept. Only
    documents longer than the capacity are cut: into full pieces, the first of which may be shorter. An empty table
    gives no rows. `remembered`: stretches that a worker's tokenizer keeps.

    Full pieces are sequences of their own: they are numbered as they come, below zero, without a shuffle. Pieces of
    other lengths are dealt over as many shares as their number asks for, and ranked within."""
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], *_PIECES.fields])
    pieces = stored(rows.mapInArrow(_pieces(vocabulary, capacity, end, remembered), schema), "pieces")
    columns = ["id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32"]
    full = pieces.where(F.col("length") == capacity)
    full = full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # at most capacity rows
    salts = max(SALTS, -(-max(histogram.values(), default=0) // SHARE))
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "start"), F.lit(salts)).cast("int"))
    # Shares of a length follow each other: where each begins among its like. A length has few shares but for a table of
    # very many pieces, and then there are capacity x salts rows, which stay a table.
    order = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(rest.groupBy("length", "salt").agg(F.count("*").alias("n")), "shares")
    shifts = shifts.select("length", "salt", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shift"))
    slots = spark.sparkContext.broadcast(_lookup(plan_packing(histogram, capacity)))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "start")
    ranked = rest.withColumn("rank", F.row_number().over(within)).join(shifts, ["length", "salt"])
    ranked = ranked.select(*columns, (F.col("rank") - 1 + F.col("shift")).alias("rank"))
    out = T.StructType([x for x in ranked.schema.fields if x.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_placing(slots), out).union(full).withColumnRenamed("id", id_col)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: all documents that are left, packed into sequences. Null and empty texts are the end id alone,
    repeated rows are packed each, and an empty table gives no rows. Its workers remember less than the query's, as
    they hold other stages' memory too."""
    return pack(docs, vocabulary_path(VOCABULARY), remembered=STAGE_REMEMBERED)
