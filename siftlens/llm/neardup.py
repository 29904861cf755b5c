"""Near-duplicate detection: MinHash bands, odd sketches, and links confirmed on full shingle sets.

1. One pass over the texts gives each document the size and a digest of its shingle set, its MinHash samples folded
   into bands, and an odd sketch of the samples: a bitmap in which each sample flips one bit, so that the XOR of two
   sketches counts the samples in which two documents differ.
2. Documents with equal sets are one class; only its smallest id goes on. Copies are never paired.
3. In each band bucket all members are paired with its smallest id; sketches reject pairs that are clearly below the
   threshold, and each member's most promising partner is confirmed on the full sets. The links give first components.
4. Buckets that still hold several components: in some rounds all others are paired with a member of the largest, again
   one confirmation a member. Then the pairs across components of buckets of at most HOT members are looked at within a
   join, in the first band they share; those of larger buckets are found by the rarest shingles of their members' sets,
   of which two similar sets must share one, at places that leave enough behind them. A pair within one component can add nothing. So no pair that meets in a
   band is left out, yet a group of n near copies, or of n texts around a common passage, costs far less than n * n.
5. Final components by hooking and pointer jumping over the links.

Bands, links and labels stay tables; the driver sees counts only.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlens.llm.common import cuts_by_bytes, quoted, released, stored, table, text_of, unpacked, whole

#: Words of a shingle; bands, and samples in each: a pair at 0.75 is missed with probability (1 - 0.75**4)**32 < 1e-5.
SHINGLE, BANDS, ROWS = 5, 32, 4
#: Samples in all: those of the bands, and as many for the sketch alone.
SAMPLES = 2 * BANDS * ROWS
#: Bits of a sketch, and bits in which two sketches may differ. At a similarity of 0.75, 128 of 2 * 256 samples' marks
#: differ on average and 113 bits, with a standard deviation of 13; the bound is four of these above.
SKETCH_BITS, MOST_DIFFERENT = 1024, 165
#: Bits of the bitmap of ids whose texts are needed again: 2 MB.
MARKS = 1 << 24
#: Bits of a part of it, as Spark builds bitmaps.
BUCKET = 1 << 15
#: Members of a bucket beyond which its pairs are found by their rarest shingles; members of a shingle beyond which it
#: counts as frequent, at least.
HOT = 64
#: Rounds in which buckets with several components are joined to their largest, before all pairs across are looked at.
ROUNDS = 2
#: Bytes of text whose sets are made at a time, in a worker.
PASS_BYTES = 1 << 20
#: Least similarity in hundredths.
LEAST = 75

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = (_rng.integers(1, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_SHIFT = _rng.integers(1, 1 << 31, SAMPLES, dtype=np.uint64).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text, lower-cased A-Z, in order."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_WHITE[raw]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # Each byte's number, scattered with its place in the word, summed over the word.
    sizes = ends - starts
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    place = at - np.repeat(starts, sizes)
    values = _mixed(_BYTE[_LOWER[raw[at]]] + place.astype(np.uint64) * _STEP)
    sums = np.add.reduceat(values, np.cumsum(sizes) - sizes)
    return _mixed(sums + sizes.astype(np.uint64))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; a text of fewer words has its whole sequence as one
    shingle, a text without words none."""
    out = []
    for data in texts:
        words = word_hashes(data)
        n = min(size, len(words))
        if not n:
            out.append(words)
            continue
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total = _mixed(total + words[k : k + len(total)] + np.uint64(n))
        out.append(np.unique(total))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash samples and odd sketches of sets that are not empty, a row each."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    low = (every >> np.uint64(32)).astype(np.uint32) ^ every.astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    samples = np.empty((len(sets), SAMPLES), np.uint32)
    turned = np.empty_like(low)
    for k in range(SAMPLES):
        np.multiply(low, _TURN[k], out=turned)
        np.add(turned, _SHIFT[k], out=turned)
        turned ^= turned >> np.uint32(15)
        turned *= np.uint32(0x2C1B3C6D)
        samples[:, k] = np.minimum.reduceat(turned, first)
    marks = (_mixed(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = np.zeros((len(sets), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(bits, (np.arange(len(sets))[:, None], marks), 1)
    return samples, np.packbits(bits, axis=1, bitorder="little").view(np.int64)


_WORDS = SKETCH_BITS // 64
_SIGNED = [
    T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
    T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType())),
]


def _lists(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """A list column: a row of values where there is one, else an empty list."""
    ends = np.concatenate([[0], np.cumsum(np.where(there, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts_by_bytes(batch.column("text"), PASS_BYTES, 256):
                part = batch.slice(a, b - a)
                sets = shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()], shingle)
                there = np.array([len(s) > 0 for s in sets], bool)
                if there.any():
                    samples, sketch = signatures([s for s in sets if len(s)])
                    grouped = samples[:, : BANDS * ROWS].reshape(len(samples), BANDS, ROWS).astype(np.uint64)
                    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grouped.shape[:2]) + np.uint64(1)
                    for k in range(ROWS):
                        keys = _mixed(keys * _STEP + grouped[:, :, k])
                    bands = keys.view(np.int64)
                else:
                    sketch, bands = np.zeros((0, _WORDS), np.int64), np.zeros((0, BANDS), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *_digests(sets), _lists(sketch, there), _lists(bands, there)],
                    names=["id", "n", "d1", "d2", "sketch", "bands"],
                )

    return released(run)


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two sums over each set, which together stand for it."""
    return [
        pa.array([len(s) for s in sets], pa.int64()),
        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
        pa.array(np.array([_mixed(s ^ _STEP).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
    ]


def _digested(shingle: int, at: int | None = None):
    """Rows with the digests of their texts' sets; `at`: the text's field where whole rows are a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in text_of(batch, "text" if at is None else "row", at).to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, *_digests(sets)], names=[*batch.schema.names, "n", "d1", "d2"])

    return released(run)


def _sets(shingle: int):
    """Nodes with their sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts_by_bytes(batch.column("text"), PASS_BYTES, 256):
                part = batch.slice(a, b - a)
                sets = shingle_sets([t.encode() for t in part.column("text").to_pylist()], shingle)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), values], names=["node", "shingles"])

    return released(run)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each batch, and how many of its sets hold them: what many share is counted before it is sent."""
    for batch in batches:
        values, c = np.unique(batch.column("shingles").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(c.astype(np.int64))], names=["shingle", "c"])


def _parted(marks: np.ndarray):
    """Nodes with their shingles that the bitmap does not mark, and those that it marks, each in the set's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("shingles")
            values = held.flatten().to_numpy()
            at = values & (MARKS - 1)
            marked = (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            ends = np.cumsum(np.concatenate([[0], pc.list_value_length(held).to_numpy()]))
            lists = []
            for those in (~marked, marked):
                upto = np.concatenate([[0], np.cumsum(those)])[ends].astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(values[those])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), *lists], names=["node", "rare", "often"])

    return released(run)


def _confirm(shingle: int, least: int):
    """Of rows of two nodes and their texts: the pairs of nodes whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))  # rows come ordered by a
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            linked = []
            for k in range(batch.num_rows):
                if a[k] != last[0]:
                    last = (a[k], shingle_sets([batch.column("a_text")[k].as_py().encode()], shingle)[0])
                one, other = last[1], shingle_sets([batch.column("b_text")[k].as_py().encode()], shingle)[0]
                common = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(100 * common >= least * (len(one) + len(other) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return released(run)


def _different(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(_WORDS)])


def _near(least: int) -> Column:
    """What a linked pair must meet before its sets are looked at: sizes and sketches."""
    sizes = 100 * F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n")
    return sizes & (_different("a_sketch", "b_sketch") <= MOST_DIFFERENT)


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, least: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. texts: node and text, one row a node."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.mapInArrow(_confirm(shingle, least), "a long, b long")


def roots(parents: DataFrame) -> DataFrame:
    """node and label of all nodes of a forest (node, parent), where a root is its own parent: pointer jumping, which
    halves the depth each time."""
    labels = parents.select("node", F.col("parent").alias("label"))
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = stored(labels.join(up, "label").select("node", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("moved")), "roots")
        labels = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return labels


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of all nodes that links (a, b) name: each takes the smallest label
    among its neighbours, then the label of its label, until nothing changes."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(seen.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        hooked = stored(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = stored(hooked.join(up, "label").select("node", F.col("above").alias("label"), (F.col("above") != F.col("old")).alias("moved")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """Each row of docs: its id, n_shingles, component_id (smallest id reachable over links) and kept.

    Rows with null or empty text, or without words, have no shingles, are linked with nothing and stand for themselves.
    Rows that share an id are told apart by their texts; repeated rows are copies of each other. A row with a null id
    takes no part in links: its component_id is null and it is kept. Other columns are not read; an empty table gives
    no rows. Sets are told apart by a 64-bit digest, and compared as sets of 64-bit hashes."""
    signed, named, _ = _grouped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, least)
    return _verdicts(signed, named).withColumnRenamed("id", id_col)


def _grouped(rows: DataFrame, shingle: int, least: int) -> tuple[DataFrame, DataFrame, bool]:
    """The signed rows; each node with its smallest id and the label of its component; whether ids repeat."""
    signed = rows.mapInArrow(_sign(shingle), T.StructType([rows.schema["id"], *_SIGNED]))
    signed = stored(signed.select("id", "n", F.xxhash64("n", "d1", "d2").alias("node"), "sketch", "bands"), "signed")
    members = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    # A node: all documents with the same set. Its smallest id stands for it.
    reps = stored(members.groupBy("node").agg(F.min("id").alias("id")), "reps")
    repeats = signed.groupBy("id").count().where("count > 1").limit(1).count() > 0
    nodes = members.join(reps, ["id", "node"]).select("id", "node", "n", "sketch", "bands")
    nodes = stored(nodes.dropDuplicates(["node"]) if repeats else nodes, "nodes")
    named = reps.join(_labels(nodes, rows, repeats, shingle, least), "node", "left")
    return signed, stored(named.select("node", "id", F.coalesce("label", "node").alias("label")), "labelled"), repeats


def _verdicts(signed: DataFrame, named: DataFrame) -> DataFrame:
    # The smallest id of each component.
    first = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of = stored(named.join(first, "label").select("node", "component_id"), "of")
    out = signed.select("id", "n", "node").join(of, "node", "left")
    own = (F.col("n") == 0) | F.col("id").isNull()
    component = F.when(own, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _labels(nodes: DataFrame, rows: DataFrame, repeats: bool, shingle: int, least: int) -> DataFrame:
    """node and label of all nodes that meet another in a bucket: nodes of one component have the same label."""
    slim = nodes.select("node", "n", "sketch")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("first")).where("c > 1").select("key", "first")
    hits = stored(buckets.join(stored(shared, "shared"), "key"), "hits")
    # The texts of all nodes that meet another. Where ids repeat, a text's node is told by its digest.
    met = stored(nodes.select("id", "node").join(hits.select("node").distinct(), "node", "left_semi"), "met")
    if repeats:
        again = rows.select("text").mapInArrow(_digested(shingle), "text string, n long, d1 long, d2 long")
        texts = again.withColumn("node", F.xxhash64("n", "d1", "d2")).join(met, "node", "left_semi").dropDuplicates(["node"])
    else:
        texts = _likely(rows, met).join(met, "id")
    texts = stored(texts.select("node", "text"), "texts")
    side = lambda x: slim.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    stars = hits.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    near = stars.join(side("b"), "b").join(side("a"), "a").where(_near(least))
    best = near.groupBy("b").agg(F.min_by("a", F.struct(_different("a_sketch", "b_sketch"), F.col("a"))).alias("a")).select("a", "b")
    links = stored(_confirmed(stored(best, "best"), texts, shingle, least), "links")
    # Each member has one link at most, to a smaller node: a forest.
    parents = hits.select("node").distinct().join(links.select(F.col("b").alias("node"), "a"), "node", "left")
    labels = roots(stored(parents.select("node", F.coalesce("a", "node").alias("parent")), "parents"))
    for turn in range(ROUNDS):
        pairs = _to_largest(_mixed_buckets(hits, labels), turn).join(side("b"), "b").join(side("a"), "a").where(_near(least))
        chosen = F.struct("a", "a_label", "b_label")
        pairs = pairs.groupBy("b").agg(F.min_by(chosen, F.struct(_different("a_sketch", "b_sketch"), F.col("a"))).alias("best")).select("b", "best.*")
        labels, moved = _joined(labels, pairs, texts, shingle, least)
        if not moved:
            break
    # All that still meets in a bucket across components, with its whole set, so that only links leave a join.
    left = stored(_mixed_buckets(hits, labels), "left")
    sizes = stored(left.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("key"), "hot_keys")
    sets = texts.join(left.select("node").distinct(), "node", "left_semi").mapInArrow(_sets(shingle), "node long, shingles array<long>")
    sets = stored(sets, "sets")
    across = _within(left.join(sizes, "key", "left_anti"), nodes, sets, least)
    if sizes.limit(1).count():
        large = left.join(sizes, "key", "left_semi").select("node", "label").distinct()
        across = across.union(_by_rare(stored(large, "large"), slim, sets, least))
    return _merged(labels, across)[0]


def _linked(least: int) -> Column:
    """Whether the pair of a row is similar enough: sizes and sketches first, then the whole sets."""
    return F.when((F.col("a_label") != F.col("b_label")) & _near(least), _similar(least))


def _similar(least: int) -> Column:
    """Whether the whole sets of a row's pair are similar enough."""
    common = F.size(F.array_intersect("a_shingles", "b_shingles")).cast("long")
    return 100 * common >= least * (F.col("a_n") + F.col("b_n") - common)


def _within(left: DataFrame, nodes: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links between labels within buckets of HOT members at most: every pair, in the first band it shares."""
    open_ = stored(left.join(nodes.select("node", "n", "sketch", "bands"), "node").join(sets, "node"), "open")
    one = lambda x: open_.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "label", "n", "sketch", "bands", "shingles")))
    same = F.filter(F.arrays_zip("a_bands", "b_bands"), lambda x: x["a_bands"] == x["b_bands"])
    fits = F.when(same[0]["a_bands"] == F.col("key"), _linked(least))
    across = one("a").join(one("b"), "key").where((F.col("a_node") < F.col("b_node")) & fits)
    return across.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))


def _by_rare(members: DataFrame, slim: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links between labels among the members of large buckets, without pairing these. All sets are put into one order
    of shingles, from rare to frequent. Two sets that are similar enough have their first common shingle early in both,
    as no more of them can be common than stand behind it: a place says how large a partner it can still serve. Where
    large buckets come from a common passage, the early shingles are what the texts do not share, and few pairs meet."""
    own = stored(members.join(sets, "node"), "hot_sets")
    each = own.select("shingles").mapInArrow(_numbers, "shingle long, c long")
    held = stored(each.groupBy("shingle").agg(F.sum("c").alias("c")).where("c > 1"), "held")
    often, marks = _frequent(held)
    # Frequent shingles come last, in the order of their hashes; only the others need their numbers.
    parted = stored(own.select("node", "shingles").mapInArrow(_parted(marks), "node long, rare array<long>, often array<long>"), "parted")
    counted = parted.select("node", F.explode("rare").alias("shingle")).join(held.where(F.col("c") <= often), "shingle")
    counted = counted.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "shingle")))["shingle"].alias("rare"))
    sized = members.join(slim.select("node", "n"), "node")
    ordered = sized.join(parted.select("node", "often"), "node").join(counted, "node", "left")
    # A shingle that one member alone holds comes first and can be no partner's: only its number counts.
    ordered = ordered.withColumn("order", F.concat(F.coalesce("rare", F.array().cast("array<long>")), "often")).drop("rare", "often")
    alone = F.col("n") - F.size("order")
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n") / 100) + 1
    ordered = ordered.withColumn("alone", alone).withColumn("take", F.greatest(F.lit(0), prefix - alone).cast("int"))
    places = ordered.select("node", "label", "n", "alone", F.posexplode(F.slice("order", F.lit(1), F.col("take"))).alias("k", "shingle"))
    behind = F.col("n") - F.col("alone") - F.col("k")
    reach = F.floor(behind * (100 + least) / least) - F.col("n")
    meets = stored(places.select("shingle", "node", "label", "n", reach.alias("reach")), "meets")
    one = lambda x: meets.select("shingle", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "label", "n", "reach")))
    larger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") > F.col("b_node")))
    serves = (F.col("a_reach") >= F.col("b_n")) & (F.col("b_reach") >= F.col("a_n"))
    pairs = one("a").join(one("b").where("b_reach >= b_n"), "shingle").where(larger & serves & (F.col("a_label") != F.col("b_label")))
    pairs = stored(pairs.drop("shingle", "a_reach", "b_reach").dropDuplicates(["a_node", "b_node"]), "rare_pairs")
    drawn = lambda x: slim.select(F.col("node").alias(f"{x}_node"), F.col("sketch").alias(f"{x}_sketch"))
    near = pairs.join(drawn("a"), "a_node").join(drawn("b"), "b_node").where(_near(least)).drop("a_sketch", "b_sketch")
    side = lambda x: own.select(F.col("node").alias(f"{x}_node"), F.col("shingles").alias(f"{x}_shingles"))
    both = stored(near, "near_pairs").join(side("a"), "a_node").join(side("b"), "b_node").where(_similar(least))
    return both.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))


def _frequent(held: DataFrame) -> tuple[int, np.ndarray]:
    """How many members a shingle may have that is still counted one by one, and a bitmap of fixed size that marks all
    shingles with more. The number is a power of two, so large that a small part of the bitmap is marked."""
    classes = dict(held.groupBy(F.floor(F.log2(F.col("c") - 0.5)).cast("int").alias("power")).count().collect())
    power = int(np.log2(HOT))
    while sum(n for k, n in classes.items() if k >= power) > MARKS // 8:
        power += 1
    mark = F.col("shingle").bitwiseAND(F.lit(MARKS - 1)) + 1
    found = held.where(F.col("c") > (1 << power)).groupBy(F.bitmap_bucket_number(mark).alias("bucket"))
    marks = np.zeros((MARKS // BUCKET, BUCKET // 8), np.uint8)
    for bucket, part in found.agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark))).collect():
        marks[bucket - 1] = np.frombuffer(part, np.uint8)
    return 1 << power, marks.ravel()


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id has a mark in a bitmap of the wanted ids' hashes: all that are wanted, and some more the more
    there are. The bitmap is of a fixed size, so it can be broadcast at any scale, and spares most texts the shuffle."""
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS)) + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(mark).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("marks"))
    place = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substring("marks", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(byte, cast(place % 8 as int)) & 1 = 1")
    both = rows.withColumn("bucket", F.bitmap_bucket_number(mark)).join(F.broadcast(marks), "bucket")
    return both.withColumn("byte", byte).withColumn("place", place).where(set_).select(*rows.columns)


def _mixed_buckets(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node and label of the buckets that hold several components."""
    named = stored(hits.select("key", "node").join(labels, "node"), "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    return named.join(stored(mixed, "mixed"), "key", "left_semi")


def _to_largest(named: DataFrame, turn: int) -> DataFrame:
    """Pairs of a member of each bucket's largest component, another in each turn, and all members of others."""
    named = stored(named, "mixed_named")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("a"))
    top = sizes.groupBy("key").agg(F.max_by(F.struct("a", "label"), F.struct("c", "label")).alias("top"))
    top = stored(top.select("key", "top.a", F.col("top.label").alias("a_label")), "largest")
    pairs = named.join(top, "key").where("label != a_label")
    return pairs.select("a", F.col("node").alias("b"), "a_label", F.col("label").alias("b_label")).distinct()


def _joined(labels: DataFrame, pairs: DataFrame, texts: DataFrame, shingle: int, least: int) -> tuple[DataFrame, bool]:
    """Labels after the confirmed ones of pairs (a, b, and their labels) have joined components, and whether any did."""
    pairs = stored(pairs, "pairs")
    if not pairs.limit(1).count():
        return labels, False
    more = pairs.join(_confirmed(pairs.select("a", "b"), texts, shingle, least), ["a", "b"])
    return _merged(labels, more.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))


def _merged(labels: DataFrame, more: DataFrame) -> tuple[DataFrame, bool]:
    """Labels after links (a, b) between labels, and whether there are any."""
    more = stored(more.distinct(), "more")
    if not more.limit(1).count():
        return labels, False
    joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return stored(labels.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels"), True


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of those with its smallest doc_id. Rows without words, or without an
    id, stay. Rows that share a doc_id are judged each by its own text; of those with the same doc_id and the same set
    of shingles one stays."""
    signed, named, repeats = _grouped(docs.select(F.col("doc_id").alias("id"), "text"), SHINGLE, LEAST)
    gone = stored(_verdicts(signed, named).where(~F.col("kept")).select("id").distinct(), "gone")
    if not repeats:
        return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti").select(*map(quoted, docs.columns))
    twice = stored(signed.where(F.col("id").isNotNull()).groupBy("id").count().where("count > 1").select("id"), "twice")
    settled = twice.union(gone).distinct()
    once = docs.join(settled, docs["doc_id"] == settled["id"], "left_anti").select(*map(quoted, docs.columns))
    packed = docs.join(twice, docs["doc_id"] == twice["id"], "left_semi").select(whole(docs).alias("row"), docs["doc_id"].alias("id"))
    again = packed.mapInArrow(_digested(SHINGLE, docs.columns.index("text")), T.StructType([*packed.schema, *_SIGNED[:3]]))
    again = again.select("row", "n", "id", F.xxhash64("n", "d1", "d2").alias("node"))
    keep = named.groupBy("label").agg(F.min(F.struct("id", "node")).alias("keep")).select("keep.*")
    one = again.where("n > 0").join(keep, ["id", "node"], "left_semi").groupBy("id", "node").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.union(unpacked(one, docs)).union(unpacked(again.where("n = 0"), docs))
