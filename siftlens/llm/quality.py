"""Quality scores by a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. In each chunk learned filters slide over the
embedded bytes; the highest response of each filter is kept. A document's features are the mean and the maximum of its
chunks' responses and the logarithm of its length, and a hidden layer combines them into one probability.

The network is fitted on the driver by gradient descent, on a sample of labelled rows whose size is a parameter. All
documents are scored over their whole bytes in one pass, without a shuffle.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlens.llm.common import cuts_by_bytes, hashed_share, quoted, released, table

#: Expected rows of each label in the sample, and the longest text taken for it, in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 700, 12_000
#: Numbers of a byte's embedding; bytes a filter sees and its step; filters; filter places of a chunk; hidden units.
EMBED, SEEN, STEP, FILTERS, PLACES, HIDDEN = 6, 8, 4, 24, 64, 16
#: Bytes of a chunk, and from one chunk to the next: they overlap by what a filter sees beyond its step.
CHUNK, STRIDE = (PLACES - 1) * STEP + SEEN, PLACES * STEP
#: Bytes of texts scored at a time; chunks of one text made at a time.
PASS_BYTES, LONG = 1 << 20, 1 << 14
THRESHOLD = 0.7


def _rows(raw: bytes, n: int) -> np.ndarray:
    """n chunks of some bytes, each byte + 1, with 0 beyond the end."""
    line = np.zeros((n - 1) * STRIDE + CHUNK, np.int16)
    line[: len(raw)] = np.frombuffer(raw, np.uint8)
    line[: len(raw)] += 1
    return np.lib.stride_tricks.sliding_window_view(line, CHUNK)[::STRIDE]


def chunked(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All chunks of the texts, a row of bytes + 1 each with 0 beyond the end; how many each text has (at least 1); and
    the texts' bytes."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    counts = np.maximum(1, -(-np.maximum(0, sizes - (CHUNK - STRIDE)) // STRIDE))
    rows = np.zeros((int(counts.sum()), CHUNK), np.int16)
    at = 0
    for r, n in zip(raw, counts.tolist(), strict=True):
        rows[at : at + n] = _rows(r, n)
        at += n
    return rows, counts, sizes


def _windows(rows: np.ndarray) -> np.ndarray:
    """The bytes under the filters: chunk, place, byte."""
    return np.lib.stride_tricks.sliding_window_view(rows, SEEN, axis=1)[:, ::STEP]


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (257, EMBED)),
            "filters": rng.normal(0, 1 / np.sqrt(SEEN * EMBED), (SEEN * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "w1": rng.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS + 1, HIDDEN)),
            "b1": np.zeros(HIDDEN),
            "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "b2": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["embed"][0] = 0

    def _pooled(self, rows: np.ndarray, keep: bool = False):
        """The highest response of each filter in each chunk (and where, and the bytes under the filters, for learning).
        A filter sees two groups of STEP bytes: each group is multiplied once, with both halves of all filters."""
        halves = self.p["filters"].reshape(2, STEP * EMBED, FILTERS)
        groups = self.p["embed"].take(rows, axis=0).reshape(-1, STEP * EMBED)
        parts = (groups @ np.concatenate([halves[0], halves[1]], axis=1)).reshape(len(rows), PLACES + 1, 2 * FILTERS)
        response = parts[:, :-1, :FILTERS] + parts[:, 1:, FILTERS:]
        if not keep:
            return np.maximum(response.max(axis=1) + self.p["bias"], 0)
        where = response.argmax(axis=1)
        top = np.take_along_axis(response, where[:, None], 1)[:, 0] + self.p["bias"]
        return np.maximum(top, 0), where, _windows(rows)

    def _combined(self, pooled: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        first = np.cumsum(counts) - counts
        mean = np.add.reduceat(pooled, first, axis=0) / counts[:, None]
        most = np.maximum.reduceat(pooled, first, axis=0)
        features = np.concatenate([mean, most, np.log1p(sizes)[:, None] / 4], axis=1).astype(np.float32)
        hidden = np.tanh(features @ self.p["w1"] + self.p["b1"])
        return features, hidden, 1 / (1 + np.exp(-(hidden @ self.p["w2"] + self.p["b2"][0])))

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        """Scores of texts. A text of more than LONG chunks is pooled stretch by stretch, so that it is never expanded
        whole: what the hidden layer sees are sums and maxima over its chunks."""
        if not texts:
            return np.zeros(0)
        out, short = np.zeros(len(texts)), []
        for k, t in enumerate(texts):
            if len(t or "") <= LONG * STRIDE:
                short.append(k)
            else:
                out[k] = self._long(t.encode(), block)
        if short:
            rows, counts, sizes = chunked([texts[k] for k in short])
            pooled = np.concatenate([self._pooled(rows[a : a + block]) for a in range(0, len(rows), block)])
            out[short] = self._combined(pooled, counts, sizes)[2]
        return out

    def _long(self, raw: bytes, block: int) -> float:
        count, total, most = 0, np.zeros(FILTERS), np.zeros(FILTERS, np.float32)
        chunks = max(1, -(-(len(raw) - (CHUNK - STRIDE)) // STRIDE))
        for first in range(0, chunks, LONG):
            n = min(LONG, chunks - first)
            rows = _rows(raw[first * STRIDE : first * STRIDE + (n - 1) * STRIDE + CHUNK], n)
            for a in range(0, n, block):
                pooled = self._pooled(rows[a : a + block])
                total += pooled.sum(axis=0, dtype=np.float64)
                most = np.maximum(most, pooled.max(axis=0))
            count += n
        features = np.concatenate([total / count, most, [np.log1p(len(raw)) / 4]]).astype(np.float32)
        hidden = np.tanh(features @ self.p["w1"] + self.p["b1"])
        return float(1 / (1 + np.exp(-(hidden @ self.p["w2"] + self.p["b2"][0]))))

    def gradients(self, texts: list[str], truth: np.ndarray) -> dict[str, np.ndarray]:
        rows, counts, sizes = chunked(texts)
        pooled, where, window = self._pooled(rows, keep=True)
        features, hidden, score = self._combined(pooled, counts, sizes)
        g = {}
        error = ((score - truth) / len(truth)).astype(np.float32)
        g["w2"], g["b2"] = hidden.T @ error, error.sum(keepdims=True)
        back = np.outer(error, self.p["w2"]) * (1 - hidden**2)
        g["w1"], g["b1"] = features.T @ back, back.sum(axis=0)
        wide = back @ self.p["w1"].T
        of = np.repeat(np.arange(len(counts)), counts)
        chunk = (wide[:, :FILTERS] / counts[:, None])[of]
        # The maximum over chunks passes its gradient to the chunks that reach it.
        reach = pooled == features[:, FILTERS : 2 * FILTERS][of]
        chunk = chunk + wide[:, FILTERS : 2 * FILTERS][of] * reach / np.maximum(1, np.add.reduceat(reach, np.cumsum(counts) - counts, axis=0))[of]
        chunk = (chunk * (pooled > 0)).astype(np.float32)
        g["bias"] = chunk.sum(axis=0)
        g["filters"], g["embed"] = np.zeros_like(self.p["filters"]), np.zeros_like(self.p["embed"])
        for f in range(FILTERS):
            seen = window[np.arange(len(rows)), where[:, f]]
            under = self.p["embed"][seen]
            g["filters"][:, f] = np.einsum("nse,n->se", under, chunk[:, f]).ravel()
            spread = chunk[:, f][:, None, None] * self.p["filters"][:, f].reshape(SEEN, EMBED)
            for e in range(EMBED):
                g["embed"][:, e] += np.bincount(seen.ravel(), weights=spread[:, :, e].ravel(), minlength=257)
        g["embed"][0] = 0
        return g


def fit(rows: list[tuple[str, int]], counts: dict[int, int] | None = None, steps: int = 330, batch: int = 32, rate: float = 0.006, seed: int = 5) -> Network:
    """A network from (text, label) rows, by Adam over mini-batches. Both labels are drawn alike, whatever the rows hold;
    then the output's bias is moved by the logarithm of the labels' odds among all that teach (`counts`, or the rows), so
    that a score is a probability at any size of table. A label that no row has counts as half a row."""
    net = Network()
    if not rows:
        return net
    counts = counts or Counter(label for _, label in rows)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    own = [x for x in (np.array([k for k, r in enumerate(rows) if r[1] == label]) for label in (0, 1)) if len(x)]
    each = batch // len(own)
    decks = [np.zeros(0, np.int64) for _ in own]
    for step in range(1, steps + 1):
        # Each label is dealt through before any of its rows comes again.
        for k, x in enumerate(own):
            while len(decks[k]) < each:
                decks[k] = np.append(decks[k], rng.permutation(x))
        some = [rows[i] for deck in decks for i in deck[:each].tolist()]
        decks = [deck[each:] for deck in decks]
        now = rate * (1 - 0.9 * step / steps)
        for k, g in net.gradients([t for t, _ in some], np.array([x for _, x in some], np.float32)).items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    if len(own) == 2:
        net.p["b2"] += np.float32(np.log(max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5)))
    return net


def sample(docs: DataFrame, labels: DataFrame, teaches, id_col: str, text_col: str, label_col: str, each: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """About `each` rows of both labels, chosen by a hash of the id, and how many there are of each. A document with
    several labels teaches each of them."""
    marks = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("label")).where(teaches & F.col("label").isin(0, 1)).distinct()
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if not counts:
        return [], counts
    share = F.lit(False)
    for label, n in sorted(counts.items()):
        share = share | ((F.col("label") == label) & hashed_share("id", each / n))
    chosen = F.broadcast(marks.where(share))  # about 2 * each rows
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = texts.join(chosen, "id").collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (str(r["id"]), r["label"], r["text"]))], counts


def _scoring(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in batches:
            for a, b in cuts_by_bytes(batch.column("text"), PASS_BYTES, 1024):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(net.score(part.column("text").to_pylist()), pa.float64())], names=["id", "score"])

    return released(run)


def score_quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs: its id and score, the probability that its label is 1.

    A null text counts as empty; an empty one is a chunk of padding, with a score like any. Repeated rows each get the
    same score; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scoring(shared), T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])).withColumnRenamed("id", id_col)


def _held_out(column: str):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, counts = sample(docs, table(spark, sf_dir, "labels"), ~_held_out("id"), "doc_id", "text", "quality", SAMPLE_ROWS)
    found = score_quality(docs, fit(rows, counts))
    return found.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
