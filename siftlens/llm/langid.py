"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams, its affixes (n-grams that touch the word's edge) and, for words that are
frequent in the sample, the word itself (lexicon). Features are hashed into one table of weights, a column for each
language; transitions between the languages of neighbouring words are learned with them, from sequences in which pieces
of different documents follow each other, as in code-switched text. Forward-backward gives each word's probabilities;
a document's language is the one with the highest mean over its words.

The field is fitted on the driver, on a sample whose size is a parameter; every document is labelled over its whole
text, in one pass without a shuffle, vectorised over the words of many documents.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlens.llm.common import cuts_by_bytes, quoted, released, table, text_of, unpacked, whole

#: Expected documents of each language in the sample, how much of a text is taken for it in characters, and the most
#: languages that are learned: together the bound of what the driver fits on.
SAMPLE_DOCS, SAMPLE_CHARS, LANGS = 300, 20_000, 200
#: Rows of the weight table; frequent words of each language in the lexicon; characters whose features are
#: made at a time; bytes of texts whose words are labelled in step.
SLOTS, LEXICON, CHUNK, BATCH_BYTES = 1 << 17, 2_000, 1 << 18, 4 << 20
UNDETERMINED = "und"

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_EDGE = np.uint64(1)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def _is_letter(points: np.ndarray) -> np.ndarray:
    out = _letters()[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        high = points > 0xFFFF
        found, back = np.unique(points[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in found.tolist()])[back]
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * _K[1]
    return ((hashes ^ (hashes >> np.uint64(29))) & np.uint64(SLOTS - 1)).astype(np.int64)


class Words:
    """The words of some text: for each the slots of its features, as flat arrays with the places of the first."""

    def __init__(self, text: str, lexicon: np.ndarray | None):
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        inside = np.concatenate([[False], _is_letter(points), [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, ends = turns[::2], turns[1::2]
        self.sizes = ends - self.starts
        self.n = len(self.sizes)
        if not self.n:
            return
        # Words in a row, an edge mark before each and one at the end.
        wide = self.sizes + 1
        total = int(wide.sum())
        first = np.cumsum(wide) - wide
        at = np.repeat(self.starts - first - 1, wide) + np.arange(total)
        row = points[np.maximum(at, 0)].astype(np.uint64) + np.uint64(2)
        row[first] = _EDGE
        row = np.append(row, [_EDGE, _EDGE, _EDGE])
        edge = row == _EDGE
        one, two, three, four = (row[k : k + total] * _K[k] for k in range(4))
        e1, e2, e3 = edge[1 : total + 1], edge[2 : total + 2], edge[3 : total + 3]
        e0 = edge[:total]
        pair = one + two
        triple = pair + three
        # An n-gram may touch an edge with its ends only; four letters count at edges only.
        grams = [
            (~(e0 & e1), pair),
            (~e1 & ~(e0 & e2), triple * _K[2]),
            (~e1 & ~e2 & (e0 | e3), (triple + four) * _K[3]),
        ]
        word = np.add.reduceat(_mix(row[:total] + (np.arange(total) - np.repeat(first, wide)).astype(np.uint64) * _K[0]), first)
        self.hash = _mix(word)
        of = np.repeat(np.arange(self.n), wide)
        self.grams = [(of[keep], _slots(value[keep])) for keep, value in grams]
        if lexicon is not None and len(lexicon):
            place = np.minimum(np.searchsorted(lexicon, self.hash), len(lexicon) - 1)
            known = np.flatnonzero(lexicon[place] == self.hash)
            self.grams.append((known, _slots(self.hash[known] * _K[1])))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]), np.float32)
        for of, slot in self.grams:
            if len(of):
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                out[of[first]] += np.add.reduceat(weights[slot], first, axis=0)
        return out

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all words in order, and how many each has."""
        of = np.concatenate([g[0] for g in self.grams])
        slot = np.concatenate([g[1] for g in self.grams])
        order = np.argsort(of, kind="stable")
        return slot[order], np.bincount(of, minlength=self.n)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    return x ^ (x >> np.uint64(27))


def _pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """A long text in pieces that end between words."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


class Field:
    """Weights of the features, transitions, and the languages they are for."""

    def __init__(self, langs: list[str], weights: np.ndarray, steps: np.ndarray, lexicon: np.ndarray):
        self.langs, self.weights, self.steps, self.lexicon = langs, weights, steps, lexicon

    def label(self, texts: list[str | None]) -> list[tuple[str, float, int, int, np.ndarray]]:
        """Of each text: language, its mean probability, words, changes of language, all means."""
        none = (UNDETERMINED, 0.0, 0, 0, np.zeros(len(self.langs)))
        if not self.langs:
            return [none] * len(texts)
        scores, sizes = [], np.zeros(len(texts), np.int64)
        held, budget = [], 0

        def work() -> None:
            if held:
                words = Words("\x00".join(t for _, t in held), self.lexicon)
                if words.n:
                    ends = np.cumsum([len(t.lower()) + 1 for _, t in held])
                    of = np.searchsorted(ends, words.starts, side="right")
                    np.add.at(sizes, np.array([k for k, _ in held])[of], 1)
                    scores.append(words.scores(self.weights))
                held.clear()

        for k, text in enumerate(texts):
            for piece in _pieces(text or ""):
                held.append((k, piece))
                budget += len(piece)
                if budget >= CHUNK:
                    work()
                    budget = 0
        work()
        if not scores:
            return [none] * len(texts)
        probabilities = forward_backward(np.concatenate(scores), sizes, self.steps)
        first = np.cumsum(sizes) - sizes
        best = probabilities.argmax(axis=1)
        turns = np.concatenate([[0], np.cumsum(best[1:] != best[:-1])])
        out = []
        for k in range(len(texts)):
            if not sizes[k]:
                out.append(none)
                continue
            means = probabilities[first[k] : first[k] + sizes[k]].mean(axis=0, dtype=np.float64)
            top = int(means.argmax())
            out.append((self.langs[top], min(1.0, float(means[top])), int(sizes[k]), int(turns[first[k] + sizes[k] - 1] - turns[first[k]]), means))
        return out


def forward_backward(scores: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Probabilities of the labels of each word. scores: the words of all sequences in a row; sizes: words of each."""
    order = np.argsort(-sizes, kind="stable")
    first, long_ = (np.cumsum(sizes) - sizes)[order], sizes[order]
    local = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-30)
    move = np.exp(steps - steps.max()).astype(np.float32)
    back = np.ascontiguousarray(move.T)
    ahead, behind = np.empty_like(local), np.empty_like(local)
    most = int(long_[0]) if len(long_) else 0
    open_ = np.searchsorted(-long_, -np.arange(most), side="left")  # sequences with more than t words
    carry = np.ones((len(long_), local.shape[1]), np.float32)
    for t in range(most):
        n = open_[t]
        at = first[:n] + t
        carry = (carry[:n] @ move if t else carry[:n]) * local[at]
        carry /= carry.sum(axis=1, keepdims=True)
        ahead[at] = carry
    carry = np.zeros((0, local.shape[1]), np.float32)
    for t in range(most - 1, -1, -1):
        n = open_[t]
        at = first[:n] + t
        grown = np.ones((n, local.shape[1]), np.float32)
        if len(carry):
            grown[: len(carry)] = carry
        behind[at] = grown
        carry = (grown * local[at]) @ back
        carry /= carry.sum(axis=1, keepdims=True)
    out = ahead * behind
    return out / out.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], rounds: int = 160, batch: int = 256, piece: int = 8, pieces: int = 3, seed: int = 7) -> Field:
    """A field from (language, text) rows: stochastic gradients of the sequences' log-likelihood, with steps that adapt
    to each weight. A row of fewer words than a piece is said over and over until it fills one; rows of no words teach
    nothing."""
    langs = sorted({lang for lang, _ in rows})
    label = {lang: k for k, lang in enumerate(langs)}
    counts: list[dict[int, int]] = [{} for _ in langs]
    for lang, text in rows:
        words = Words(text, None)
        if words.n:
            for h, c in zip(*(x.tolist() for x in np.unique(words.hash, return_counts=True)), strict=True):
                counts[label[lang]][h] = counts[label[lang]].get(h, 0) + c
    frequent = {h for own in counts for h, c in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if c > 2}
    lexicon = np.array(sorted(frequent), np.uint64)
    slots, sizes, tags, room = [], [], [], []
    for lang, text in rows:
        words = Words(text, lexicon)
        if words.n:
            slot, size = words.flat()
            times = -(-piece // words.n) if words.n < piece else 1
            slots.append(np.tile(slot.astype(np.int32), times))
            sizes.append(np.tile(size, times))
            n = words.n * times
            tags.append(np.full(n, label[lang]))
            room.append(np.arange(n) <= n - piece)
    weights, steps = np.zeros((SLOTS, len(langs)), np.float32), np.zeros((len(langs), len(langs)), np.float32)
    if not slots:
        return Field([], weights, steps, lexicon)
    slot, size, tag = np.concatenate(slots), np.concatenate(sizes), np.concatenate(tags)
    begin = np.cumsum(size) - size
    room_at = np.flatnonzero(np.concatenate(room))
    by_tag = [room_at[tag[room_at] == k] for k in range(len(langs))]
    by_tag = [x for x in by_tag if len(x)]
    rng = np.random.default_rng(seed)
    seen_w, seen_s = np.full_like(weights, 1e-2), np.full_like(steps, 1e-2)
    length = piece * pieces
    for _ in range(rounds):
        # Sequences of pieces: each language as likely as another; the next piece mostly goes on in the same one.
        which = rng.integers(len(by_tag), size=(batch, pieces))
        for k in range(1, pieces):
            stay = rng.random(batch) < 0.7
            which[stay, k] = which[stay, k - 1]
        start = np.empty((batch, pieces), np.int64)
        for k, own in enumerate(by_tag):
            here = which == k
            start[here] = own[rng.integers(len(own), size=int(here.sum()))]
        at = (start[:, :, None] + np.arange(piece)).reshape(batch, length)
        flat = at.ravel()
        n = size[flat]
        index = np.repeat(begin[flat] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        used = slot[index]
        scores = np.add.reduceat(weights[used], np.cumsum(n) - n, axis=0)
        truth = tag[at]
        local = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(batch, length, -1) + 1e-30
        move = np.exp(steps - steps.max())
        ahead, behind = np.empty_like(local), np.ones_like(local)
        carry = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
        ahead[:, 0] = carry
        for t in range(1, length):
            carry = (carry @ move) * local[:, t]
            carry /= carry.sum(axis=1, keepdims=True)
            ahead[:, t] = carry
        for t in range(length - 2, -1, -1):
            carry = (behind[:, t + 1] * local[:, t + 1]) @ move.T
            behind[:, t] = carry / carry.sum(axis=1, keepdims=True)
        both = ahead * behind
        both /= both.sum(axis=2, keepdims=True)
        error = both.copy()
        np.put_along_axis(error, truth[:, :, None], np.take_along_axis(both, truth[:, :, None], 2) - 1, 2)
        joint = ahead[:, :-1, :, None] * move * (behind[:, 1:] * local[:, 1:])[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        grown = joint.sum(axis=(0, 1))
        np.add.at(grown, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), -1)
        error = np.repeat(error.reshape(batch * length, -1), n, axis=0)
        for k in range(len(langs)):
            g = np.bincount(used, weights=error[:, k], minlength=SLOTS) / batch + 1e-6 * weights[:, k]
            seen_w[:, k] += g * g
            weights[:, k] -= 0.15 * g / np.sqrt(seen_w[:, k])
        grown = grown / (batch * length) + 1e-3 * steps
        seen_s += grown * grown
        steps -= (0.1 * grown / np.sqrt(seen_s)).astype(np.float32)
    return Field(langs, weights, steps, lexicon)


def sample(docs: DataFrame, teaches, id_col: str, text_col: str, lang_col: str, each: int) -> list[tuple[str, str]]:
    """About `each` (language, text) rows of every one of the most frequent LANGS languages, chosen by a hash of the whole
    row among those that may teach, so that rows that share an id are not chosen together. A language all of whose texts
    are long teaches with these all the same, cut to their first SAMPLE_CHARS characters."""
    known = docs.select(quoted(id_col).alias("id"), F.substring(quoted(text_col), 1, SAMPLE_CHARS).alias("text"), quoted(lang_col).alias("lang")).where(teaches)
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    if not counts:
        return []
    shares = known.sparkSession.createDataFrame([(lang, each / n) for lang, n in counts.items()], "lang string, share double")
    span = F.lit(float(1 << 40))
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) < F.col("share") * span
    rows = known.join(F.broadcast(shares), "lang").where(drawn).dropDuplicates(["lang", "text"]).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], str(r["id"]), r["text"]))]


_OUT = [
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()),
    T.StructField("switches", T.LongType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType())),
]


def _labelling(shared, at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for batch in batches:
            texts = text_of(batch, "own" if at is not None else "text", at)
            for a, b in cuts_by_bytes(texts, BATCH_BYTES, 4096):
                found = field.label(texts.slice(a, b - a).to_pylist())
                shares = [list(zip(field.langs, map(float, x[4]), strict=True)) if x[2] else [] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("own").slice(a, b - a), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                    names=["own", "lang_pred", "score", "n_words", "switches", "shares"],
                )

    return released(run)


def identify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Each row of docs: its id (with keep, the whole row as struct `row` instead), lang_pred, score, n_words, switches
    (places where the likeliest language of a word changes) and shares (mean probability of each language).

    A null text, or one without a letter, is `und` with score 0 and no shares; so is every text where no row could
    teach. Equal scores go to the language first in order. Repeated rows each get their result, an empty table gives no
    rows; other columns are not read, but with keep."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(whole(docs).alias("own")) if keep else docs.select(quoted(id_col).alias("own"), quoted(text_col).alias("text"))
    found = rows.mapInArrow(_labelling(shared, docs.columns.index(text_col) if keep else None), T.StructType([rows.schema["own"], *_OUT]))
    return found.withColumnRenamed("own", "row" if keep else id_col)


def _held_out(column: str):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _fitted(docs: DataFrame) -> Field:
    return fit(sample(docs, ~_held_out("id"), "doc_id", "text", "lang", SAMPLE_DOCS))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, _fitted(docs))
    return found.select("doc_id", _held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_words", "switches")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have a language: those without a letter go. A text that switches between languages has one
    all the same, however small its largest share. Where no row could teach, nothing is judged and all stay. Repeated
    rows are judged each; a row goes through the pass once, as one struct."""
    field = _fitted(docs)
    if not field.langs:
        return docs
    found = identify(docs, field, keep=True)
    return unpacked(found.where(F.col("lang_pred") != UNDETERMINED), docs)
