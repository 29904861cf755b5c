"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists, at each end, the vocabulary's pieces that end there, longest first. For each position
only the best score, the number of pieces and whether the last was unknown are carried; no path is kept and no ids are
made. Ties are the tokenizer's: of equal scores the piece that starts first stays. A character without a piece of its
own is unknown, ten below the lowest score; unknown ones in a row are one token.

Texts split before each space, so a word's count is the same wherever it stands, and a bounded memory answers for words
met before. One pass over the texts, without a shuffle.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlens.llm.common import cuts_by_bytes, quoted, released, table
from siftlens.llm.tokens import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Below the lowest score, for a character without a piece.
PENALTY = 10.0
#: Bytes of text counted at a time.
PASS_BYTES = 4 << 20
#: Words in each of a worker's two generations of memory, and the longest remembered, in characters.
REMEMBERED, LONGEST = 500_000, 48


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The pieces of a vocabulary file and their scores, taken as unigram scores. Control, unknown, unused and byte pieces
    stand for no text and are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    no_text = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size()) if not no_text(k)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.unknown = min((score for _, score in pieces), default=0.0) - PENALTY
        self.known: dict[str, tuple[int, float]] = {}
        self.older: dict[str, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """Pieces of the best way to cut a word, and its score. Only as many places are held as the longest piece has
        characters, so a word may be of any length."""
        wide = self.longest + 1
        score, count, loose = [0.0] * wide, [0] * wide, [False] * wide
        matches = self.found.iter(word)
        match = next(matches, None)
        for end in range(1, len(word) + 1):
            top, at, single = None, 0, False
            here = []
            while match is not None and match[0] == end - 1:
                here.append(match[1])
                match = next(matches, None)
            for length, own in sorted(here, reverse=True):
                single |= length == 1
                now = own + score[(end - length) % wide]
                if top is None or now > top:
                    top, at = now, end - length
            unknown = False
            if not single:
                now = self.unknown + score[(end - 1) % wide]
                if top is None or now > top:
                    top, at, unknown = now, end - 1, True
            here_count = count[at % wide] + (0 if unknown and loose[at % wide] else 1)
            score[end % wide], count[end % wide], loose[end % wide] = top, here_count, unknown
        return count[len(word) % wide], score[len(word) % wide]

    def words(self, text: str) -> list[str]:
        """The text with spaces marked and one in front, split before each mark."""
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        return marked[1:].split(SPACE) if marked[0] == SPACE else marked.split(SPACE)

    def count(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """Of each text: tokens, words, score."""
        out = []
        for text in texts:
            words = self.words(text or "")
            found = list(map(self.known.get, words))
            if None in found:
                for k, x in enumerate(found):
                    if x is None:
                        found[k] = self._new(words[k])
            out.append((sum([x[0] for x in found]), len(words), sum([x[1] for x in found], 0.0)))
        return out

    def _new(self, word: str) -> tuple[int, float]:
        if len(word) > LONGEST:
            return self.best(SPACE + word)  # not remembered
        if (ids := self.known.get(word)) is None:
            ids = self.older.get(word) or self.best(SPACE + word)
            if len(self.known) > REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[word] = ids
        return ids


_counters: dict[int, Counter] = {}

_OUT = [T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())]


def _counting(shared, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        counter = _counters[key]
        for batch in batches:
            for a, b in cuts_by_bytes(batch.column("text"), PASS_BYTES, 4096):
                part = batch.slice(a, b - a)
                tokens, words, score = map(list, zip(*counter.count(part.column("text").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(tokens, pa.int64()), pa.array(words, pa.int64()), pa.array(score, pa.float64())], names=["id", "n_tokens", "n_words", "score"])

    return released(run)


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs: its id, n_tokens, n_words (stretches between spaces) and score (of the best cuts).

    A null or empty text has none of either and score 0. Repeated rows each get the same result; other columns are not
    read."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return rows.mapInArrow(_counting(shared, hash(tuple(pieces))), T.StructType([rows.schema["id"], *_OUT])).withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), pieces_of(vocabulary_path(VOCABULARY)))
