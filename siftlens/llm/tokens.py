"""Token ids of whole texts by the tokenizers library, with a bounded memory of the stretches met before.

Both vocabularies split a text before they merge, and never merge across a space that follows a non-space. So a text's
ids are the ids of its stretches between such spaces; each new stretch goes to the library, one met before to a
dictionary. Texts where a space stands between white space go to the library whole, as do texts that hold a special
token's string, which the library gives that token's id.

Both vocabularies' expressions also part Latin letters from punctuation without apostrophes, and either from a line's
end. So a new stretch of nothing else is the sum of such pieces, most of which are known; and pieces of letters, which the
expressions take whole, go to the library many to a text, parted at spaces only.

Where the vocabulary drops white space, whole arrays of texts are cut as bytes and each different stretch is looked up once.
"""

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches in each of a worker's two generations of memory, and the longest remembered, in characters.
REMEMBERED, LONGEST = 700_000, 48

#: A space between white space: where the pieces depend on the whole run.
_RUN = re.compile(r" (?<=\s )\s")
#: Pieces that are encoded as one text.
JOINED = 100
#: Punctuation, but the bar of special tokens; the last of the letters of Latin, and one that is two in lower case.
_MARKS, _LATIN, _TWO = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~", "\u024f", "\u0130"
_BARE = re.compile(r"[ \n]+")
#: By byte: ASCII letters and digits.
_ALNUM = np.array([bytes([x]).isalnum() for x in range(256)])


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies, as the installed package says."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _is_word(x: str) -> bool:
    """Latin letters alone, which both vocabularies' expressions take whole."""
    return x.isalpha() and (x.isascii() or (max(x) <= _LATIN and _TWO not in x))


def _split(words: pa.Array) -> list[str]:
    """Texts that hold one space each, at their end."""
    if not len(words):
        return []
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    return words.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes().decode().split(" ")[:-1]


class Encoder:
    """Ids of texts. spaces: whether a stretch keeps the space before it (byte-level vocabularies) or white space is
    dropped by the vocabulary."""

    def __init__(self, path: str, spaces: bool, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaces, self.remembered = spaces, remembered
        self.cuts = all("|" in x for x in self.special)
        self.parted = self._parting(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.edges = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin a piece after a space, or end a piece
        self.edges[[i for piece, i in vocabulary.items() if (piece[:1] == "\u0120" if spaces else piece[-4:] == "</w>")]] = True
        self.line = vocabulary.get("\u010a", -1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _stretches(self, text: str) -> list[str]:
        """Where spaces count, a stretch stands for itself with the space before it; a first one, which has none, is
        told by a space in front."""
        if any(x in text for x in self.special):
            return [" " + text if self.spaces else text]
        if not self.spaces:
            return [x for x in _BARE.split(text) if x]
        if _RUN.search(text):
            return [" " + text]
        out = text.split(" ")
        out[0] = " " + out[0]
        return out

    def _spoken(self, stretch: str) -> str:
        return stretch if not self.spaces else stretch[1:] if stretch[:1] == " " else " " + stretch

    def _parting(self, path: str):
        """The library's tokenizer with the same vocabulary, which takes what stands between spaces whole."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        out = Tokenizer.from_file(path)
        by_space = pre_tokenizers.Split(" ", "merged_with_next") if self.spaces else pre_tokenizers.WhitespaceSplit()
        out.pre_tokenizer = pre_tokenizers.Sequence([by_space, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if not self.spaces:
            out.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        return out

    def _cut(self, stretch: str) -> tuple[str, ...] | None:
        """A stretch's pieces, as stretches: words with punctuation after them, of lines of one each."""
        out: list[str] = []
        for k, line in enumerate(stretch.split("\n")):
            word = line.rstrip(_MARKS)
            if not _is_word(word if k or word[:1] != " " else word[1:]):
                return None
            out += [word] if not k else [" \n", " " + word]
            if len(word) < len(line):
                out.append(" " + line[len(word) :] if self.spaces else line[len(word) :])
        return tuple(out)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of stretches from the library; those of a usual length are remembered."""
        cut: dict[str, tuple[str, ...]] = {}
        if self.cuts:
            cut = {x: pieces for x in new if (not self.spaces or "\n" in x) and not x.isalpha() and (pieces := self._cut(x)) and len(pieces) > 1}
        pieces = {x for some in cut.values() for x in some}
        found = {x: ids for x in pieces if (ids := self.known.get(x) or self.older.get(x))}
        absent = [*(x for x in new if x not in cut), *(pieces - found.keys()).difference(new)]
        found |= self._learn_joined([x for x in absent if _is_word(x)], self.parted, " ")
        if self.spaces:
            found |= self._learn_joined([x for x in absent if x[:1] == " " and _is_word(x[1:])], self.library, "\n")
            found |= self._learn_joined([x for x in absent if x not in found and x[:1] != " " and x.split() == [x]], self.library, " ")
        absent = [x for x in absent if x not in found]
        for at in range(0, len(absent), 20_000):
            some = absent[at : at + 20_000]
            for x, e in zip(some, self.library.encode_batch_fast(list(map(self._spoken, some)), add_special_tokens=False), strict=True):
                found[x] = array("I", e.ids).tobytes()
        found.update((x, b"".join([found[y] for y in some])) for x, some in cut.items())
        self._remember(found)
        return found

    def _learn_joined(self, some: list[str], library, by: str) -> dict[str, bytes]:
        """The ids of stretches, many to a text: a piece that begins with a space begins one, or one that ends a word ends
        it, or ends of lines, which are dropped, part them. Those of a text with another number of such pieces are left out."""
        found: dict[str, bytes] = {}
        groups = [some[at : at + JOINED] for at in range(0, len(some), JOINED)]
        for at in range(0, len(groups), 200):
            held = groups[at : at + 200]
            texts = ["\n" + "\n".join([x[1:] for x in g]) if by == "\n" else (" " if self.spaces else "") + " ".join(g) for g in held]
            for group, e in zip(held, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                edges = np.flatnonzero(ids == self.line if by == "\n" else self.edges[ids])
                if len(edges) == len(group):
                    starts, ends = (edges.tolist(), [*edges[1:].tolist(), len(ids)]) if self.spaces else ([0, *(edges[:-1] + 1).tolist()], (edges + 1).tolist())
                    raw = ids.tobytes()
                    found.update((x, raw[4 * (a + (by == "\n")) : 4 * b]) for x, a, b in zip(group, starts, ends, strict=True))
        return found

    def _remember(self, found: dict[str, bytes]) -> None:
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        if found and max(map(len, found)) > LONGEST:
            found = {x: ids for x, ids in found.items() if len(x) <= LONGEST}
        self.known.update(found)

    def _met(self, absent: list[str]) -> dict[str, bytes]:
        """The ids of stretches that are not in the younger memory."""
        here = {x: ids for x in absent if (ids := self.older.get(x)) is not None}
        self._remember(here)
        here |= self._learn([x for x in absent if x not in here])
        return here

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers; null counts as empty."""
        parts = [self._stretches(t) if t else [] for t in texts]
        looked = [list(map(self.known.get, p)) for p in parts]
        absent = {x for p, found in zip(parts, looked, strict=True) if None in found for x, ids in zip(p, found, strict=True) if ids is None}
        if absent:
            here = self._met(list(absent))
            for p, found in zip(parts, looked, strict=True):
                if None in found:
                    found[:] = [here[x] if ids is None else ids for x, ids in zip(p, found, strict=True)]
        return [np.frombuffer(b"".join(found), "<u4") for found in looked]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's; null counts as empty. For vocabularies that drop
        white space: each different stretch of an array is looked up once. Texts that hold a special token's string, in
        either case, are encoded apart."""
        assert not self.spaces
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.zeros(len(texts), bool)
        for x in self.special:
            whole |= pc.match_substring(texts, x, ignore_case=True).to_numpy(zero_copy_only=False)
        apart = self.encode(texts.filter(pa.array(whole)).to_pylist())
        if apart:
            texts = pc.if_else(pa.array(whole), "", texts)
        flat, rows = self._parted_bytes(texts)
        cuts = np.flatnonzero(flat == 32) + 1
        words = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.concatenate([[0], cuts]).astype(np.int32)), pa.py_buffer(flat)).dictionary_encode()
        names = _split(words.dictionary)
        found = list(map(self.known.get, names))
        if absent := [x for x, ids in zip(names, found, strict=True) if ids is None]:
            here = self._met(absent)
            found = [here[x] if ids is None else ids for x, ids in zip(names, found, strict=True)]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        begins, which = np.cumsum(sizes, dtype=np.int32) - sizes, words.indices.to_numpy()
        own = sizes[which]
        ends = np.cumsum(own, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(total, dtype=np.int32) + np.repeat(begins[which] - (ends - own), own)]
        counts = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.searchsorted(cuts, rows, side="right")])])
        if apart:
            each = np.split(ids, np.cumsum(counts)[:-1])
            for k, x in zip(np.flatnonzero(whole).tolist(), apart, strict=True):
                each[k], counts[k] = x, len(x)
            ids = np.concatenate(each)
        return ids, counts

    @staticmethod
    def _parted_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts, each stretch with a space after it, and where each text ends.

        A full stop or comma between an ASCII letter or digit and white space is a piece of its own, and so becomes a
        stretch. A-Z is lowered as the vocabulary lowers it, but before a character beyond ASCII, which might be composed
        with the letter first."""
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at[1:] - at[0]
        after = np.append(data[1:], np.uint8(32))
        data = data + (((data - np.uint8(65)) < 26) & (after < 128)).view(np.uint8) * np.uint8(32)
        marks = np.flatnonzero((data == 46) | (data == 44))
        marks = marks[marks > 0]
        marks = marks[_ALNUM[data[marks - 1]] & ((after[marks] == 32) | (after[marks] == 10))]
        flat = np.insert(data, np.concatenate([marks, at]), np.uint8(32))
        flat[flat == 10] = 32
        return flat, at + np.searchsorted(marks, at) + np.arange(1, len(at) + 1)


_encoders: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, spaces: bool, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker process: the last that was asked for."""
    key = (path, spaces, remembered)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders.clear()
        _encoders[key] = Encoder(path, spaces, remembered)
    return _encoders[key]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
