"""BPE encoding and decoding of whole texts with a public word-BPE vocabulary.

The vocabulary is a tokenizer file of the ``word_bpe_49k.json`` kind: added
tokens that match the raw text, then NFC, white-space collapse and lower case,
then a split into words, a byte alphabet, and merges with a word-end suffix.

A word is merged over contiguous arrays: one holds the parts between the
boundaries that are left, one the rank of every adjacent pair.  The least rank
is searched by a scan, its boundary deleted, and the two ranks beside it
looked up again.  Words of more than ``SHORT`` symbols, for which scanning
would take quadratic time, go through a heap over the same pairs and give the
same parts.  Finished words are kept in a cache of bounded size.

Letters, numbers, case and NFC are those of the library, each of its parts
with a Unicode version of its own: classes of 16.0, lower case of 17.0, NFC of
9.0 (later marks are never moved or composed).  Code points on which Python or
``regex`` disagree are found once a worker; only texts that hold one take the
slower way with explicit classes.  Decoding goes from the ids alone.

Defined results: null is an empty text; an empty text has no ids and decodes
to ''; equal texts give equal rows, repeated rows and null ids stay rows; texts
of any length are taken whole; an empty table gives an empty result; other
columns are ignored.  Lone surrogates do not occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

VOCABULARY = "word_bpe_49k.json"
#: Symbols up to which a word is merged by scanning.
SHORT = 192
#: Words kept per Python worker, in each of two halves.
CACHED_WORDS = 50_000

# The white space that the tokenizer file's \s stands for.
SPACE = "\t-\r \x85\xa0  -     　"

# Letters and numbers that Unicode 16.0 has beyond 15.1, first and last of each run.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Lower case that Unicode 17.0 has beyond 15.1.
LOWER_17 = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
# Combining marks (and one composed vowel sign with its second part) that Unicode has since 10.0.
MARKS_SINCE_10 = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF),
    (0x1E4EC, 0x1E4EF),
)
#: Below this code point Python, ``regex`` and the library agree.
FIRST_ODD = 0x530

_NO_RANK = 1 << 60


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> list[str]:
    """Printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Unicode(NamedTuple):
    """The library's classes, and where they differ from those of Python and ``regex``."""

    odd: np.ndarray  # by code point
    letters: str  # as ranges of a character class
    numbers: str
    late_marks: re.Pattern


def _ranges(member: np.ndarray) -> str:
    edges = np.flatnonzero(np.diff(np.r_[False, member, False]))
    return "".join(rf"\U{a:08x}-\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))


@lru_cache(maxsize=1)
def _unicode() -> _Unicode:
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in codes], dtype=np.uint8)
    everything = "".join(map(chr, codes))
    odd, classes = np.zeros(0x110000, dtype=bool), []
    for kind, added in (("L", LETTERS_16), ("N", NUMBERS_16)):
        own = np.zeros(0x110000, dtype=bool)
        own[codes] = kinds == ord(kind)
        for first, last in added:
            own[first : last + 1] = True
        theirs = np.zeros(0x110000, dtype=bool)
        theirs[[ord(c) for c in regex.findall(rf"\p{{{kind}}}", everything)]] = True
        odd |= own != theirs
        classes.append(_ranges(own))
    odd[list(LOWER_17)] = True
    for first, last in MARKS_SINCE_10:
        odd[first : last + 1] = True
    marks = "".join(rf"\U{first:08x}-\U{last:08x}" for first, last in MARKS_SINCE_10)
    return _Unicode(odd, classes[0], classes[1], re.compile(f"([{marks}])"))


class WordBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **added}.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: (left id, right id) -> (rank, id of both)
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        alphabet = _byte_alphabet()
        self.inner = [self.ids[c] for c in alphabet]
        self.final = [self.ids[c + self.suffix] for c in alphabet]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = pattern.replace(r"[^\s", f"[^{SPACE}")
        self.words = regex.compile(self.pattern)
        self.odd_words: re.Pattern | None = None
        self.added = added
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        #: word -> its ids, and the same as decimal text
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank = lambda a, b: self.merges.get((a, b), (_NO_RANK,))[0]
        ranks = list(map(rank, parts, parts[1:]))
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = self.merges[parts[at], parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at], parts[at + 1])
            if at:
                ranks[at - 1] = rank(parts[at - 1], parts[at])
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        found = self.merges.get
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := found((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = found((a, b))[1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (m := found((parts[left], parts[right]))):
                    heapq.heappush(heap, (m[0], left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> tuple[tuple[int, ...], str]:
        made = self.older.get(word)
        if not made:
            parts = self.merge(word)
            made = tuple(parts), " ".join(map(str, parts))
        if len(word) <= 64:
            if len(self.known) >= CACHED_WORDS:  # words in use come back from the older half
                self.older, known = self.known.copy(), self.known
                known.clear()
            self.known[word] = made
        return made

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens.  White space needs no collapse: no word holds any."""
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            if codes.max() >= FIRST_ODD and _unicode().odd[codes].any():
                return self._split_odd(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each sigma by itself
        return self.words.findall(text.lower())

    def _split_odd(self, text: str) -> list[str]:
        """The same for a text with code points that Python or ``regex`` treats otherwise than the library."""
        own = _unicode()
        if not self.odd_words:
            self.odd_words = re.compile(self.pattern.replace(r"\p{L}", own.letters).replace(r"\p{N}", own.numbers))
        pieces = own.late_marks.split(text)  # to the library's NFC these marks are letters
        pieces[::2] = [unicodedata.normalize("NFC", piece) for piece in pieces[::2]]
        return self.odd_words.findall("".join(pieces).replace("Σ", "σ").translate(LOWER_17).lower())

    def _pieces(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        known, make = self.known.get, self._word
        if not self.special or not self.special.search(text):
            return [known(word) or make(word) for word in self.split(text)]
        made, at = [], 0
        for found in self.special.finditer(text):
            made += [known(word) or make(word) for word in self.split(text[at : found.start()])]
            made.append(((self.added[found[0]],), str(self.added[found[0]])))
            at = found.end()
        return made + [known(word) or make(word) for word in self.split(text[at:])]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return [i for ids, _ in self._pieces(text or "") for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids`` joined by a space; unknown ids are left out."""
        return " ".join(filter(None, map(self.tokens.get, ids)))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them."""
        pieces = self._pieces(text or "")
        ids = [i for own, _ in pieces for i in own]
        written = " ".join([text for _, text in pieces])
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode("utf-8")).hexdigest()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""

    def run(batches):
        bpe = tokenizer(path or vocabulary_path())
        for part in slices(batches, text="text"):
            rows = [bpe.digest(t) for t in part.column("text").to_pylist()]
            n, ids, decoded = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids themselves, for training."""

    def run(batches):
        bpe = tokenizer(path or vocabulary_path())
        for part in slices(batches, text="text"):
            rows = [bpe.encode(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded: the text that a row's ids decode to; null ids decode to ''."""

    def run(batches):
        bpe = tokenizer(path or vocabulary_path())
        for part in slices(batches, text="ids"):
            rows = [bpe.decode(i or []) for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.string())], ["doc_id", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, decoded string")
