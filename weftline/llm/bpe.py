"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

An automaton finds, in one pass over a word, the longest token that starts at
each place. The encoder takes it if it may follow the token before it (no merge
of a better rank would cross their border; answers are kept in a pair table),
else the next shorter prefix token, and steps back where none is left. Dead ends
are marked, so each place is tried once and the work is linear in the word.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import text_of

END = "</w>"
MARK = "\n"  # stands for END in the automaton; no byte is written as a line feed there
CACHED_WORDS, CACHED_PAIRS = 200_000, 400_000  # in each worker that encodes: some 80 MB at most
# The code points of Unicode white space.
# Letters and numbers of Unicode 16.0, and lower-case forms of 17.0, that Python's Unicode data (15.1) lacks.
ADDED = {
    "L": {*range(0x1C89, 0x1C8B), *range(0xA7CB, 0xA7CE), *range(0xA7DA, 0xA7DD), *range(0x105C0, 0x105F4), *range(0x10D4A, 0x10D66), *range(0x10D6F, 0x10D86), *range(0x10EC2, 0x10EC5), *range(0x11380, 0x1138A), 0x1138B, 0x1138E, *range(0x11390, 0x113B6), 0x113B7, 0x113D1, 0x113D3, *range(0x11BC0, 0x11BE1), *range(0x13460, 0x143FB), *range(0x16100, 0x1611E), *range(0x16D40, 0x16D6D), 0x18CFF, *range(0x1E5D0, 0x1E5EE), 0x1E5F0},
    "N": {*range(0x10D40, 0x10D4A), *range(0x116D0, 0x116E4), *range(0x11BF0, 0x11BFA), *range(0x16130, 0x1613A), *range(0x16D70, 0x16D7A), *range(0x1CCF0, 0x1CCFA), *range(0x1E5F1, 0x1E5FB)},
}
LOWER = {ord("Σ"): ord("σ"), 0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)}}  # a final sigma is as any other
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def letter_class(kind: str, stop: int) -> str:
    """The inside of a character class with every code point below ``stop`` whose Unicode category begins with ``kind``."""
    found = [c for c in range(stop) if unicodedata.category(chr(c))[0] == kind or c in ADDED.get(kind, ())]
    starts = [c for k, c in enumerate(found) if not k or found[k - 1] != c - 1]
    ends = [c for k, c in enumerate(found) if k + 1 == len(found) or found[k + 1] != c + 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@functools.cache
def split_patterns() -> list[re.Pattern]:
    """The pre-tokenizer's pattern, for texts of ASCII, of Latin-1 and of any letters. A contraction never begins with a letter, so letters can be tried first."""
    made = []
    for stop in (128, 256, 0x110000):
        letters, numbers = letter_class("L", stop), letter_class("N", stop)
        space = "".join(rf"\U{c:08x}" for c in SPACES if c < stop)
        made.append(re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{space}{letters}{numbers}]+"))
    return made


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def specification(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Decoder:
    """Decodes with a word-end BPE vocabulary in the tokenizers library's JSON format: all tokens in one table, each with its offset."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name
        spelled = [n.encode() + b" " for n in names]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        """The tokens, joined by spaces, in UTF-8: gathered from the table of all tokens by their offsets."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return b""
        out = []
        for part in np.array_split(i, 1 + len(i) // 500_000):
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            before = np.cumsum(size) - size
            out.append(self.blob[np.repeat(start - before, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)[:-1]


class Tokenizer(Decoder):
    """Encodes as well, by backtracking."""

    def __init__(self, spec: dict):
        super().__init__(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i = vocab[a + b]
            self.halves[i], self.joined[vocab[a], vocab[b]], self.rank[i] = (vocab[a], vocab[b]), i, rank + 1
        self.pairs: dict[tuple[int, int], bool] = {}
        whole: dict[str, int] = {}
        made: set[int] = set()
        for name, i in sorted(vocab.items(), key=lambda x: self.rank.get(x[1], 0)):
            a, b = self.halves.get(i, (i, i))
            if a == i or (a in made and b in made and self._apart(a, b, self.rank[i])):
                made.add(i)
                whole[name.removesuffix(END) + MARK if name.endswith(END) else name] = i
        self.size = dict(zip(whole.values(), map(len, whole), strict=True))
        self.shorter = {i: next((whole[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in whole), -1) for s, i in whole.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in whole.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.ascii, self.latin, self.any = (x.findall for x in split_patterns())
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.words: dict[str, bytes] = {}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether merges of a rank below ``limit`` leave the border between tokens a and b standing.

        Merges near the border are undone from the latest to the earliest; the pair
        at the border at each moment must not merge sooner than either side was made.
        """
        rank, joined, halves = self.rank, self.joined, self.halves
        while True:
            i = joined.get((a, b))
            if i is not None and rank[i] < limit:
                return False
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            if not ra and not rb:
                return True
            if ra > rb:  # the left token is the later one
                limit, a = ra, halves[a][1]
            else:  # of merges of one rank the left one is made first
                limit, b = rb + 1, halves[b][0]

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.pairs[a, b] = self._apart(a, b, len(self.rank) + 2)
        return known

    def word(self, word: str) -> list[int]:
        s = "".join(map(self.letters.__getitem__, word.encode())) + MARK
        n, size, shorter, pairs = len(s), self.size, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, (length, token) in self.automaton.iter(s):  # of one start, longer matches end later
            longest[end - length + 1] = token
        alive, taken, at, token, last = [True] * (n + 1), [], 0, longest[0], -1
        while at < n:
            while token >= 0:
                if alive[at + size[token]]:
                    fits = last < 0 or pairs.get((last, token))
                    if fits is None:
                        fits = self._may_follow(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                last = token
                at += size[token]
                token = longest[at]
            elif taken:
                alive[at] = False
                token = taken.pop()
                last = taken[-1] if taken else -1
                at -= size[token]
            else:
                raise ValueError(f"the vocabulary can't spell {word!r}")
        return taken

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = self.ascii(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            latin = is_latin(text)
            words = self.latin(text.lower()) if latin else self.any(text.translate(LOWER).lower())
        found = list(map(self.words.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self._word_ids(words[k])
        return b"".join(found)

    def _word_ids(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            ids = self.words[word] = struct.pack(f"<{len(taken := self.word(word))}I", *taken)
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.at_special is None or "<|" not in text:
            return self._plain(text)
        parts = self.at_special.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self._plain(p) for k, p in enumerate(parts))


@functools.lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(specification(path))


@functools.lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(specification(path))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), one row for each row of documents (doc_id, text; others are ignored).

    Null and empty texts have no ids; repeated rows and null ids each give their row. ``path``
    is the vocabulary's file, at the same place on every worker.
    """

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            ids = pa.array([t.encode(x.as_py() or "") for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text of the rows of ``encode``; null ids decode to an empty text."""

    def run(batches):
        t = decoder(path)
        for b in batches:
            text = pa.array([t.decode(x.as_py() or b"") for x in b.column(1)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def report(documents: DataFrame, path: str) -> DataFrame:
    """Per row of documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    back = decode(encode(documents, path), path)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
