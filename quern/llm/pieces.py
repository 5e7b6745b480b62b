"""Tokenising texts by chunks that no token crosses, with a bounded cache.

Chunks repeat (they are words), so most ids come from the cache and only new
chunks go to the tokenizer, in batches.
"""

from __future__ import annotations

import os
import re
from itertools import chain
from unicodedata import is_normalized

import numpy as np

from quern.llm.common import holder, word_hashes

CACHE_CHUNKS = 300_000  # about 60 MB a worker
KNOWN_WORDS = 1_500_000  # about 60 MB a worker
TEXT_CHARS = 1_500_000  # texts handled at once


class ChunkCache:
    """ids of chunks as little-endian 32-bit bytes; emptied when full."""

    def __init__(self, encode, limit: int = CACHE_CHUNKS):
        self.encode, self.limit = encode, limit
        self.ids: dict[str, bytes] = {}

    def texts(self, chunked: list[list[str]]) -> list[bytes]:
        seen = set()
        for chunks in chunked:
            seen.update(chunks)
        ids = self.ids
        new = [c for c in seen if c not in ids]
        if len(ids) + len(new) > self.limit:
            ids.clear()
            new = list(seen)
        for c, i in zip(new, self.encode(new), strict=True):
            ids[c] = np.asarray(i, "<u4").tobytes()
        get = ids.__getitem__
        return [b"".join(map(get, chunks)) for chunks in chunked]


def in_turns(texts: list[str], size: int = TEXT_CHARS):
    """Index ranges whose texts have about ``size`` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


# ------------------------------------------------------- lower-case word BPE

_words: dict = {}
holder("packing", _words.clear)
_MARKS = ".,!?;:#$%&*|<>"


def word_parts(chunk: str) -> tuple[str, str]:
    """Word and marks after it. After a letter or digit a run of marks is a token of its own, and case does not count."""
    head = chunk.rstrip(_MARKS)
    # "<|" may be a special token; a capital that lowers to a letter and a mark has that mark in one token with those after it.
    if not head or not head[-1].isalnum() or not head[-1].lower()[-1].isalnum() or "<|" in chunk:
        head = chunk
    return head.lower() if head.isascii() and head is not chunk or chunk.isalpha() and chunk.isascii() else head, chunk[len(head) :]


def word_ids(path: str) -> WordIds:
    """For the word-end BPE: blanks end every token, so blanks part words."""
    if path not in _words:
        # A task has one core; more threads would only wait for each other over short words.
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        # Of lower-case ASCII letters alone, nothing is normalised or split.
        bare = Tokenizer.from_file(path)
        bare.normalizer = bare.pre_tokenizer = None
        _words[path] = WordIds(Tokenizer.from_file(path), bare)
    return _words[path]


def plain(text: str) -> str:
    """The text in lower case where the tokenizer's own lowering would give the same, else as it is."""
    if "<|" not in text and "Σ" not in text:
        low = text.lower()
        if text.isascii() or (is_normalized("NFC", text) and is_normalized("NFC", low)):
            return low
    return text


class WordIds:
    """ids of texts whose words are tokenised apart. Words are known by 64-bit hashes in sorted arrays, emptied when full.

    Only the distinct words of a turn that aren't known yet become strings and go to the tokenizer.
    """

    def __init__(self, tokenizer, bare, limit: int = KNOWN_WORDS):
        self.tokenizer, self.bare, self.limit = tokenizer, bare, limit
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros((0, 2), np.int64)  # of each hash: where its ids start in ids, and how many
        self.ids = np.zeros(0, "<u4")

    def _encoded(self, words: list[str]) -> list[list[int]]:
        """ids of each word, from those of its parts."""
        cut = [(w.lower(), "") if w.isascii() and w.isalpha() else word_parts(w) for w in words]
        asked = list({p for pair in cut for p in pair if p})
        known = {"": []}
        for plain_, tok in ((True, self.bare), (False, self.tokenizer)):
            own = [p for p in asked if (p.isascii() and p.isalpha() and p.islower()) is plain_]
            known |= {p: e.ids for p, e in zip(own, tok.encode_batch_fast(own, add_special_tokens=False), strict=True)}
        return [known[head] + known[tail] if tail else known[head] for head, tail in cut]

    def _learn(self, hashes: np.ndarray, places: np.ndarray, words: list[str]) -> None:
        found = self._encoded(words)
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = np.stack([len(self.ids) + np.cumsum(size) - size, size], axis=1)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))])
        self.hashes, self.at = np.insert(self.hashes, places, hashes), np.insert(self.at, places, at, axis=0)

    def texts(self, texts: list[str]) -> list[bytes]:
        data = [plain(t).encode("utf-8", "surrogatepass") for t in texts]
        spans = [word_hashes(d, _MARKS.encode(), b"<") for d in data]
        n = np.array([len(h) for h, _, _ in spans])
        if not n.sum():
            return [b""] * len(texts)
        unique, first, which = np.unique(np.concatenate([h for h, _, _ in spans]), return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > self.limit:
            self.clear()
        place = np.searchsorted(self.hashes, unique)
        new = np.flatnonzero(np.append(self.hashes, 0)[place] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            edge = np.cumsum(n)
            text = np.searchsorted(edge, first[new], side="right")
            word = first[new] - (edge - n)[text]
            words = [data[t][spans[t][1][i] : spans[t][2][i]].decode("utf-8", "surrogatepass") for t, i in zip(text.tolist(), word.tolist(), strict=True)]
            self._learn(unique[new], place[new], words)
        at = self.at[np.searchsorted(self.hashes, unique)][which.reshape(-1)]
        ends = np.cumsum(at[:, 1])
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(at[:, 0] - ends + at[:, 1], at[:, 1])]
        cuts = np.append(0, ends)[np.append(0, np.cumsum(n))].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]


# ------------------------------------------------------------ SentencePiece

MARK = "▁"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def marked_chunks(text: str) -> list[str]:
    """A marked text cut before each run of marks."""
    return _MARKED.findall(text)
