"""Pieces of byte-level BPE tokenizers, remembered.

The library takes about as long to set up an encoding as to encode a word. So spans that plainly
fall into pieces (Latin letters, digits, ASCII marks, single line ends; no special token) are cut
here and each distinct piece goes to the library's model once; any other span goes to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa

from loresift.llm.batch import spans

LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ƺ"
MARKS = r"!-&(-/:-@\[-`{-~"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class Memo(dict):
    """A dict that computes what it misses, and forgets all when it holds too much."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class Pieces:
    """Values of spans, summed or joined from values of their pieces.

    piece: a pattern of the pieces of plain spans, without backtracking. of: turns tokens (library objects with an id)
    into a value. join: makes one value of a list of values. lower: lower-case plain spans.
    """

    def __init__(self, path: str, piece: str, of, join, lower: bool = False, most: int = 300_000):
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        tokenize = encoder.model.tokenize
        pieces = Memo(lambda p: of([t.id for t in tokenize(p.encode().decode("latin-1").translate(BYTE_LETTERS))]), most)
        added = [re.escape(t.content) for t in encoder.get_added_tokens_decoder().values()]
        special = re.compile("|".join(added) or r"(?!)").search
        find, plain = re.compile(piece).findall, re.compile(f"(?:{piece})++").fullmatch

        def value(span: str):
            if plain(span) and not special(span):
                return join([pieces[p] for p in find(span.lower() if lower else span)])
            return of(encoder.encode(span, add_special_tokens=False).ids)

        self.spans = Memo(value, most)


def _classes() -> np.ndarray:
    """What a byte of UTF-8 belongs to: 0 white space, 1 letter, 2 digit, 3 mark, 4 none of these."""
    out = np.full(256, 4, np.uint8)
    out[[0x20, 0x09, 0x0A, 0x0D]] = 0
    out[0x21:0x7F] = 3
    out[ord("'")] = 4
    out[0x30:0x3A] = 2
    for first in (0x41, 0x61):
        out[first : first + 26] = 1
    out[0x80:0xC0] = 1  # the second byte of a letter; after any other first byte the word is odd anyway
    out[0xC3:0xC7] = 1  # first bytes of U+00C0 to U+01BF
    return out


CLASSES = _classes()


class WordPieces:
    """Ids of whole texts for tokenizers that part letters, digits and marks and drop white space.

    Texts are cut into pieces for many rows at once: runs of letters, single digits, runs of
    marks; a word that holds anything else, or a special token, is one piece. Each distinct piece
    goes to the library once while it is remembered.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.tokenize = self.encoder.model.tokenize
        self.special = [t.content.lower().encode() for t in self.encoder.get_added_tokens_decoder().values()]
        self.special_words = [t for t in self.special if _ASCII(t) or not t.isascii()]
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.begins, self.counts = array("I"), array("q"), array("i")

    def _learn(self, piece: bytes) -> int:
        lower = None
        if piece.isascii():
            if _ASCII(piece):
                lower = piece.decode().lower()
        elif _LATIN(text := piece.decode()):
            lower = text.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
        if lower is None or self.special_words and any(t in piece.lower() for t in self.special_words):
            ids = self.encoder.encode(piece.decode(), add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.tokenize(lower)]
        number = self.known[piece] = len(self.begins)
        self.begins.append(len(self.pool))
        self.counts.append(len(ids))
        self.pool.extend(ids)
        return number

    def _odd(self, octets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Positions of bytes whose word is not cut: neither Latin letter, digit nor mark, or in a special token."""
        odd = kinds == 4
        lead = np.flatnonzero((octets[:-1] >= 0xC3) & (octets[:-1] <= 0xC6)) if len(octets) else np.zeros(0, np.int64)
        pair = octets[lead].astype(np.int32) << 8 | octets[lead + 1]
        odd[lead[(pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0) | (pair > 0xC6BA)]] = True
        lower = None
        for token in self.special:
            if (octets == token[0]).any():
                lower = octets.tobytes().lower() if lower is None else lower
                at = lower.find(token)
                while at >= 0:
                    odd[at : at + len(token)] = True
                    at = lower.find(token, at + 1)
        return np.flatnonzero(odd)

    def ids(self, octets: np.ndarray, row_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and how many each row has."""
        if len(self.known) > self.most:
            self._forget()
        if not len(octets):
            return np.zeros(0, np.uint32), np.zeros(len(row_ends), np.int64)
        kinds = CLASSES[octets]
        solid = kinds != 0
        cut = np.empty(len(octets) + 1, bool)
        cut[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=cut[1:-1])
        cut[:-1] |= kinds == 2
        cut[row_ends] = True
        odd = self._odd(octets, kinds)
        if len(odd):
            begins = solid.copy()
            begins[1:] &= ~solid[:-1]
            rows = row_ends[row_ends < len(octets)]
            begins[rows] |= solid[rows]
            words = np.append(np.flatnonzero(begins), len(octets))
            k = np.unique(np.searchsorted(words, odd, "right") - 1)
            cut[spans(words[k] + 1, words[k + 1] - words[k] - 1)] = False
        cut = cut[:-1]
        cut &= solid
        at = np.flatnonzero(cut)
        offsets = np.empty(len(at) + 1, np.int32)
        offsets[:-1] = np.cumsum(solid, dtype=np.int32)[at] - 1
        packed = octets[solid]
        offsets[-1] = len(packed)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        known, learn = self.known, self._learn
        numbers = np.array([known[w] if w in known else learn(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)
        numbers = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        counts = _copy(self.counts, np.int32, numbers).astype(np.int64)
        out = _copy(self.pool, np.uint32, spans(_copy(self.begins, np.int64, numbers), counts))
        total = np.concatenate([[0], np.cumsum(counts)])
        return out, np.diff(total[np.concatenate([[0], np.searchsorted(at, row_ends)])])


def _copy(values: array, kind, at: np.ndarray) -> np.ndarray:
    """The values at given places; nothing keeps a view, so the array can go on growing."""
    return np.frombuffer(values, kind)[at] if len(values) else np.zeros(0, kind)


_ASCII = re.compile(rf"[A-Za-z]++|[0-9]|[{MARKS}]++".encode()).fullmatch
_LATIN = re.compile(f"[{LETTERS}]++").fullmatch
