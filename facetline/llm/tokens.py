"""Token ids through the tokenizers library, with what it returned kept for the pieces of text seen lately.

A tokenizer never joins what its pre-tokenizer keeps apart, so a text's ids are the ids of its pieces in order. Pieces
come back often: their ids are kept in dictionaries of a bounded number of entries (cleared when full, so the results
do not depend on it), and only new ones go through the library.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Latin letters that Unicode normalisation leaves alone, then punctuation; fixed values of the ASCII and Latin-1 tables.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
PUNCTUATION = r"!-/:-@\[-^`{-~"
CHUNK_CAP, PIECE_CAP = 200_000, 500_000


def _le(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class WordTokens:
    """ids of a text by a tokenizer file that lower-cases and drops white space, as little-endian unsigned 32-bit bytes."""

    SIMPLE = re.compile(f"([{LETTERS}]+)([{PUNCTUATION}]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def text(self, raw: bytes) -> bytes:
        words = raw.split()
        try:
            return b"".join(map(self.chunks.__getitem__, words))
        except KeyError:
            if len(self.chunks) > CHUNK_CAP:
                self.chunks.clear()
            self._learn(set(words).difference(self.chunks))
            return b"".join(map(self.chunks.__getitem__, words))

    def _learn(self, words: set[bytes]) -> None:
        if len(self.pieces) > PIECE_CAP:
            self.pieces = {"": b""}
        simple, other, new = [], [], set()
        for w in words:
            s = w.decode("utf-8", "replace")
            m = self.SIMPLE.fullmatch(s)
            if m:
                a, b = m[1].lower(), m[2]
                simple.append((w, a, b))
                if a not in self.pieces:
                    new.add(a)
                if b not in self.pieces:
                    new.add(b)
            else:
                other.append((w, s))
        if new:
            new = list(new)
            for p, e in zip(new, self.bare.encode_batch_fast(new, add_special_tokens=False), strict=True):
                self.pieces[p] = _le(e.ids)
        for w, a, b in simple:
            self.chunks[w] = self.pieces[a] + self.pieces[b]
        if other:
            for (w, _), e in zip(other, self.whole.encode_batch_fast([s for _, s in other], add_special_tokens=False), strict=True):
                self.chunks[w] = _le(e.ids)


def byte_characters() -> dict[int, str]:
    """The byte-to-character table of byte-level tokenizers: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each longer token: what is left when the token is merged by lower ranks only."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            r, i = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if r >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteTokens:
    """Byte-level BPE by a rank file: encoding by matches of a pattern, decoding by the reversed byte table."""

    SIMPLE = re.compile(f"( ?[{LETTERS}]+)([{PUNCTUATION}]*)")
    #: A space is a sure edge only between two characters that are not white space.
    UNSURE = re.compile(r"\s |\s\Z|\A | \s")

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, decoders, models, pre_tokenizers

        ranks = read_ranks(ranks_path)
        chars = byte_characters()
        spell = lambda t: "".join(chars[b] for b in t)
        vocab = {spell(t): i for t, i in ranks.items()}
        merges = [(spell(a), spell(b)) for a, b in merges_of(ranks)]
        self.bare = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.decoder = decoders.ByteLevel()
        self.pattern = regex.compile(pattern)
        back = {c: b for b, c in chars.items()}
        self.table = [b""] * (max(ranks.values()) + 1)
        for t, i in vocab.items():
            self.table[i] = bytes(back[c] for c in t)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def _chunks(self, text: str) -> list[str]:
        if self.UNSURE.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        parts = self._chunks(text)
        try:
            return b"".join(map(self.chunks.__getitem__, parts))
        except KeyError:
            if len(self.chunks) > CHUNK_CAP:
                self.chunks.clear()
            self._learn(set(parts).difference(self.chunks))
            return b"".join(map(self.chunks.__getitem__, parts))

    def _learn(self, parts: set[str]) -> None:
        if len(self.pieces) > PIECE_CAP:
            self.pieces = {"": b""}
        split, new = [], set()
        for s in parts:
            m = self.SIMPLE.fullmatch(s)
            own = m.groups() if m else self.pattern.findall(s)
            split.append((s, own))
            new.update(p for p in own if p not in self.pieces)
        if new:
            new = list(new)
            for p, e in zip(new, self.bare.encode_batch_fast(new, add_special_tokens=False), strict=True):
                self.pieces[p] = _le(e.ids)
        for s, own in split:
            self.chunks[s] = b"".join([self.pieces[p] for p in own])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; a character split between tokens comes whole again as its bytes meet."""
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts, in characters of the text; a token inside a character starts where that does."""
        out, at = np.zeros(len(ids), np.int64), 0
        for k, i in enumerate(ids.tolist()):
            t = self.table[i]
            begun = sum((b & 0xC0) != 0x80 for b in t)
            out[k] = at if (t[0] & 0xC0) != 0x80 else max(0, at - 1)
            at += begun
        return out


_CACHE: dict[tuple, object] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process and file."""
    key = ("word", path)
    if key not in _CACHE:
        _CACHE[key] = WordTokens(path)
    return _CACHE[key]


def byte_tokens(path: str, pattern: str) -> ByteTokens:
    key = ("byte", path, pattern)
    if key not in _CACHE:
        _CACHE[key] = ByteTokens(path, pattern)
    return _CACHE[key]
