"""Token ids by the tokenizers library, each distinct piece of text encoded once per worker.

A vocabulary file's full pipeline (normaliser, pre-tokeniser, merges) costs about a microsecond a byte, mostly for words that were seen before. Both
pipelines used here never merge across a blank, so a text is cut at blanks into chunks, and each chunk's ids are kept in a bounded table. A chunk of plain
Latin-1 letters, digits and printable ASCII is split by the same pattern in `re` and handed straight to the library's BPE model; any other
chunk (other scripts, combining marks, odd blanks, control characters) goes through the library's whole pipeline.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from operator import itemgetter

import numpy as np

from .common import ASCII_LOWER

#: Chunks held per worker, in two tables: when the newer one has half of them, it takes the older one's place.
CACHE = 800_000
#: What one piece of a word pipeline may hold together: printable ASCII but letters and digits.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_BLANK = " \\t\\n\\r\\x0b\\x0c"
_PLAIN = re.compile(f"[{_BLANK}]*[!-~À-ÖØ-öø-ÿ]*\\Z")
_ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


def byte_chars() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token, in order of rank: its bytes merged by all lower ranks until two parts are left."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def tokenizer_json_from_ranks(path: str, pattern: str) -> str:
    """A byte-level BPE tokenizer (as JSON of the tokenizers library) with a rank file's vocabulary, and its split pattern."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, char = read_ranks(path), byte_chars()
    show = lambda token: "".join(char[b] for b in token)
    t = Tokenizer(models.BPE(vocab={show(k): v for k, v in ranks.items()}, merges=[(show(a), show(b)) for a, b in merges_of(ranks)]))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t.to_str()


class ChunkEncoder(dict):
    """chunk (str or bytes) -> ids as little-endian unsigned 32-bit integers. Looking a chunk up encodes it if need be."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str | bytes, bytes] = {}
        self.full = Tokenizer.from_str(tokenizer_json)
        self.full.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
        self.tokenize = self.full.model.tokenize
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(16)]
        char = byte_chars()
        self.shown = {b: char[b] for b in range(256)}

    def __missing__(self, chunk: str | bytes) -> bytes:
        ids = self.older.get(chunk) or self.fresh(chunk)
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            if not p.isascii() or p < " ":
                p = p.encode().decode("latin-1").translate(self.shown)
            elif p[0] == " ":
                p = "\u0120" + p[1:] if p.isprintable() and " " not in p[1:] else p.translate(self.shown)
            ids += [t.id for t in self.tokenize(p)]
        return self.pack[len(ids)](*ids) if len(ids) < 16 else np.array(ids, "<u4").tobytes()


class WordEncoder(ChunkEncoder):
    """For pipelines that drop blanks, lower case and end words (word_bpe): chunks are the words between ASCII blanks, as bytes."""

    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def fresh(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone are one piece
            ids = [t.id for t in self.tokenize(word.decode())]
            return self.pack[len(ids)](*ids) if len(ids) < 16 else np.array(ids, "<u4").tobytes()
        stem = word.rstrip(PUNCTUATION)
        if stem.isalpha():  # two pieces, which the table may have
            return self[stem] + self[word[len(stem) :]]
        text = word.decode()
        if not _PLAIN.match(text):
            return self.whole(text)
        pieces = self.PIECE.findall(text.lower())
        if len(pieces) > 1 and text.isascii():  # a piece is a word of its own, which the table may have
            return b"".join([self[p.encode()] for p in pieces])
        return self.pieces(pieces)

    def encode(self, text: bytes) -> bytes:
        words = text.translate(ASCII_LOWER).split()
        return b"".join(itemgetter(*words)(self)) if len(words) > 1 else b"".join([self[w] for w in words])


class ByteEncoder(ChunkEncoder):
    """For byte-level BPE: chunks are blanks with the word after them. Texts with blanks beyond ASCII go through the library's pipeline whole."""

    CHUNK = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
    PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_BLANK}{_LETTER}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")

    def fresh(self, chunk: str) -> bytes:
        return self.pieces(self.PIECE.findall(chunk)) if _PLAIN.match(chunk) else self.whole(chunk)

    def encode(self, text: bytes) -> bytes:
        t = text.decode()
        if not t.isascii() and _ODD_BLANK.search(t):
            return self.whole(t)
        return b"".join([self[c] for c in self.CHUNK.findall(t)])


_ENCODERS: dict[tuple[type, int], ChunkEncoder] = {}


def encoder(kind: type[ChunkEncoder], tokenizer_json: str) -> ChunkEncoder:
    """This worker's encoder; kept from task to task."""
    key = (kind, hash(tokenizer_json))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = kind(tokenizer_json)
    return _ENCODERS[key]


def forget() -> None:
    """Free this worker's encoder; for functions that run after the encoding is done, in the same workers."""
    _ENCODERS.clear()


def id_bytes(tokenizer_json: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary, by the byte table in reverse."""
    back = {c: b for b, c in enumerate(byte_chars())}
    vocab = json.loads(tokenizer_json)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out
