"""Byte-level BPE: encode texts to ids with offsets, and decode ids, over Arrow batches with the tokenizers library."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_runs
from .tokenization import ByteEncoder, encoder, id_bytes, tokenizer_json_from_ranks

def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (array of int), byte_starts (first byte of every token in the UTF-8 text).

    Null and empty texts have no ids. A token may begin or end inside a character; byte offsets say so exactly. Null ids stay null and repeated rows are encoded
    again; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary: fixed size
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, byte_starts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(ByteEncoder, shared.value), np.array([len(b) for b in id_bytes(shared.value)])
        for b in batches:
            for lo, texts in text_runs(b, text_col):
                ids = [np.frombuffer(enc.encode(t), "<u4") for t in texts]
                starts = [np.cumsum(size[i]) - size[i] for i in ids]
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array([i.astype(np.int32) for i in ids], kind), pa.array([s.astype(np.int32) for s in starts], kind)], names=[id_col, "ids", "byte_starts"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)


def decode(tokens: DataFrame, tokenizer_json: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: id, bytes, text, pieces (text that each token completes).

    A character split over tokens belongs to the token that ends it; bytes that never form a character become U+FFFD.
    A null array of ids decodes to nothing. Repeated rows are decoded again; other columns are not read; an empty table gives no rows.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, bytes binary, text string, pieces array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_bytes(shared.value)
        for b in batches:
            rows = [[table[i] for i in ids or ()] for ids in b.column(1).to_pylist()]
            pieces = [split_pieces(r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(r) for r in rows], pa.binary()), pa.array(["".join(p) for p in pieces], pa.string()), pa.array(pieces, pa.list_(pa.string()))], names=[id_col, "bytes", "text", "pieces"])

    return tokens.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)


def split_pieces(tokens: list[bytes]) -> list[str]:
    """The text that each token completes; the last token also carries what stays incomplete."""
    reader = codecs.getincrementaldecoder("utf-8")(errors="replace")
    return [reader.decode(t, i == len(tokens) - 1) for i, t in enumerate(tokens)]


def _split_runs(inside: np.ndarray, ends: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first token, last + 1, first byte, last + 1) of every run of tokens that share characters; inside: whether each token but the last ends inside one."""
    at = np.flatnonzero(inside)
    if at.size:
        head = np.flatnonzero(np.append(True, np.diff(at) > 1))
        for a, b in zip(at[head].tolist(), at[np.append(head[1:], at.size) - 1].tolist(), strict=True):
            yield a, b + 2, int(ends[a] - size[a]), int(ends[b + 1])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids_sha256, decoded_sha256, n_bytes, n_split, same.

    n_split: tokens that begin inside a character, by their byte offsets. same: the decoded bytes are the text's, the offsets end where the text ends, and where
    tokens share a character, the decoder that joins split characters gives the text at these offsets (elsewhere a token's piece is its bytes).
    Null and empty texts have no tokens. Repeated rows get equal answers; null ids stay null; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json_from_ranks(ranks_path, pattern))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_split long, same boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoder(ByteEncoder, shared.value), id_bytes(shared.value)
        size = np.array([len(x) for x in table])
        for b in batches:
            for lo, texts in text_runs(b, text_col):
                n, sha, back, split, same = [], [], [], [], []
                for t in texts:
                    ids = enc.encode(t)
                    own = np.frombuffer(ids, "<u4")
                    tokens = [table[i] for i in own.tolist()]
                    decoded = b"".join(tokens)
                    ends = np.cumsum(size[own])
                    inside = np.frombuffer(t, np.uint8)[ends[:-1]] & 0xC0 == 0x80 if len(own) > 1 and ends[-1] == len(t) else np.zeros(0, bool)
                    n.append(len(own))
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    split.append(int(inside.sum()))
                    same.append(decoded == t and (ends[-1] if len(own) else 0) == len(t) and all("".join(split_pieces(tokens[a:b])) == t[lo_:hi].decode() for a, b, lo_, hi in _split_runs(inside, ends, size[own])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(n, pa.int64()), pa.array(sha), pa.array(back), pa.array([len(t) for t in texts], pa.int64()), pa.array(split, pa.int64()), pa.array(same)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "n_split", "same"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)
