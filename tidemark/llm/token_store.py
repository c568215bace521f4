"""Content-addressed token store: id streams cut into chunks where a rolling hash says so, each distinct chunk stored once.

Files (Parquet, in one folder that all machines share):
- chunks/:   hash (16 bytes), n, ids (little-endian, 2 or 4 bytes an id). One row per distinct chunk.
- recipes/:  shard, place, doc_id, start_in_shard, n_tokens, root (Merkle root of the chunk hashes), hashes. Rows in ascending doc_id
             order: shards are ranges of doc_id, each one file sorted by it.
- manifest/: shard, documents, tokens, root (Merkle root of the documents' leaves: id, tokens, root). One row per shard. Reading recomputes the roots from the
  recipes, so a recipe that is lost, added, moved or changed shows in its whole shard.

Cutting depends on the ids alone (a hash of the last ids under a mask), so a passage that documents share gives the same chunks wherever it stands.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import delete
from .common import cut, fresh_path, lean, release, shuffles, skew_join, text_runs
from .tokenization import WordEncoder, encoder, forget

#: Ids that the rolling hash sees, average and largest chunk; the first two are powers of two.
WINDOW, AVERAGE, LONGEST = 8, 256, 2048


def cut_points(ids: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of every stream, counted in all ids: after an id where the hash of its stream's last WINDOW ids is 0 modulo AVERAGE, and after
    LONGEST ids at the latest. No cut is within a stream's first WINDOW - 1 ids. first: where each stream begins, with the end as last."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    size = 1
    while size < WINDOW:  # h of 2 * size ids from those of size ids
        older = h[:-size] * np.uint32(pow(0xC2B2AE3D, size, 1 << 32))
        h[size:] += older
        size *= 2
    ends = np.flatnonzero(h * np.uint32(0x27D4EB2F) >> np.uint32(33 - AVERAGE.bit_length()) == 0) + 1
    ends = ends[ends - first[np.searchsorted(first, ends, side="left") - 1] >= WINDOW]
    edge = np.searchsorted(ends, first, side="right")
    out = []
    for k, (last, stop) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        own = []
        for e in [*ends[edge[k] : edge[k + 1]].tolist(), stop]:
            while e - last > LONGEST:
                last += LONGEST
                own.append(last)
            if e > last:
                own.append(e)
                last = e
        out.append(own)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over 16-byte hashes; an odd node moves up unchanged; no leaves: the hash of nothing."""
    level = list(leaves) or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16, person=b"node").digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def chunk_hash(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16, person=b"leaf").digest()


def _crc_matrices() -> list[np.ndarray]:
    """Column bits of the operators that append 2**k zero bytes to a CRC-32 register."""
    one = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    times = lambda m, v: int(np.bitwise_xor.reduce([m[i] for i in range(32) if v >> i & 1] or [0]))
    square = lambda m: [times(m, m[i]) for i in range(32)]
    m = square(square(square(one)))  # one zero byte
    out = []
    for _ in range(48):
        out.append(m)
        m = square(m)
    return out


_SHIFT: list[np.ndarray] = []


def crc_of_parts(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of every group of consecutive parts from the parts' own and their sizes in bytes; first: where each group begins (none is empty).

    A CRC is linear: a part's share is its own CRC moved on by the bytes after it. The move by 2**k bytes is four table look-ups.
    """
    if not _SHIFT:
        byte = np.arange(256, dtype=np.uint64)
        for m in _crc_matrices():
            table = np.zeros((4, 256), np.uint32)
            for q in range(4):
                for i in range(8):
                    table[q] ^= np.where(byte >> np.uint64(i) & np.uint64(1), np.uint32(m[8 * q + i]), np.uint32(0))
            _SHIFT.append(table)
    ends = np.cumsum(sizes)
    group_end = np.append(ends[first[1:] - 1], ends[-1])
    after = np.repeat(group_end, np.diff(np.append(first, len(sizes)))) - ends
    v = crcs.astype(np.uint32)
    for k in range(int(after.max()).bit_length()):
        on, t = np.flatnonzero(after >> k & 1), _SHIFT[k]
        x = v[on]
        v[on] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return np.bitwise_xor.reduceat(v, first)


def write_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> None:
    """Encode every text, append end_id, and write the store to path.

    Null and empty texts are the end id alone. Null ids come first. Rows with equal ids keep their own recipes, in any order. Other columns are
    not read. wide: 4 bytes an id; else ids must be under 65,536, and a larger one is an error. An empty table gives a store without documents.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[id_col].dataType.simpleString()
    dtype = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(WordEncoder, shared.value), np.array([end_id], "<u4").tobytes()
        for b in batches:
            names = b.column(0).to_pylist()
            for lo, texts in text_runs(b, text_col, 2 << 20):
                streams = [enc.encode(t) + end for t in texts]
                first = np.cumsum([0, *(len(x) // 4 for x in streams)])
                ids = np.frombuffer(b"".join(streams), "<u4")
                if not wide and int(ids.max()) > 0xFFFF:
                    raise ValueError("an id of 65,536 or more: write a wide store")
                raw, own, chunks = ids.astype(dtype).tobytes(), [], {}
                wide_ = np.dtype(dtype).itemsize
                for k, ends in enumerate(cut_points(ids, first)):
                    last, hashes = int(first[k]), []
                    for e in ends:
                        part = raw[wide_ * last : wide_ * e]
                        h = chunk_hash(part)
                        hashes.append(h)
                        chunks[h] = (h, e - last, part)
                        last = e
                    own.append((int(first[k + 1] - first[k]), merkle_root(hashes), hashes))
                yield from _rows(b.schema.field(0).type, names[lo : lo + len(texts)], own, list(chunks.values()))

    both = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, root binary, hashes array<binary>, hash binary, n int, ids binary")
    staged = fresh_path(spark, "chunks")
    both.withColumn("part", F.when(F.col("hash").isNull(), "recipe").otherwise("chunk")).write.partitionBy("part").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(staged)
    schema = T.StructType([*both.schema.fields, T.StructField("part", T.StringType())])
    back = spark.read.schema(schema).parquet(staged)
    found = back.where("part = 'chunk'").select("hash", "n", "ids")
    found.distinct().write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = back.where("part = 'recipe'").select("doc_id", "n_tokens", "root", "hashes").repartitionByRange(max(1, shuffles(spark)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        shard, at, start = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False)
            starts = start + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard), pa.int32()), pa.array(np.arange(at, at + len(n))), b.column(0), pa.array(starts, pa.int64()), b.column(1), b.column(2), b.column(3)], names=["shard", "place", "doc_id", "start_in_shard", "n_tokens", "root", "hashes"])
            at, start = at + len(n), start + int(n.sum())

    recipes.mapInArrow(place, f"shard int, place long, doc_id {kind}, start_in_shard long, n_tokens long, root binary, hashes array<binary>").write.option("compression", "zstd").parquet(f"{path}/recipes")
    delete(spark, staged)
    release(spark)
    _sealed(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


#: Leaves under one node of a shard's tree that one row holds; a power of two, so that nodes of such blocks are nodes of the whole tree.
BLOCK = 4096


def _sealed(recipes: DataFrame) -> DataFrame:
    """shard, documents, tokens, root of the recipes as they are. A block's leaves meet in one row, then a shard's blocks: 16 bytes for BLOCK documents."""

    def roots(leaf):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for b in batches:
                tops = [merkle_root([leaf(x) for x in r]) for r in b.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(tops, pa.binary())], names=["shard", "block", "documents", "tokens", "root"])

        return run

    schema = "shard int, block long, documents long, tokens long, root binary"
    leaf = F.struct("place", F.concat_ws("|", "place", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull().cast("string"), "n_tokens").alias("what"), "root")
    blocks = recipes.groupBy("shard", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sort_array(F.collect_list(leaf)).alias("r"))
    tops = blocks.mapInArrow(roots(lambda x: hashlib.blake2b(x["what"].encode() + b"|" + x["root"], digest_size=16).digest()), schema)
    shards = tops.groupBy("shard").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("block", "root"))).alias("r"))
    return shards.select("shard", F.lit(0).cast("long").alias("block"), "documents", "tokens", "r").mapInArrow(roots(lambda x: x["root"]), schema).drop("block")


def _binary(parts: list[bytes]) -> pa.Array:
    edge = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=edge[1:])
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(edge), pa.py_buffer(b"".join(parts))])


def _rows(kind: pa.DataType, ids: list, own: list, chunks: list) -> Iterator[pa.RecordBatch]:
    """The recipes of documents (tokens, root, hashes), then the chunks (hash, n, ids): each has null in the other's columns."""
    names, lists = ["doc_id", "n_tokens", "root", "hashes", "hash", "n", "ids"], pa.list_(pa.binary())
    edge = np.cumsum([0, *(len(h) for _, _, h in own)]).astype(np.int32)
    hashes = pa.ListArray.from_arrays(edge, _binary([x for _, _, h in own for x in h]))
    n, m = len(own), len(chunks)
    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([x for x, _, _ in own], pa.int64()), _binary([x for _, x, _ in own]), hashes, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, lists), _binary([c[0] for c in chunks]), pa.array([c[1] for c in chunks], pa.int32()), _binary([c[2] for c in chunks])], names=names)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, shard_start (ids of all shards before it), sealed (the recipes read back give the manifest's root and counts). One row a shard; shards that only one side has are an error."""
    found = {r[0]: tuple(r) for r in _sealed(spark.read.parquet(f"{path}/recipes")).collect()}
    at, rows = 0, []
    for r in sorted(spark.read.parquet(f"{path}/manifest").select("shard", "documents", "tokens", "root").collect()):
        rows.append((r[0], at, found.pop(r[0], None) == tuple(r)))
        at += r[2]
    if found:
        raise ValueError(f"recipes of shards that the manifest lacks: {sorted(found)}")
    return spark.createDataFrame(rows, "shard int, shard_start long, sealed boolean")


def verify_store(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 (of 4-byte ids), verified.

    verified: every chunk's content gives its hash, the document's chunk hashes its root, and its shard's recipes the root in the manifest. Every stored chunk
    is read once. A document's CRC is joined from those of its chunks, so no ids travel. Chunks that many documents share are joined without skew.
    """
    dtype = "<u4" if wide else "<u2"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            parts = b.column(1).to_pylist()
            good = [chunk_hash(p) == h for h, p in zip(b.column(0).to_pylist(), parts, strict=True)]
            every, n = np.frombuffer(b"".join(parts), dtype).astype("<u4"), np.array([len(p) for p in parts], np.int64) // np.dtype(dtype).itemsize
            ends = 4 * np.cumsum(n)
            view = memoryview(every).cast("B")
            crc = [zlib.crc32(view[lo:hi]) for lo, hi in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(crc, pa.int64()), pa.array(good)], names=["hash", "n", "crc", "good"])

    chunks = spark.read.parquet(f"{path}/chunks").select("hash", "ids").mapInArrow(lean(digest), "hash binary, n long, crc long, good boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("shard", "place", F.posexplode("hashes").alias("k", "hash"))
    counted = cut(uses.groupBy("hash").agg(F.count(F.lit(1)).alias("uses")).join(chunks, "hash", "left"))
    met = skew_join(uses, counted, ["hash"], "uses", F.concat_ws(".", "shard", "place", "k"))
    docs = met.groupBy("shard", "place").agg(F.sort_array(F.collect_list(F.struct("k", "hash", "n", "crc", "good"))).alias("c"))
    docs = docs.join(recipes.select("shard", "place", "doc_id", "start_in_shard", "n_tokens", "root"), ["shard", "place"]).join(F.broadcast(_starts(spark, path)), "shard")  # shards: as many as shuffle partitions
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            if not b.num_rows:
                continue
            parts, size = b.column(3).flatten(), b.column(3).value_lengths().to_numpy()  # a document has its end id's chunk at least
            c = dict(zip((f.name for f in parts.type), parts.flatten(), strict=True))
            first = np.cumsum(size) - size
            n, crc = (c[k].fill_null(0).to_numpy() for k in ("n", "crc"))
            good = np.logical_and.reduceat(c["good"].fill_null(False).to_numpy(zero_copy_only=False), first) & (np.add.reduceat(n, first) == b.column(2).to_numpy())
            leaves = c["hash"].to_pylist()
            good = [bool(g) and merkle_root(leaves[lo : lo + k]) == root for g, lo, k, root in zip(good, first.tolist(), size.tolist(), b.column(4).to_pylist(), strict=True)]
            good = [g and s for g, s in zip(good, b.column(5).to_pylist(), strict=True)]
            crcs = crc_of_parts(crc, 4 * n, first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crcs, pa.int64()), pa.array(good)], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return docs.select("doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "c", "root", "sealed").mapInArrow(lean(join), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """The documents' ids again: doc_id, ids array<int>; a row for every row that was written, none for a store of an empty table."""
    chunks = spark.read.parquet(f"{path}/chunks").select("hash", F.col("ids").alias("part"))
    uses = spark.read.parquet(f"{path}/recipes").select("shard", "place", "doc_id", F.posexplode("hashes").alias("k", "hash"))
    docs = uses.join(chunks, "hash").groupBy("shard", "place", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("c"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x["part"] for x in c), "<u4" if wide else "<u2").astype(np.int32) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "c").mapInArrow(join, f"doc_id {uses.schema['doc_id'].dataType.simpleString()}, ids array<int>")
