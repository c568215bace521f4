"""LM scoring by an n-gram model held as Elias-Fano tries, one for each range of hashes.

Counting covers every training text. Nothing of the model is gathered in one place or depends on the corpus' size: a word, bigram or trigram seen LEAST times
or more takes part. Texts are dealt in batches, and each order takes one round of requests and replies between the batches and the model's buckets:
- A batch sends its distinct keys with their counts in training texts to the keys' buckets. A bucket sums the counts and replies to each batch in the order of
  its keys. Words are 64-bit hashes; frequent enough words and bigrams get ids (32 bits), so that a bigram is the ids of its two words, and a trigram the ids
  of a bigram and a word, which are exact. As an n-gram's parts are at least as frequent, the next order is asked for only where the order below is kept.
- A bucket holds whole contexts. Its level of the trie has the successors of each context, contexts in order, as one monotone Elias-Fano sequence, and the
  contexts as another; a look-up is a successor search. Gains (absolute discounting, interpolated) and back-off weights are quantised logarithms.
- Words seen less often have their counts only. What follows a context and isn't kept is counted as one more successor, so a context's total is exact.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, mix64, release, shuffles, text_runs, trim, word_hashes

LEAST, DISCOUNT = 2, 0.75
BATCH = 8 << 20
END = np.uint64(0x5CA1AB1E0DDBA11)
#: Step of a quantised log10; the range is 65,535 steps below 0, the last of which stands for no gain at all.
STEP = 1 / 4096
#: Ids: the start of a text, and words or bigrams without one.
START, NONE = 0, 0xFFFFFFFF
_SHIFT, _LOW = np.uint64(32), np.uint64(NONE)
#: Replies of each round: ids and counts; ids, gains and back-off weights; nothing is asked beyond trigrams.
_KINDS = {1: ("<u4", "<i8"), 2: ("<u4", "<u2", "<u2"), 3: ("<u2", "<u2")}


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with zeros counted up to each word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = v.size
        bits = max(0, int((int(v[-1]) + 1) // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        if bits:
            part, word, shift = v & np.uint64((1 << bits) - 1), (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = (v >> np.uint64(bits)).astype(np.int64)
        size = n + (int(top[-1]) if n else 0) + 2
        flags = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        flags[top + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])[:-1]
        return cls(n, bits, low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(i.size, np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        over = shift + np.uint64(self.bits) > 64
        x[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return x & np.uint64((1 << self.bits) - 1)

    @staticmethod
    def _select(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th set bit of each word, by halving."""
        at, word, r = np.zeros(word.size, np.int64), word.copy(), r.astype(np.int64).copy()
        for half in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            go = r >= inside
            r -= np.where(go, inside, 0)
            at += np.where(go, half, 0)
            word = np.where(go, word >> np.uint64(half), word)
        return at

    def _before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values lie before the k-th zero (from 0)."""
        w = np.searchsorted(self.zeros, k, side="right") - 1
        return w * 64 + self._select(~self.high[w], k - self.zeros[w]) - k

    def get(self, i: np.ndarray) -> np.ndarray:
        ones = np.arange(self.zeros.size) * 64 - self.zeros
        w = np.searchsorted(ones, i, side="right") - 1
        place = w * 64 + self._select(self.high[w], i - ones[w])
        return (place - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value of at least x; n if there is none."""
        if self.n == 0 or x.size == 0:
            return np.zeros(x.size, np.int64)
        top = (x >> np.uint64(self.bits)).astype(np.int64)
        last = int(self.zeros[-1] + 64 - np.bitwise_count(self.high[-1:])[0]) - 1
        beyond = top > last - 1
        top = np.minimum(top, last - 1)
        lo = np.where(top > 0, self._before_zero(np.maximum(top - 1, 0)), 0)
        hi = np.minimum(self._before_zero(top), self.n)
        want = x & np.uint64((1 << self.bits) - 1)
        while (busy := lo < hi).any():
            mid = (lo + hi) // 2
            less = busy & (self._low(np.minimum(mid, self.n - 1)) < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(busy & ~less, mid, hi)
        return np.where(beyond, self.n, lo)


_POWER = 10.0 ** (-STEP * np.arange(65536))


def _quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs / STEP), 0, 65535).astype(np.uint16)


class Level:
    """One order of the trie in one bucket: successors of contexts as (context << 32 | word) in order, with gains, and the contexts, with what they leave to the order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: float):
        """keys: all in the bucket, sorted; those of at least `least` are kept, but for NONE."""
        context, of = np.unique(keys >> _SHIFT, return_inverse=True)
        total = np.bincount(of, counts, context.size)
        keep = (counts >= least) & (keys & _LOW != _LOW)
        gain = np.maximum(counts[keep] - DISCOUNT, 0) / total[of[keep]]
        used = np.bincount(of[keep], gain, context.size)
        self.keys, self.gain = EliasFano.build(keys[keep]), np.minimum(_quantise(np.log10(gain)), 65534)
        self.contexts, self.left = EliasFano.build(context[used > 0]), _quantise(np.log10(np.clip(1 - used[used > 0], 1e-9, 1)))

    @staticmethod
    def _find(values: EliasFano, x: np.ndarray) -> np.ndarray:
        """Place of each x, or -1."""
        at = values.successor(x)
        ok = at < values.n
        ok[ok] = values.get(at[ok]) == x[ok]
        return np.where(ok, at, -1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (-1 without), gains and back-off weights of sorted keys."""
        context, of = np.unique(keys >> _SHIFT, return_inverse=True)
        at, c = self._find(self.keys, keys), self._find(self.contexts, context)
        left = np.where(c >= 0, self.left[c] if self.left.size else 0, 0)
        return at, np.where(at >= 0, self.gain[at] if self.gain.size else 0, 65535), left[of]


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d in ids], bool)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        names = b.column(0).to_pylist()
        for at, run in text_runs(b, "text"):
            for d, t in zip(names[at : at + len(run)], run, strict=True):
                ids.append(d)
                texts.append(t)
                size += len(t)
                if size >= BATCH:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens (words, then one end), each text's first token, each token's text."""
    words, at = word_hashes(texts)
    h = np.insert(words, at[1:], END) if len(texts) else words
    first = at[:-1] + np.arange(len(texts))
    return h, first, np.repeat(np.arange(len(texts)), np.diff(at) + 1)


_CODEC, _TEXT_CODEC = pa.Codec("zstd", 6), pa.Codec("zstd", 10)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as byte planes, compressed: high bytes of small numbers vanish."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(c.size, -1).T).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(packed: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(_CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = raw.size // sum(widths), [], 0
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def _pack_request(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys, the upper halves as differences."""
    upper = (keys >> _SHIFT).astype("<u4")
    return _pack(np.diff(upper, prepend=np.uint32(0)), keys.astype("<u4"), counts)


def _unpack_request(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    upper, lower, counts = _unpack(packed, "<u4", "<u4", "<u4")
    return np.cumsum(upper, dtype=np.uint64) << _SHIFT | lower, counts


def _pack_texts(texts: list[bytes]) -> bytes:
    lengths, body = _pack(np.array([len(t) for t in texts], "<u4")), b"".join(texts)
    return len(lengths).to_bytes(8, "little") + lengths + len(body).to_bytes(8, "little") + _TEXT_CODEC.compress(body, asbytes=True)


def _unpack_texts(packed: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(packed[:8], "little")
    edge = np.cumsum(np.append(0, _unpack(packed[8:at], "<u4")[0].astype(np.int64))).tolist()
    body = _TEXT_CODEC.decompress(packed[at + 8 :], int.from_bytes(packed[at : at + 8], "little"), asbytes=True)
    return [body[lo:hi] for lo, hi in zip(edge[:-1], edge[1:], strict=True)]


class _Dealt:
    """Distinct keys by bucket, how often each stands in training texts, and the way back."""

    def __init__(self, keys: np.ndarray, train: np.ndarray, n_buckets: int, by: np.uint64):
        own, self.number = np.unique(keys, return_inverse=True)
        bucket = (mix64(own >> by) % np.uint64(n_buckets)).astype(np.int64)
        turn = np.argsort(bucket, kind="stable")
        self.turn, self.keys = turn, own[turn]
        self.counts = np.bincount(self.number, train, own.size).astype("<u4")[turn]
        self.edge = np.searchsorted(bucket[turn], np.arange(n_buckets + 1))

    def requests(self, batch: str) -> pa.Table:
        parts = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(self.edge[:-1], self.edge[1:], strict=True)) if lo < hi]
        recs = [_pack_request(self.keys[lo:hi], self.counts[lo:hi]) for _, lo, hi in parts]
        return pa.table({"bucket": pa.array([p[0] for p in parts], pa.int32()), "batch": pa.array([batch] * len(parts), pa.string()), "recs": pa.array(recs, pa.binary())})

    def replies(self, by_bucket: dict[int, bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
        """The replies' columns, one value for each key that was given."""
        parts = [_unpack(by_bucket[k], *kinds) for k in sorted(by_bucket)]
        out = []
        for i, kind in enumerate(kinds):
            column = np.empty(self.keys.size, kind)
            column[self.turn] = np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind)
            out.append(column[self.number])
        return out


def _answers(level: int, n_buckets: int, least: float):
    """A bucket's replies to all batches."""

    def answer(table: pa.Table) -> pa.Table:
        bucket, recs = table.column("bucket")[0].as_py(), table.column("recs").to_pylist()
        asked = [_unpack_request(x) for x in recs]
        edge = np.cumsum([0, *(k.size for k, _ in asked)])
        own, number = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
        n = np.bincount(number, np.concatenate([c for _, c in asked]), own.size).astype(np.int64)
        del recs, asked
        if level == 1:
            found = n >= least
        else:
            place, gain, left = Level(own, n, least).find(own)
            found = place >= 0
        # ids by frequency: those that most requests and replies hold are small numbers, which pack well
        kept = np.flatnonzero(found)
        place = np.full(n.size, -1, np.int64)
        place[kept[np.argsort(-n[kept], kind="stable")]] = np.arange(kept.size)
        if place.max(initial=-1) * n_buckets + bucket + 1 >= NONE:
            raise OverflowError("more than 2**32 ids")
        ids = np.where(place >= 0, place * n_buckets + bucket + 1, NONE).astype("<u4")
        columns = (ids, n) if level == 1 else (ids, gain, left) if level == 2 else (gain, left)
        columns = [c.astype(k) for c, k in zip(columns, _KINDS[level], strict=True)]
        out = [_pack(*(c[number[lo:hi]] for c in columns)) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
        trim()
        first = lambda x: pa.array([int(x), *[0] * (len(out) - 1)], pa.int64())
        kind = pa.array([level] * len(out), pa.int32())
        return pa.table({"batch": table.column("batch"), "level": kind, "bucket": table.column("bucket").cast(pa.int32()), "recs": pa.array(out, pa.binary()), "total": first(n.sum()), "distinct": first((n > 0).sum())})

    return answer


class _Batch:
    """A batch's tokens and what the rounds so far have replied."""

    def __init__(self, ids: list, texts: list[bytes], replies: dict[int, dict[int, bytes]], n_buckets: int, least: float, done: int):
        self.h, first, self.doc = tokens(texts)
        train = (~held_out(ids))[self.doc].astype(float)
        self.asked = _Dealt(self.h, train, n_buckets, np.uint64(0))
        if not done:
            return
        ids, self.n = self.asked.replies(replies[1], _KINDS[1])
        word = np.where(self.n >= least, ids, NONE).astype(np.uint64)
        self.gain, self.left, context = [], [], self._before(word, first, START)
        for level in (2, 3):
            ok = np.flatnonzero(context != _LOW)
            self.asked = _Dealt(context[ok] << _SHIFT | word[ok], train[ok], n_buckets, _SHIFT)
            if level > done:
                return
            *ids, g, b = self.asked.replies(replies.get(level, {}), _KINDS[level])
            gain, left, gram = np.zeros(word.size), np.ones(word.size), np.full(word.size, _LOW)
            gain[ok], left[ok] = np.where(g < 65535, _POWER[g], 0), _POWER[b]
            if ids:
                gram[ok] = ids[0]
            self.gain.append(gain)
            self.left.append(left)
            # a trigram whose end isn't a kept bigram isn't kept itself
            context, word = self._before(gram, first, NONE), np.where(gram != _LOW, word, _LOW)

    @staticmethod
    def _before(x: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
        out = np.append(np.uint64(start), x[:-1]) if x.size else x
        out[first] = start
        return out


def _settle(spark) -> None:
    """Release the round's shuffle files before the next one writes its own: the driver's Python lets go of its references a little later than it collects them."""
    for _ in range(3):
        release(spark)
        time.sleep(0.4)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: float = 0, kept: float = 0, least: int = LEAST) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score: add-one unigrams; score: the trie's log10 probability of the whole text, its end included. Null and empty texts are their end alone.
    Texts whose crc32 of the id is 2 modulo 7 are not learned from (a null id counts as an empty one). With no training text at all every token has
    the same probability, 1. Repeated rows are scored alike. Other columns are not read. least: how often a word or n-gram is seen before it has a place in
    the trie; with 1 every one that was seen has. Where given, words (n-grams) with a share of all tokens below
    frequent (kept) take no part in n-grams, however often they are seen.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind, b_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    n_buckets = max(1, shuffles(spark))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_gathered(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}.{number}"]), pa.array([ids], pa.list_(b_type)), pa.array([_pack_texts(texts)], pa.binary())], names=["batch", "ids", "texts"])

    own = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(gather), f"batch string, ids array<{kind}>, texts binary"), "batches", scan=True)
    replies: list[DataFrame] = []
    asks, says = "bucket int, batch string, recs binary", "batch string, level int, bucket int, recs binary, total long, distinct long"

    def rows() -> DataFrame:
        """Batches and the replies to them."""
        both = own.select("batch", "ids", "texts", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("recs"))
        for r in replies:
            both = both.union(r.select("batch", F.lit(None).cast(f"array<{kind}>"), F.lit(None).cast("binary"), "level", "bucket", "recs"))
        return both.groupBy("batch")

    def batch_of(table: pa.Table, least: float, done: int) -> tuple[list, _Batch]:
        found: dict[int, dict[int, bytes]] = {}
        for k, bucket, recs in zip(*(table.column(c).to_pylist() for c in ("level", "bucket", "recs")), strict=True):
            if k is None:
                continue
            found.setdefault(k, {})[bucket] = recs
        at = table.column("level").to_pylist().index(None)
        ids = table.column("ids")[at].as_py()
        texts = _unpack_texts(table.column("texts")[at].as_py())
        return ids, _Batch(ids, texts, found, n_buckets, least, done)

    def first_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, ids, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from _Batch(ids, _unpack_texts(texts), {}, n_buckets, least, 0).asked.requests(name).to_batches()

    replies.append(cut(own.mapInArrow(lean(first_requests), asks).groupBy("bucket").applyInArrow(_answers(1, n_buckets, least), says), "words"))
    total, distinct = (int(x or 0) for x in replies[0].agg(F.sum("total"), F.sum("distinct")).first())
    least_word, least_gram = max(least, frequent * total), max(least, kept * total)

    def requests(done: int):
        return lambda table: batch_of(table, least_word, done)[1].asked.requests(table.column("batch")[0].as_py())

    for level in (2, 3):
        _settle(spark)
        replies.append(cut(rows().applyInArrow(requests(level - 1), asks).groupBy("bucket").applyInArrow(_answers(level, n_buckets, least_gram), says), f"order{level}"))
    _settle(spark)

    def finish(table: pa.Table) -> pa.Table:
        ids, b = batch_of(table, least_word, 3)
        uni = (b.n + 1) / (total + distinct + 1)
        p = b.gain[1] + b.left[1] * (b.gain[0] + b.left[0] * uni)
        add = lambda x=None: np.bincount(b.doc, x, len(ids))
        n = len(ids)
        return pa.table({id_col: pa.array(ids, b_type), "held_out": pa.array(held_out(ids)), "n_tokens": pa.array(add().astype(np.int64)), "n_known": pa.array(add(b.n > 0).astype(np.int64)), "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(add(np.log10(uni))), "score": pa.array(add(np.log10(np.minimum(p, 1))))})

    return rows().applyInArrow(finish, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
