"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts earlier in the corpus.

Comparing all suffixes of a corpus is out of reach; comparing those at anchors is enough.
1. An anchor is the place of the smallest k-gram hash of a string of `length` bytes; equal strings have it at the same place. So two
   equal strings meet at an anchor with the same k-gram. Each document sends its anchors' hashes, packed; hashes found once need no more work.
2. Around every anchor whose hash occurs again, the context (the w - 1 bytes before, the `length` bytes after it) is sent, packed, by hash. Of equal
   contexts in one batch only the first travels: the others are whole copies.
3. Contexts are suffix-sorted to the right, and their reversed left sides too, by deep-shallow sorting: multikey quicksort on 8-byte words to a shallow depth,
   then blind tries for the groups whose common prefix is longer. With both orders and their common prefix lengths, a string that starts o bytes before an anchor
   equals another exactly where both agree on at least o bytes to the left and length - o to the right; the first one in corpus order stays.
4. Each document's spans are merged, cut out and counted.
An anchor that occurs MANY times or more (a frequent passage) would gather too many contexts in one task. Such contexts are told apart by more bytes: for every
RANGE offsets o, all strings that start o bytes before the anchor share all but RANGE - 1 of their bytes. The context, cut to what these strings need, is sent by the
hash of those shared bytes, so that equal strings still meet, all others spread, and the same sorting decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, packed, ragged, random_table, shuffles, texts_of

GRAM = 32
MANY = 4096
#: Offsets that travel together where an anchor is frequent.
RANGE = 8
#: Suffixes are sorted on this many 8-byte words before blind tries take over.
SHALLOW = 4
#: Bytes of text whose records travel together.
BATCH = 16 << 20
_T1 = random_table(7)


# ---------------------------------------------------------------------------------------------------------------- anchors


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place on (GRAM is a power of two), by doubling."""
    h, size, base = _T1[raw], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    return mix64(h)


def anchors(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all whole strings of `length` bytes inside the texts that start at `at`, and their hashes. Ascending."""
    w, step = length - GRAM + 1, 1 << 18
    found, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for lo in range(0, max(0, raw.size - length + 1), step):
        hi = min(raw.size, lo + step + length - 1)
        h = gram_hashes(raw[lo:hi])
        low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(h.size, dtype=np.uint64)
        m, size = low, 1
        while 2 * size <= w:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < w:
            m = np.minimum(m[: m.size - (w - size)], m[w - size :])
        start = lo + np.arange(m.size)
        doc = np.searchsorted(at, start, side="right") - 1
        m = m[start + length <= at[doc + 1]]
        if m.size:
            p = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
            p = np.unique(p[np.append(True, p[1:] != p[:-1])])
            found.append(lo + p)
            hashes.append(h[p])
    p, h = np.concatenate(found), np.concatenate(hashes)
    keep = np.append(True, p[1:] != p[:-1])[: p.size]
    p, h = p[keep], h[keep]
    order = np.argsort(p, kind="stable")
    p, h = p[order], h[order]
    keep = np.append(True, p[1:] != p[:-1])[: p.size]
    return p[keep], h[keep]


# ------------------------------------------------------------------------------------------------------- deep-shallow sorting


def _word(rows: np.ndarray, k: int) -> np.ndarray:
    return rows[:, 8 * k : 8 * k + 8].copy().view(">u8")[:, 0].astype(np.uint64)


def multikey_quicksort(rows: np.ndarray, words: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of equal-length byte rows by their first `words` 8-byte words, and the runs (from, to) that are equal so far.

    All segments are partitioned three ways around their middle element at once; the equal part goes on with the next word.
    """
    order = np.arange(len(rows))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    seg = (np.array([0]), np.array([len(rows)]), np.array([0]))
    cache = np.stack([_word(rows, k) for k in range(words)], 1) if len(rows) else np.zeros((0, words), np.uint64)
    while seg[0].size:
        lo, hi, depth = seg
        big = hi - lo > 1
        lo, hi, depth = lo[big], hi[big], depth[big]
        end = depth >= words
        done.append((lo[end], hi[end]))
        lo, hi, depth = lo[~end], hi[~end], depth[~end]
        if not lo.size:
            break
        n = hi - lo
        place = ragged(lo, n)
        owner = np.repeat(np.arange(lo.size), n)
        key = cache[order[place], depth[owner]]
        pivot = cache[order[(lo + hi) // 2], depth]
        side = (key > pivot[owner]).astype(np.int8) - (key < pivot[owner]).astype(np.int8)
        turn = np.argsort(owner * 4 + side + 1, kind="stable")
        order[place] = order[place][turn]
        less = np.bincount(owner[side < 0], minlength=lo.size)
        same = np.bincount(owner[side == 0], minlength=lo.size)
        a, b = lo + less, lo + less + same
        seg = (np.concatenate([lo, a, b]), np.concatenate([a, b, hi]), np.concatenate([depth, depth + 1, depth]))
    runs = sorted((int(x), int(y)) for los, his in done for x, y in zip(los, his, strict=True))
    return order, runs


def blind_trie_order(tails: list[bytes]) -> list[int]:
    """Order of equal-length strings by a blind trie: inner nodes hold only the place where their branches part, and one string below them.

    A string goes down without comparing what was skipped, is then compared with the leaf it reaches, and branches off where they differ.
    """
    same: dict[bytes, list[int]] = {}
    for i, t in enumerate(tails):
        same.setdefault(t, []).append(i)
    keys = list(same)
    if len(keys) == 1:
        return same[keys[0]]
    root: list = [-1, keys[0]]  # a leaf: [-1, string]; an inner node: [place, {byte: child}]
    for key in keys[1:]:
        node = root
        while node[0] >= 0:
            node = node[1].get(key[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        x = int.from_bytes(key, "big") ^ int.from_bytes(other, "big")
        at = len(key) - (x.bit_length() + 7) // 8
        node = root
        while 0 <= node[0] < at:
            node = node[1][key[node[0]]]
        if node[0] == at:
            node[1][key[at]] = [-1, key]
        else:
            below = list(node)
            node[:] = [at, {other[at]: below, key[at]: [-1, key]}]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += same[node[1]]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal-length byte rows, and in that order the length of the prefix each shares with the one before (0 for the first)."""
    n, width = rows.shape
    pad = np.zeros((n, -(-width // 8) * 8), np.uint8)
    pad[:, :width] = rows
    order, runs = multikey_quicksort(pad, min(SHALLOW, pad.shape[1] // 8))
    if pad.shape[1] > 8 * SHALLOW:
        deep = np.ascontiguousarray(pad[:, 8 * SHALLOW :])
        for lo, hi in runs:
            ids = order[lo:hi]
            blob, size = deep[ids].tobytes(), deep.shape[1]
            order[lo:hi] = ids[blind_trie_order([blob[i * size : (i + 1) * size] for i in range(hi - lo)])]
    lcp = np.zeros(n, np.int64)
    for i in range(1, n, 1 << 14):
        a, b = pad[order[i - 1 : min(n, i + (1 << 14)) - 1]], pad[order[i : min(n, i + (1 << 14))]]
        differ = a != b
        lcp[i : i + len(b)] = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.minimum(lcp, width)


def first_and_last(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every context the largest and smallest o whose string (o bytes before the anchor on) also starts at an earlier place, or -1.

    left: reversed bytes before the anchor; right: bytes from the anchor on; n_left, n_right: how many of them are there; place: rank in
    corpus order, equal for contexts at one place of one document id.
    """
    n = len(place)
    ro, rl = deep_shallow(right)
    lo, ll = deep_shallow(left)
    most, least = np.full(n, -1), np.full(n, -1)
    rid, lid = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(left.shape[1] + 1):
        ok = np.flatnonzero((n_left >= o) & (n_right >= length - o))
        if ok.size < 2:
            continue
        rid[ro] = np.cumsum(rl < length - o)
        lid[lo] = np.cumsum(ll < o) if o else 0
        key = rid[ok] * (n + 1) + lid[ok]
        turn = np.lexsort((place[ok], key))
        key, where = key[turn], place[ok][turn]
        head = np.append(True, key[1:] != key[:-1])
        first = where[np.maximum.accumulate(np.where(head, np.arange(key.size), 0))]
        again = ok[turn[where > first]]
        most[again] = o
        least[again[least[again] < 0]] = o
    return most, least


# ------------------------------------------------------------------------------------------------------------- distributed flow

#: Anchors travel by columns (48 bits of hash, document, place), compressed; false matches of the shorter hash only cost a context.
_ANCHOR = np.dtype([("h", "<u8"), ("doc", "<u4"), ("pos", "<u4")])
_FOUND = np.dtype([("pos", "<u4"), ("many", "u1")])
_SPAN = np.dtype([("lo", "<u4"), ("hi", "<u4")])
_NULL = -(1 << 63)


def _part(length: int) -> np.dtype:
    """A context's record; nl and nr, the bytes that its text has to the left and right, are at most length."""
    side = "u1" if length < 1 << 8 else "<u2" if length < 1 << 16 else "<u4"
    return np.dtype([("h", "<u8"), ("doc", "<u4"), ("pos", "<u4"), ("nl", side), ("nr", side)])


def _tagged(body: np.ndarray, nl: np.ndarray, nr: np.ndarray) -> list[bytes]:
    """Each row's bytes with its nl and nr behind them."""
    sides = np.ascontiguousarray(np.stack([nl, nr], 1), "<u4").view(np.uint8)
    rows = np.concatenate([body, sides], 1)
    return rows.view(f"V{rows.shape[1]}")[:, 0].tolist()


def _groups(batches: Iterator[pa.RecordBatch], most: int, text_col: str = "text"):
    """(keys, texts, other columns) of batches gathered to about `most` bytes."""
    keys, texts, more, size = [], [], [], 0
    for b in batches:
        part = texts_of(b, text_col)
        rest = [b.column(i).to_pylist() for i in range(3, b.num_columns)]
        for i, (d, t, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), part, strict=True)):
            keys.append((_NULL if d is None else d, t))
            texts.append(x)
            more.append([r[i] for r in rest])
            size += len(x)
            if size >= most:
                yield keys, texts, more
                keys, texts, more, size = [], [], [], 0
    if keys:
        yield keys, texts, more


def _by_bucket(bucket: np.ndarray, n: int):
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in range(n):
        if edge[k] < edge[k + 1]:
            yield k, order[edge[k] : edge[k + 1]]


def _docs_blob(keys: list[tuple[int, int]], used: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The documents that records refer to, as (id, text hash) pairs, and the records' numbers among them."""
    own, number = np.unique(used, return_inverse=True)
    table = np.array([keys[i] for i in own.tolist()], np.int64).reshape(-1, 2)
    return _squeeze(table[:, 0].tobytes() + table[:, 1].tobytes()), number.astype(np.uint32)


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _spread(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _columns(rec: np.ndarray) -> bytes:
    """Anchors by columns: the hash bytes that vary, documents, and places as differences."""
    h = rec["h"].copy().view(np.uint8).reshape(-1, 8)[:, :6]
    step = np.diff(rec["pos"].astype(np.int64), prepend=0).astype("<i4")
    planes = [np.ascontiguousarray(rec["doc"].copy().view(np.uint8).reshape(-1, 4).T), np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T)]
    return len(rec).to_bytes(8, "little") + h.tobytes() + _squeeze(planes[0].tobytes() + planes[1].tobytes())


def _records(raw: bytes) -> bytes:
    n = int.from_bytes(raw[:8], "little")
    rec = np.zeros(n, _ANCHOR)
    rec["h"] = np.pad(np.frombuffer(raw, np.uint8, 6 * n, 8).reshape(n, 6), ((0, 0), (0, 2))).view("<u8")[:, 0]
    planes = np.frombuffer(_spread(raw[8 + 6 * n :]), np.uint8).reshape(2, 4, n)
    rec["doc"] = np.ascontiguousarray(planes[0].T).view("<u4")[:, 0]
    rec["pos"] = np.cumsum(np.ascontiguousarray(planes[1].T).view("<i4")[:, 0].astype(np.int64))
    return rec.tobytes()


def _gather(rows: list[tuple[bytes, bytes]], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Records of packed rows with their documents' numbers in one common table of (id, text hash)."""
    tables = []
    for d, _ in rows:
        raw = _spread(d)
        tables.append(np.ascontiguousarray(np.frombuffer(raw, np.int64).reshape(2, -1).T))
    table, number = np.unique(np.concatenate(tables), axis=0, return_inverse=True) if tables else (np.empty((0, 2), np.int64), np.empty(0, int))
    number = number.reshape(-1)
    parts, base = [], 0
    for t, (_, r) in zip(tables, rows, strict=True):
        x = np.frombuffer(r, kind).copy()
        x["doc"] = number[base + x["doc"].astype(np.int64)]
        base += len(t)
        parts.append(x)
    return table, np.concatenate(parts) if parts else np.empty(0, kind)


def _emit(table: np.ndarray, doc: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row per document: id, text hash, its values packed."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    own, first = np.unique(doc, return_index=True)
    ends = np.append(first, doc.size)[1:]
    return pa.RecordBatch.from_arrays([pa.array(table[own, 0], pa.int64()), pa.array(table[own, 1], pa.int64()), pa.array([values[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], names=["id", "th", "v"])


def _merge_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union, ascending; spans that touch are one run."""
    if not spans.size:
        return spans
    spans = np.sort(spans, order=["lo", "hi"])
    reach = np.maximum.accumulate(spans["hi"])
    head = np.append(True, spans["lo"][1:] > reach[:-1])
    out = np.empty(int(head.sum()), _SPAN)
    out["lo"], out["hi"] = spans["lo"][head], reach[np.append(np.flatnonzero(head)[1:] - 1, spans.size - 1)]
    return out


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", many: int = MANY, carry: list[str] | None = None) -> DataFrame:
    """docs' id, th (text hash), text, spans (packed (lo, hi) byte ranges to remove, unmerged; null if none) and rest (struct of the columns in carry)."""
    w, n_buckets = length - GRAM + 1, 2 * max(1, shuffles(docs.sparkSession))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    more_cols = ["rest"] if carry else []

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, _ in _groups(batches, BATCH):
            raw, at = packed(texts)
            p, h = anchors(raw, at, length)
            doc = np.searchsorted(at, p, side="right") - 1
            rec = np.empty(p.size, _ANCHOR)
            rec["h"], rec["pos"] = h >> np.uint64(16), p - at[doc]
            for k, pick in _by_bucket((h % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                blob, number = _docs_blob(keys, doc[pick])
                part = rec[pick]
                part["doc"] = number
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary()), pa.array([_columns(part)], pa.binary())], names=["bucket", "docs", "recs"])

    def find_again(table: pa.Table) -> pa.Table:
        tab, rec = _gather([(d, _records(r)) for d, r in zip(table.column("docs").to_pylist(), table.column("recs").to_pylist(), strict=True)], _ANCHOR)
        _, number, count = np.unique(rec["h"], return_inverse=True, return_counts=True)
        n = count[number]
        rec, n = rec[n > 1], n[n > 1]
        out = np.empty(rec.size, _FOUND)
        out["pos"], out["many"] = rec["pos"], n >= many
        return pa.Table.from_batches([_emit(tab, rec["doc"].astype(np.int64), out)])

    packed_schema = "id long, th long, v binary"
    sent = base.select("id", "th", "text").mapInArrow(lean(send_anchors), "bucket int, docs binary, recs binary")
    again = sent.groupBy("bucket").applyInArrow(find_again, packed_schema).groupBy("id", "th").agg(F.collect_list("v").alias("found"))
    texts = base  # both joins below ask for the same exchange of it, which runs once
    joined = texts.join(again, ["id", "th"], "left").select("id", "th", "text", "found", *more_cols)  # both branches read the same columns, so that the texts are shuffled once

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, more in _groups(batches, BATCH):
            have = [i for i, m in enumerate(more) if m[0]]
            if not have:
                continue
            keys, texts, found = [keys[i] for i in have], [texts[i] for i in have], [np.frombuffer(b"".join(more[i][0]), _FOUND) for i in have]
            raw, at = packed(texts)
            pos = np.concatenate([f["pos"] for f in found]).astype(np.int64)
            flag = np.concatenate([f["many"] for f in found]).astype(bool)
            doc = np.repeat(np.arange(len(found)), [f.size for f in found])
            p = at[doc] + pos
            nl, nr = np.minimum(pos, w - 1), np.minimum(at[doc + 1] - p, length)
            wide = np.concatenate([np.zeros(w - 1, np.uint8), raw, np.zeros(length, np.uint8)])
            view = np.lib.stride_tricks.sliding_window_view(wide, w - 1 + length)
            # documents in corpus order, so that the first of equal contexts is the earliest
            rank = np.empty(len(keys), np.int64)
            ids = np.array([k[0] for k in keys])
            rank[np.argsort(ids, kind="stable")] = np.arange(len(keys))
            order = np.lexsort((pos, rank[doc]))
            doc, pos, p, nl, nr, flag = (x[order] for x in (doc, pos, p, nl, nr, flag))
            spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo in range(0, p.size, 1 << 17):
                s = slice(lo, lo + (1 << 17))
                body = view[p[s]].copy()
                col = np.arange(w - 1 + length)
                body[(col < (w - 1 - nl[s])[:, None]) | (col >= (w - 1 + nr[s])[:, None])] = 0
                seen: dict[bytes, int] = {}
                first = np.fromiter((seen.setdefault(x, i) for i, x in enumerate(_tagged(body, nl[s], nr[s]))), np.int64, len(body))
                d, q = doc[s], pos[s]
                copy = (first != np.arange(len(body))) & ((ids[d[first]] < ids[d]) | (ids[d[first]] == ids[d]) & (q[first] < q))
                least, most = np.maximum(0, length - nr[s]), nl[s]
                use = copy & (least <= most)
                spans.append((d[use], (q - most)[use], (q - least + length)[use]))
                stay = ~copy & (least <= most)
                rec = np.empty(int(stay.sum()), _part(length))
                h = gram_hashes_at(view, p[s][stay], w)
                rec["h"], rec["pos"], rec["nl"], rec["nr"] = h, q[stay], nl[s][stay], nr[s][stay]
                d, body, hot = d[stay], body[stay], flag[s][stay]
                yield from _send(keys, d[~hot], rec[~hot], body[~hot], (h[~hot] % np.uint64(n_buckets)).astype(np.int64))
                if hot.any():
                    yield from _send_ranges(keys, ids, d[hot], rec[hot], body[hot], spans)
            if spans:
                d = np.concatenate([x[0] for x in spans])
                if d.size:
                    v = np.empty(d.size, _SPAN)
                    v["lo"], v["hi"] = np.concatenate([x[1] for x in spans]), np.concatenate([x[2] for x in spans])
                    done = _emit(np.array(keys, np.int64).reshape(-1, 2), d, v)
                    for i in range(done.num_rows):
                        yield _row(int(done.column(1)[i].as_py()) % n_buckets, 2, np.array([done.column(0)[i].as_py(), done.column(1)[i].as_py()], np.int64).tobytes(), _merge_spans(np.frombuffer(done.column(2)[i].as_py(), _SPAN)).tobytes())

    def _row(bucket: int, kind: int, blob: bytes, recs: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary()), pa.array([recs], pa.binary())], names=["bucket", "kind", "docs", "recs"])

    def _send(keys, d, rec, body, bucket):
        for k, pick in _by_bucket(bucket, n_buckets):
            blob, number = _docs_blob(keys, d[pick])
            part = rec[pick]
            part["doc"] = number
            yield _row(k, 0, blob, _squeeze(part.tobytes() + body[pick].tobytes()))

    def _send_ranges(keys, ids, d, rec, body, spans):
        """Contexts of frequent anchors, cut for RANGE offsets at a time; d is in corpus order, so the first of equal ones is the earliest."""
        power = np.array([pow(0xB5297A4D2F8C1E63, i, 1 << 64) for i in range(length)], np.uint64)
        nl, nr, pos = (rec[c].astype(np.int64) for c in ("nl", "nr", "pos"))
        for lo in range(0, w, RANGE):
            hi = min(lo + RANGE, w) - 1
            # offsets lo..hi that the text has bytes for
            most, least = np.minimum(nl, hi), np.maximum(lo, length - nr)
            ok = np.flatnonzero(least <= most)
            if not ok.size:
                continue
            most, least = most[ok], least[ok]
            part = np.zeros((ok.size, w - 1 + length), np.uint8)
            part[:, w - 1 - hi : w - 1 + length - lo] = body[ok, w - 1 - hi : w - 1 + length - lo]
            left, right = most, np.minimum(nr[ok], length - lo)
            seen: dict[bytes, int] = {}
            first = np.fromiter((seen.setdefault(x, i) for i, x in enumerate(_tagged(part, left, right))), np.int64, ok.size)
            own, at = d[ok], pos[ok]
            copy = (ids[own[first]] < ids[own]) | (ids[own[first]] == ids[own]) & (at[first] < at)
            spans.append((own[copy], (at - most)[copy], (at - least + length)[copy]))
            new = first == np.arange(ok.size)
            stay = np.flatnonzero(new | ~copy)
            out = rec[ok[stay]]
            out["nl"], out["nr"] = left[stay], right[stay]
            shared = part[stay, w - 1 - lo : w - 1 + length - hi]
            h = mix64((_T1[shared] * power[: shared.shape[1]]).sum(1) + np.uint64(lo))
            yield from _send(keys, own[stay], out, part[stay], (h % np.uint64(n_buckets)).astype(np.int64))

    def resolve(table: pa.Table) -> pa.Table:
        kinds, docs_, recs = (table.column(c).to_pylist() for c in ("kind", "docs", "recs"))
        out = []
        for d, r in ((d, r) for k, d, r in zip(kinds, docs_, recs, strict=True) if k == 2):
            out.append(_emit(np.frombuffer(d, np.int64).reshape(1, 2), np.zeros(len(r) // _SPAN.itemsize, np.int64), np.frombuffer(r, _SPAN)))
        width, kind_of = w - 1 + length, _part(length)
        rows = []
        bodies = []
        for d, r in ((d, r) for k, d, r in zip(kinds, docs_, recs, strict=True) if k == 0):
            r = _spread(r)
            n = len(r) // (kind_of.itemsize + width)
            rows.append((d, r[: n * kind_of.itemsize]))
            bodies.append(np.frombuffer(r, np.uint8, offset=n * kind_of.itemsize).reshape(n, width))
        if rows:
            tab, rec = _gather(rows, kind_of)
            body = np.concatenate(bodies)
            ids, pos = tab[rec["doc"].astype(np.int64), 0], rec["pos"].astype(np.int64)
            order = np.lexsort((pos, ids))
            step = np.append(False, (ids[order][1:] != ids[order][:-1]) | (pos[order][1:] != pos[order][:-1]))
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(step)
            most, least = first_and_last(np.ascontiguousarray(body[:, : w - 1][:, ::-1]), body[:, w - 1 :], rec["nl"].astype(np.int64), rec["nr"].astype(np.int64), place, length)
            hit = np.flatnonzero(most >= 0)
            v = np.empty(hit.size, _SPAN)
            v["lo"], v["hi"] = pos[hit] - most[hit], pos[hit] - least[hit] + length
            out.append(_emit(tab, rec["doc"][hit].astype(np.int64), v))
        out = [b for b in out if b.num_rows]
        return pa.Table.from_batches(out or [_emit(np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, _SPAN))])

    spans = joined.mapInArrow(lean(send_contexts), "bucket int, kind int, docs binary, recs binary").groupBy("bucket").applyInArrow(resolve, packed_schema).groupBy("id", "th").agg(F.collect_list("v").alias("spans"))
    return texts.join(spans, ["id", "th"], "left").select("id", "th", "text", "spans", *more_cols)


def gram_hashes_at(view: np.ndarray, p: np.ndarray, w: int) -> np.ndarray:
    """The k-gram hash at each anchor, from the windows that hold it."""
    if not p.size:
        return np.empty(0, np.uint64)
    h, size = _T1[view[p][:, w - 1 : w - 1 + GRAM]], 1
    while size < GRAM:
        h = h[:, :-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + h[:, size:]
        size *= 2
    return mix64(h[:, 0])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """One row per document: id, kept (the remaining bytes), spans (removed runs as (lo, hi) structs), n_bytes.

    Corpus order is (id, start); rows with equal ids are one document in it, so that equal starts of theirs do not count as earlier. Null ids come first (as the smallest 64-bit integer).
    Null texts are empty. length must be over GRAM; there is no upper limit. Other columns are not read. The remaining bytes may end inside a character.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, runs, size = [], [], []
            for t, v in zip(texts_of(b, "text"), b.column(2).to_pylist(), strict=True):
                s = _merge_spans(np.frombuffer(b"".join(v or ()), _SPAN))
                at, parts = 0, []
                for lo, hi in s.tolist():
                    parts.append(t[at:lo])
                    at = hi
                kept.append(b"".join([*parts, t[at:]]))
                runs.append([{"lo": lo, "hi": hi} for lo, hi in s.tolist()])
                size.append(len(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(size, pa.int64())], names=[id_col, "kept", "spans", "n_bytes"])

    return repeated_spans(docs, length, id_col, text_col, many).select(F.when(F.col("id") != _NULL, F.col("id")).cast(kind).alias("id"), "text", "spans").mapInArrow(lean(finish), f"`{id_col}` {kind}, kept binary, spans array<struct<lo:long,hi:long>>, n_bytes long")


def cut_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """docs with each text's repeated bytes removed; characters go only as a whole. Columns and rows as they were; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, raw, v in zip(b.column(2).to_pylist(), texts_of(b, "text"), b.column(3).to_pylist(), strict=True):
                if t is None or not v:
                    out.append(t)
                    continue
                at, parts = 0, []
                for lo, hi in _merge_spans(np.frombuffer(b"".join(v), _SPAN)).tolist():
                    while lo < hi and raw[lo] & 0xC0 == 0x80:
                        lo += 1
                    while hi < len(raw) and hi > lo and raw[hi] & 0xC0 == 0x80:
                        hi -= 1
                    parts.append(raw[at:lo])
                    at = hi
                out.append(b"".join([*parts, raw[at:]]).decode())
            rest = b.column(4)
            cols = dict(zip([f.name for f in rest.type], rest.flatten(), strict=True)) | {text_col: pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in docs_columns], names=docs_columns)

    docs_columns = docs.columns
    return repeated_spans(docs, length, id_col, text_col, many, [c for c in docs_columns if c != text_col]).mapInArrow(lean(run), docs.schema)


def removal_digest(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of what remove_repeats returns."""
    return kept.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


__all__ = ["blind_trie_order", "deep_shallow", "first_and_last", "cut_repeats", "multikey_quicksort", "remove_repeats", "removal_digest", "repeated_spans"]
