"""Best-fit packing by bin completion: documents, cut only where longer than a sequence, into as few sequences as possible.

How many pieces have each length is all that packing depends on, and there are at most `capacity` lengths; so the search runs over that table, whose size does
not grow with the data, and gives fillings (a multiset of lengths) with multiplicities. It is a branch and bound over sequences: at each step the fillings around
the largest piece left are enumerated, least waste first, without those that another one dominates; a step is left where what is wasted so far and a lower bound
for the rest can't beat the incumbent. Incumbents are best-fit packings of the rest. The search ends when the bound is met, which proves the number of
sequences the least, or when `effort` units of work are spent: every length prepared and every filling or branch looked at counts, dominated ones too, so that the
search ends in a bounded time. Pieces then take places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, text_runs
from .tokenization import WordEncoder, encoder, forget

#: Units of work (see _Work), beyond those of the search's first descent, after which the incumbent is taken; None: it goes on until it is proven the best.
EFFORT = 500_000
#: Units of a filling or branch that is looked at, and how many dominated ones are passed over running.
UNITS, PATIENCE = 10, 500
#: Steps from one best-fit completion to the next.
COMPLETE = 64
Filling = tuple[int, ...]


def reachable(lengths: list[int], count: np.ndarray, room: int) -> list[int]:
    """Bitsets for k = 0..len(lengths): bit s is set where pieces of lengths[k:] (descending) sum to exactly s, for s up to room."""
    mask = (1 << (room + 1)) - 1
    sums = [1] * (len(lengths) + 1)
    for k in range(len(lengths) - 1, -1, -1):
        n, step, bits = lengths[k], 1, sums[k + 1]
        left = min(int(count[n]), room // n)
        while left > 0:  # multiplicities in binary: 1, 2, 4, ... and the rest
            take = min(step, left)
            bits |= (bits << (take * n)) & mask
            left, step = left - take, 2 * step
        sums[k] = bits
    return sums


def _exact(lengths: list[int], count: np.ndarray, sums: list[int], goal: int, largest: int, work: _Work) -> Iterator[Filling]:
    """Multisets of pieces that sum to goal, those of the longest pieces first. No branch is entered that doesn't reach it, nor one in which two or more
    of the pieces are as long together as one that is left over: that one is longer than all that may still come, so every filling of the branch is dominated."""
    mask = (1 << (largest + 1)) - 1
    every = sum(1 << n for n in np.flatnonzero(count[: largest + 1]).tolist())

    def branches(k: int, left: int) -> Iterator[tuple[int, int, int]]:
        for j in range(k, len(lengths)):
            if not sums[j] >> left & 1:
                return
            n = lengths[j]
            for m in range(min(int(count[n]), left // n), 0, -1):
                if sums[j + 1] >> (left - m * n) & 1:
                    yield j, m, left - m * n

    if goal == 0:
        yield ()
        return
    # of each prefix: its branches, sums of any and of several of its pieces, and lengths left over
    stack, chosen = [(branches(0, goal), 0, 0, every)], []
    while stack:
        ways, some, several, spare = stack[-1]
        step = next(ways, None)
        if step is None:
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        j, m, left = step
        n = lengths[j]
        for _ in range(m):
            several = (several | some << n | several << n) & mask
            some = (some | 1 << n | some << n) & mask
        if m == count[n]:
            spare &= ~(1 << n)
        if work.skips(several & spare):
            continue
        if left == 0:
            slack = work.capacity - largest - goal
            if not work.skips(slack > 0 and _smeared(some, min(slack, largest)) & spare):
                yield tuple(n for k, times in [*chosen, (j, m)] for n in [lengths[k]] * times)
            continue
        chosen.append((j, m))
        stack.append((branches(j + 1, left), some, several, spare))


def _smeared(bits: int, most: int) -> int:
    """Every bit moved up by 1, 2, ..., most."""
    out, have = bits << 1, 1
    while have < most:
        step = min(have, most - have)
        out, have = out | out << step, have + step
    return out


@dataclass
class _Work:
    """What a search has looked at: a unit for every length that a step prepares, UNITS for every filling or branch. left: units that remain, or None."""

    capacity: int
    left: int | None = None
    skipped: int = 0

    def skips(self, dominated: int | bool) -> bool:
        """Whether to pass over a filling or branch: where it is dominated, but not more than PATIENCE times running. (Taking a dominated one costs quality alone.)"""
        self.spend(UNITS)
        self.skipped = self.skipped + 1 if dominated and self.skipped < PATIENCE else 0
        return self.skipped > 0

    def spend(self, units: int) -> None:
        if self.left is not None:
            self.left -= units


def fillings(largest: int, count: np.ndarray, capacity: int, most_waste: int | None = None, work: _Work | None = None) -> Iterator[Filling]:
    """Fillings of a sequence that holds a piece of the largest length, by waste, without dominated ones; none that wastes more than most_waste.

    One is dominated where a piece that is left over could take the place of some others in it (all but its largest), being as long as they are or longer, and still
    fit: a packing with it becomes one with the other by an exchange of those pieces, so it need not be tried.
    """
    work = work or _Work(capacity)
    own = count.copy()
    own[largest] -= 1
    room = capacity - largest
    lengths = np.flatnonzero(own[: room + 1])[::-1].tolist()
    work.spend(len(lengths))
    sums = reachable(lengths, own, room)
    least = 0 if most_waste is None else max(0, room - most_waste)
    for goal in range(sums[0].bit_length() - 1, least - 1, -1):
        if sums[0] >> goal & 1:
            yield from ((largest, *rest) for rest in _exact(lengths, own, sums, goal, largest, work))


def fillings_around(largest: int, count: np.ndarray, capacity: int) -> Filling:
    """The least wasteful filling of a sequence that holds a piece of the largest length; among equal ones, that of the longest pieces."""
    return next(fillings(largest, count, capacity))


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over the table of lengths: pieces go, longest first, where they leave least room. (filling, how often)."""
    by_room: list[list[tuple[Filling, int]]] = [[] for _ in range(capacity + 1)]
    for n in np.flatnonzero(count)[::-1].tolist():
        left, room = int(count[n]), n
        while left and room < capacity:
            q = room // n  # as many go into one sequence, which stays the fullest that has room
            while left and by_room[room]:
                filling, m = by_room[room].pop()
                full = min(m, left // q)
                if full < m:
                    over = left - full * q if left < m * q else 0
                    by_room[room].append((filling, m - full - (over > 0)))
                    if by_room[room][-1][1] == 0:
                        by_room[room].pop()
                    if over:
                        by_room[room - over * n].append((filling + (n,) * over, 1))
                    left -= over
                if full:
                    by_room[room - q * n].append((filling + (n,) * q, full))
                    left -= full * q
                if full < m:
                    break
            room += 1
        q = capacity // n
        if left // q:
            by_room[capacity - q * n].append(((n,) * q, left // q))
        if left % q:
            by_room[capacity - left % q * n].append(((n,) * (left % q), 1))
    return [x for row in by_room for x in row]


def least_sequences(count: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences. For every a: pieces over capacity - a are alone, those over half a sequence are apart, and pieces of a or more fill what those leave at best."""
    n = np.arange(capacity + 1)
    pieces, volume = np.cumsum(count), np.cumsum(count * n)
    half, a = capacity // 2, np.arange(capacity // 2 + 1)
    alone = pieces[capacity] - pieces[capacity - a]
    large = pieces[capacity - a] - pieces[half]
    free = large * capacity - (volume[capacity - a] - volume[half])
    small = volume[half] - np.where(a > 0, volume[np.maximum(a - 1, 0)], 0)
    return int((alone + large + np.maximum(0, -((free - small) // capacity))).max())


def least_by_shares(count: np.ndarray, capacity: int, most: int = 24) -> int:
    """No packing has fewer sequences: a bound by dual feasible functions.

    A piece takes floor((k + 1) x) / k of a sequence (x: its share of the capacity; x itself where (k + 1) x is whole), as no sequence holds more than k such
    parts. Before that, for every a, pieces over capacity - a count as a whole sequence and those under a as nothing.
    """
    n, best = np.arange(capacity + 1), 0
    pieces = np.cumsum(count)
    for k in range(1, most + 1):
        share = np.where((k + 1) * n % capacity == 0, n * k, capacity * ((k + 1) * n // capacity))  # in units of 1 / (k * capacity)
        total = np.cumsum(count * share)
        a = np.arange(capacity // 2 + 1)
        parts = (pieces[capacity] - pieces[capacity - a]) * (k * capacity) + total[capacity - a] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
        best = max(best, int(-(-parts.max() // (k * capacity))))
    return best


@dataclass
class _Step:
    """Fillings around the largest piece left, tried one after the other, each as often as it goes and then less often."""

    choices: Iterator[Filling]
    now: Filling = ()
    need: dict[int, int] = field(default_factory=dict)
    times: int = 0


class Packing:
    """The search for `count` (pieces by length, 1..capacity). fillings: (filling, how often); bound: no packing has fewer sequences; proven: nor has any fewer than this one."""

    def __init__(self, count: np.ndarray, capacity: int, effort: int | None = EFFORT):
        self.capacity, self.effort, self.work = capacity, effort, _Work(capacity)
        self.count = count.astype(np.int64).copy()
        self.volume = int((self.count * np.arange(capacity + 1)).sum())
        self.bound = max(least_sequences(self.count, capacity), least_by_shares(self.count, capacity))
        self.fillings = best_fit(self.count, capacity)
        self.sequences = sum(m for _, m in self.fillings)
        self.proven = self.sequences <= self.bound or self._search()

    def _step(self, used: int, after: Filling | None = None) -> _Step:
        """The choices for the largest piece left; after: a filling around it that was given up, so that only later ones are left."""
        largest = int(np.flatnonzero(self.count)[-1])
        waste = (self.sequences - 1 - used) * self.capacity - self.volume
        choices = fillings(largest, self.count, self.capacity, waste, self.work)
        if after is not None and after[0] == largest:
            key = (sum(after), after)
            choices = (f for f in choices if (sum(f), f) < key)
        return _Step(choices)

    def _use(self, step: _Step, times: int) -> None:
        for n, k in step.need.items():
            self.count[n] -= times * k
        self.volume -= times * sum(step.now)

    def _search(self) -> bool:
        """Depth first; whether it came to its end."""
        stack, used, steps = [self._step(0)], 0, 0
        while stack:
            step = stack[-1]
            if step.times > 1:  # once less often, then what comes after
                self._use(step, -1)
                step.times -= 1
                used -= 1
            else:
                if step.times:
                    self._use(step, -1)
                    step.times = 0
                    used -= 1
                step.now = next(step.choices, ())
                if not step.now:
                    stack.pop()
                    continue
                step.need = Counter(step.now)
                step.times = min(int(self.count[n]) // k for n, k in step.need.items())
                self._use(step, step.times)
                used += step.times
            # down from here
            while True:
                steps += 1
                if self.volume == 0:
                    if used < self.sequences:
                        self._take(stack, used, [])
                    break
                if used + least_sequences(self.count, self.capacity) >= self.sequences:
                    break
                if steps % COMPLETE == 0:
                    rest = best_fit(self.count, self.capacity)
                    if used + sum(m for _, m in rest) < self.sequences:
                        self._take(stack, used, rest)
                        if self.sequences <= self.bound:
                            return True
                below = self._step(used, stack[-1].now)
                below.now = next(below.choices, ())
                if not below.now:
                    break
                below.need = Counter(below.now)
                below.times = min(int(self.count[n]) // k for n, k in below.need.items())
                self._use(below, below.times)
                used += below.times
                stack.append(below)
            if self.sequences <= self.bound:
                return True
            if self.effort is not None:
                if self.work.left is None:  # the first descent is over
                    self.work.left = self.effort
                if self.work.left <= 0:
                    return False
        return True

    def _take(self, stack: list[_Step], used: int, rest: list[tuple[Filling, int]]) -> None:
        self.fillings = [(s.now, s.times) for s in stack] + rest
        self.sequences = sum(m for _, m in self.fillings)


def solve(count: np.ndarray, capacity: int, effort: int | None = EFFORT) -> list[tuple[Filling, int]]:
    """(filling, how often) for all pieces; count[n]: pieces of length n, 1..capacity."""
    return Packing(count, capacity, effort).fillings


def places(fillings: list[tuple[Filling, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, first sequence, offset): the pieces of a length by rank, run by run."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in fillings:
        at = 0
        for n in filling:
            r = used.get(n, 0)
            rows.append((n, r, r + times, sequence, at))
            used[n] = r + times
            at += n
        sequence += times
    return rows


def token_pieces(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids array<int>). Null and empty texts are the end id alone; only texts of more than
    capacity tokens, their end included, are cut. Null ids stay null, repeated rows give their pieces again; other columns are not read; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(WordEncoder, shared.value), np.array([end_id], "<u4").tobytes()
        for b in batches:
            names = b.column(0).to_pylist()
            for at, texts in text_runs(b, text_col):
                rows: list[list] = [[], [], [], [], [], []]
                for d, t in zip(names[at : at + len(texts)], texts, strict=True):
                    ids = enc.encode(t) + end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo : lo + 4 * capacity]
                        for col, v in zip(rows, (d, k, lo // 4, len(part) // 4, zlib.crc32(part)), strict=False):
                            col.append(v)
                        if with_ids:
                            rows[5].append(np.frombuffer(part, "<u4").astype(np.int32))
                kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                used = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in list(zip(rows, kinds, strict=True))[:used]], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:used])
        forget()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int = 2048, effort: int | None = EFFORT) -> DataFrame:
    """pieces (with a length column, 1..capacity) with sequence_id and offset. No sequence holds more than capacity, none has a gap.

    Rows are ranked within their length by counts per (length, part of the table), so that no length, however common, is sorted in one task. Ranks follow
    the rows' values, so a task that is run again gives the same ones. Null ids are ids like others; rows that repeat are pieces of their own, each with
    its place. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    tagged = cut(pieces.withColumn("_part", F.spark_partition_id()), "pieces", scan=True)
    by = [c for c, kind in pieces.dtypes if not kind.startswith(("array", "map", "struct")) and c != "length"] or ["length"]
    # files keep a part's rows together; a part is ranked by itself, then moved by what earlier parts have of the same length
    local = tagged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", "length").orderBy(*by)) - 1)
    per_part = tagged.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = per_part.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    table = np.zeros(capacity + 1, np.int64)
    for n, k in per_part.groupBy("length").agg(F.sum("_n")).collect():  # at most `capacity` rows
        table[n] = k
    runs = spark.createDataFrame(places(solve(table, capacity, effort)), "_len long, _from long, _to long, _seq long, offset long")
    ranked = local.join(before, ["length", "_part"]).withColumn("_r", F.col("_before") + F.col("_rank"))
    # runs: a table over lengths, its size bounded by the capacity and the search, not by the data
    met = ranked.join(F.broadcast(runs), (F.col("length") == F.col("_len")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to")))
    return met.select(*pieces.columns, (F.col("_seq") + F.col("_r") - F.col("_from")).alias("sequence_id"), "offset")
