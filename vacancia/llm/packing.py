"""Packing documents into training sequences by cutting-stock column generation.

A document's ids (with an end id) are cut at multiples of the capacity; whole cuts fill a sequence each, and what is left
over (1 to capacity - 1 ids) is an item. Only the histogram of item sizes, which has fewer entries than the capacity
whatever the corpus, goes to the driver. There:

1. a linear program over patterns (how many items of each size share a sequence) is solved by column generation: the
   dual prices go into an unbounded knapsack solved by dynamic programming, whose best filling enters the basis;
2. the solution is rounded down; patterns that fill a sequence exactly are used so often;
3. what rounding leaves over is packed by exact fillings of the remaining items (subset sums, largest item first);
4. items for which there is no exact filling form one stream of ids that is cut at the capacity, its tail at powers of
   two, which need no padding.

Items of one size are ranked (task by task, in the order of the input), and each pattern takes a range of ranks for each
of its sizes. So every document finds its sequence and offset by arithmetic, without a shuffle and without any group
of copies or of equal lengths meeting in one task.

Nulls count as empty texts (one end id). Rows with a null or repeated doc_id are packed like all others. An empty table
gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm import storage, tokens

#: Stop column generation when the objective is within this share of its lower bound, or after so many columns.
GAP, MAX_COLUMNS = 1e-3, 1500
#: Tasks whose first ranks (a number for each size, 8 KB at a capacity of 1024) are broadcast; those of more tasks are joined
#: by a shuffle. Where every item goes is the same.
MAX_BROADCAST_TASKS = 4096

_ITEMS = "part int, doc_id bigint, doc_tokens bigint, start bigint, size int, local_rank bigint, ids binary"
_PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    storage.ship(spark)
    items = storage.written(_items(docs, capacity, tokenizer or tokens.default_tokenizer(), end_id), "items")
    counts = storage.written(items.groupBy("part", "size").agg(F.count("*").alias("n")), "item-counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most one row for each size
        histogram[row["size"]] = row["n"]
    plan = Plan(histogram, capacity)
    bases = _bases(counts, capacity)
    bases = F.broadcast(bases) if counts.select("part").distinct().count() <= MAX_BROADCAST_TASKS else bases.hint("merge")
    rank = F.get("bases", F.col("size")) + F.col("local_rank")
    ranked = items.join(bases, "part").select("doc_id", "doc_tokens", "start", "size", rank.alias("rank"), "ids")
    return ranked.mapInArrow(plan.place, _PIECES)


def _bases(counts: DataFrame, capacity: int) -> DataFrame:
    """part, bases: for each size, how many items of it the tasks before this one have (null: this task has none)."""
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("size", "base"))).alias("m"))  # an entry for each size at most
    return own.select("part", F.transform(F.sequence(F.lit(0), F.lit(capacity)), lambda s: F.try_element_at("m", s)).alias("bases"))


def _items(docs: DataFrame, capacity: int, path: str, end_id: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids, counts = encoder.encode(batch.column(1))
            doc_ids, begin, rows = batch.column(0).to_pylist(), 0, []
            for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
                own = np.append(ids[begin : begin + n], encoder.dtype.type(end_id)).astype("<u4")
                begin += n
                for start in range(0, n + 1, capacity):
                    piece = own[start : start + capacity]
                    rows.append((part, doc_id, n + 1, start, len(piece), int(seen[len(piece)]), piece.tobytes()))
                    seen[len(piece)] += 1
                if len(rows) >= 4096:
                    yield _batch(rows, _ITEM_TYPES)
                    rows = []
            if rows:
                yield _batch(rows, _ITEM_TYPES)

    return docs.select("doc_id", "text").mapInArrow(cut, _ITEMS)


_ITEM_TYPES = [("part", pa.int32()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("local_rank", pa.int64()), ("ids", pa.binary())]
_PIECE_TYPES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _batch(rows: list[tuple], types: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


class Plan:
    """Where the item with a given size and rank goes. Small whatever the corpus: a range for each pattern and size."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        self.capacity = capacity
        rest, sequence = histogram.astype(np.int64).copy(), 0
        used: list[tuple[dict[int, int], int]] = []
        if rest[capacity]:
            used.append(({capacity: 1}, int(rest[capacity])))
            rest[capacity] = 0
        for pattern, times in [*_rounded(rest, capacity), *_exact_fillings(rest, capacity)]:
            used.append((pattern, times))
        # ranges[size]: first rank, first sequence, times, offset of the first slot
        ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        taken = np.zeros(capacity + 1, dtype=np.int64)
        for pattern, times in used:
            offset = 0
            for size, n in sorted(pattern.items(), reverse=True):
                ranges.setdefault(size, []).append((int(taken[size]), sequence, times, offset))
                taken[size] += n * times
                offset += n * size
            sequence += times
        self.ranges = {s: np.array(r, dtype=np.int64) for s, r in ranges.items()}
        self.taken, self.sequence = taken, sequence
        left = (histogram - taken) * np.arange(capacity + 1)
        self.stream = np.concatenate([[0], np.cumsum(left)])[:-1]  # where the items of a size begin in the stream
        total = int(left.sum())
        whole, tail = divmod(total, capacity)
        self.tail = whole * capacity  # from here the stream is cut at powers of two
        self.cuts, at = [], self.tail
        for k in reversed(range(capacity.bit_length())):
            if tail >> k & 1:
                self.cuts.append(at)
                at += 1 << k

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        capacity = self.capacity
        for batch in batches:
            doc_ids, totals, starts, sizes, ranks, ids = (c.to_pylist() for c in batch.columns)
            rows = []
            for doc_id, total, start, size, rank, data in zip(doc_ids, totals, starts, sizes, ranks, ids, strict=True):
                if rank < self.taken[size]:
                    own = self.ranges[size]
                    first, sequence, times, offset = own[np.searchsorted(own[:, 0], rank, side="right") - 1].tolist()
                    slot, copy = divmod(rank - first, times)
                    rows.append((doc_id, start, size, data, total, sequence + copy, offset + slot * size))
                    continue
                at = int(self.stream[size]) + (rank - int(self.taken[size])) * size
                end, done = at + size, 0
                while at < end:
                    if at < self.tail:
                        n, offset = divmod(at, capacity)
                        upto = min(end, (n + 1) * capacity)
                    else:
                        k = int(np.searchsorted(self.cuts, at, side="right")) - 1
                        n, offset = self.tail // capacity + k, at - self.cuts[k]
                        upto = min(end, self.cuts[k + 1] if k + 1 < len(self.cuts) else end)
                    rows.append((doc_id, start + done, upto - at, data[4 * done : 4 * (done + upto - at)], total, self.sequence + n, offset))
                    done += upto - at
                    at = upto
            yield _batch(rows, _PIECE_TYPES)


def _rounded(rest: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns of the linear program that fill a sequence, as often as rounding down allows. Takes them from rest."""
    sizes = np.flatnonzero(rest)
    out = []
    for pattern, x in _linear_program(sizes, rest[sizes].astype(float), capacity) if len(sizes) else []:
        times = int(min([x + 1e-6, *(rest[sizes[i]] // n for i, n in pattern.items())]))
        if times > 0 and sum(int(sizes[i]) * n for i, n in pattern.items()) == capacity:
            out.append(({int(sizes[i]): n for i, n in pattern.items()}, times))
            for i, n in pattern.items():
                rest[sizes[i]] -= n * times
    return out


def _linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Fewest sequences (fractions allowed) that hold the demand: the patterns of the last basis and how often."""
    m = len(sizes)
    inverse, patterns = _first_basis(sizes, demand, capacity)
    x = np.maximum((inverse * demand).sum(axis=1), 0)
    best = float((demand * sizes).sum()) / capacity
    for _ in range(MAX_COLUMNS):
        prices = inverse.sum(axis=0)
        value, pattern = _knapsack(sizes, np.maximum(prices, 0), capacity)
        best = max(best, float((np.maximum(prices, 0) * demand).sum()) / value)
        if value <= 1 + 1e-9 or x.sum() - best <= GAP * x.sum():
            break
        step = sum(n * inverse[:, j] for j, n in pattern.items())
        usable = step > 1e-9
        if not usable.any():
            break
        ratio = np.where(usable, x / np.where(usable, step, 1), np.inf)
        out = int(np.argmin(ratio))
        t = ratio[out]
        x = np.maximum(x - t * step, 0)
        x[out] = t
        patterns[out] = pattern
        row = inverse[out] / step[out]
        step[out] = 0
        inverse -= np.outer(step, row)
        inverse[out] = row
    return list(zip(patterns, x.tolist(), strict=True))


def _first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, list[dict[int, int]]]:
    """Greedy fillings, the largest size first, and the inverse of their matrix.

    Each uses up a size at least, which owns it, and holds but sizes that were left then: the matrix is triangular in
    the order in which sizes are used up, so its inverse comes row by row.
    """
    m, left = len(sizes), demand.copy()
    patterns, order = [{i: int(capacity // sizes[i])} for i in range(m)], []
    for i in reversed(range(m)):
        while left[i] > 0:
            pattern, space, j = {i: 1}, capacity - int(sizes[i]), i
            while j >= 0 and space >= sizes[0]:
                j = min(j, int(np.searchsorted(sizes, space, side="right")) - 1)
                if left[j] > 0:
                    n = int(min(space // sizes[j], left[j] // pattern.get(j, 1) if left[j] >= 1 else 1))
                    pattern[j] = pattern.get(j, 0) + max(1, n)
                    space -= max(1, n) * int(sizes[j])
                j -= 1
            times = min(left[j] / n for j, n in pattern.items())
            owner = None
            for j, n in pattern.items():
                left[j] = 0.0 if left[j] - n * times < 1e-9 else left[j] - n * times
                if left[j] == 0:
                    order.append(j)
                    owner = j if owner is None else owner
            patterns[owner] = pattern
    rows: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for k, pattern in enumerate(patterns):
        for j, n in pattern.items():
            rows[j].append((k, n))
    inverse = np.zeros((m, m))
    for j in order:
        own = dict(rows[j])[j]
        for k, n in rows[j]:
            if k != j:
                inverse[j] -= n * inverse[k]
        inverse[j, j] += 1
        inverse[j] /= own
    return inverse, patterns


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The filling of one sequence with the highest price, by dynamic programming over the capacity."""
    value = np.full(capacity + 1, -1.0)
    price = np.zeros(capacity + 1)
    price[sizes] = prices
    has = np.zeros(capacity + 1, dtype=bool)
    has[sizes] = True
    price[~has] = -1e9
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        v = price[1 : c + 1] + value[c - 1 :: -1]
        k = int(v.argmax())
        if v[k] > value[c - 1]:
            value[c], choice[c] = v[k], k + 1
        else:
            value[c] = value[c - 1]
    at = {int(s): i for i, s in enumerate(sizes)}
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c]:
            pattern[at[int(choice[c])]] = pattern.get(at[int(choice[c])], 0) + 1
            c -= int(choice[c])
        else:
            c -= 1
    return max(float(value[capacity]), 1e-12), pattern


def _exact_fillings(rest: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings of exactly the capacity from what is left, the largest item first. Takes them from rest."""
    out = []
    for size in reversed(range(1, capacity)):
        while rest[size] > 0:
            rest[size] -= 1
            pattern = _subset(rest, capacity - size)
            rest[size] += 1
            if pattern is None:
                break
            pattern[size] = pattern.get(size, 0) + 1
            times = int(min(rest[s] // n for s, n in pattern.items()))
            for s, n in pattern.items():
                rest[s] -= n * times
            out.append((pattern, times))
    return out


def _subset(rest: np.ndarray, target: int) -> dict[int, int] | None:
    """Items of exactly that sum, or None. Bits of an integer tell which sums can be reached."""
    reach, steps = 1, []
    mask = (1 << target + 1) - 1
    for size in reversed(np.flatnonzero(rest[: target + 1]).tolist()):
        n, k = min(int(rest[size]), target // size), 1
        while n > 0:
            take = min(k, n)
            steps.append((size, take, reach))
            reach |= reach << size * take & mask
            n -= take
            k *= 2
        if reach >> target & 1:
            break
    if not reach >> target & 1:
        return None
    pattern: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if not before >> target & 1:
            pattern[size] = pattern.get(size, 0) + take
            target -= size * take
    return pattern


def digest(pieces: DataFrame) -> DataFrame:
    """The ids of each piece as a checksum."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
