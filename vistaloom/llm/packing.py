"""Packing documents into sequences of a fixed number of tokens, as a cutting-stock problem solved by column generation.

Documents are cut at multiples of the capacity; what remains of each is one piece. All that the plan needs of the corpus is
the histogram of piece lengths, which has at most `capacity` rows. Over it a linear program chooses how often to use each
pattern (a multiset of lengths that fits a sequence); patterns are priced by a knapsack dynamic program with the program's
dual values, and the best enters the basis until none improves or the bound is near. Whole parts of the solution are used
as they are, and the few pieces left are packed largest first.

Pieces are ranked within their length by counts per task, summed up ahead of each task, so a length that a third of all
documents have is never in one window. A pattern takes the next ranks of its lengths; where rank r of length l goes is
looked up in a table with a row for each length of each pattern (bounded by the capacity, not by the corpus).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaloom.llm.tokens import BytePairs, default_path
from vistaloom.llm.util import saved, slices

CAPACITY = 2048
#: Column generation ends at this relative distance from its lower bound in whole sequences, when no column improves it, when as
#: many columns as there are lengths have gained less than a tenth of that distance, or when its inverse has lost its digits.
GAP = 0.001
END_OF_TEXT = 1
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, local long"
_RANK_BITS = 48


def _pieces(shared, capacity: int, end: int):
    """The pieces of each document, with a number among the task's pieces of that length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = BytePairs(*shared.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text or "") + tail
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    out.append((doc_id, start, length, zlib.crc32(own), total, part, int(seen[length])))
                    seen[length] += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], [x.split()[0] for x in PIECES.split(", ")])

    return run


# ---- the plan, over the histogram ----------------------------------------------------------------------------


def _fill(left: np.ndarray, capacity: int, must: int) -> np.ndarray:
    """A pattern with `must` and, while they fit, the largest lengths left; no more of a length than is left (1 at least)."""
    pattern = np.zeros(capacity + 1, np.int64)
    room, length = capacity, must
    have = np.flatnonzero(left > 0)
    while True:
        n = min(room // length, max(1, int(left[length])))
        pattern[length] = n
        room -= n * length
        at = np.searchsorted(have, min(room, length - 1), side="right") - 1
        if at < 0 or room == 0:
            return pattern
        length = int(have[at])


def _knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best total value of a pattern, and the pattern. values[l]: of a piece of length l (0 or less: none to be used)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    usable = np.maximum(values, 0)
    for room in range(1, capacity + 1):
        total = usable[1 : room + 1] + best[room - 1 :: -1][:room]
        at = int(total.argmax())
        best[room], choice[room] = total[at], at + 1
    pattern, room = np.zeros(capacity + 1, np.int64), capacity
    while room > 0:
        length = choice[room]
        if usable[length] > 0:
            pattern[length] += 1
        room -= length
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Patterns with their (fractional) numbers of uses that cover demand[l] pieces of each length l exactly, and a lower bound."""
    lengths = np.flatnonzero(demand > 0)
    if not len(lengths):
        return [], 0.0
    # A triangular basis: each pattern uses up a length, and later ones leave it out.
    left, basis, exhausted, uses = demand.astype(float), [], [], []
    for _ in range(len(lengths)):
        have = np.flatnonzero(left > 0)
        if not len(have):
            break
        pattern = _fill(left, capacity, int(have[-1]))
        used = np.flatnonzero(pattern)
        share = left[used] / pattern[used]
        times = share.min()
        gone = used[share <= times * (1 + 1e-12)]
        left[used] -= times * pattern[used]
        left[gone] = 0
        basis.append(pattern)
        exhausted.append(int(gone[0]))
        uses.append(times)
        for other in gone[1:]:
            single = np.zeros(capacity + 1, np.int64)
            single[other] = 1
            basis.append(single)
            exhausted.append(int(other))
            uses.append(0.0)
    place = np.searchsorted(lengths, exhausted)
    rows = np.array(basis, float)[:, exhausted].T  # lower triangular: row i is of the length that pattern i uses up
    forward = np.zeros((len(lengths), len(lengths)))
    for i in range(len(lengths)):
        earlier = np.flatnonzero(rows[i, :i])
        forward[i] = -(rows[i, earlier, None] * forward[earlier]).sum(axis=0)
        forward[i, i] += 1
        forward[i] /= rows[i, i]
    inverse = np.empty_like(forward)
    inverse[:, place] = forward
    amount = np.array(uses)  # as taken above; by the inverse, rounding can swamp them
    bound = float((demand * np.arange(capacity + 1)).sum()) / capacity
    mark, since = amount.sum(), 0
    while True:
        total = amount.sum()
        if total < mark * (1 - gap / 10):
            mark, since = total, 0
        since += 1
        if since > len(lengths):
            break
        if total <= np.ceil(bound - 1e-9) * (1 + gap):
            break
        values = np.zeros(capacity + 1)
        values[lengths] = inverse.sum(axis=0)
        worth, pattern = _knapsack(values, capacity)
        bound = max(bound, total / max(worth, 1.0))
        if worth <= 1 + 1e-9:
            break
        own = np.flatnonzero(pattern[lengths])
        column = (inverse[:, own] * pattern[lengths[own]]).sum(axis=1)
        falls = np.flatnonzero(column > 1e-9)
        if not len(falls):
            break
        out = falls[np.argmin(amount[falls] / column[falls])]
        step = amount[out] / column[out]
        after = np.maximum(amount - step * column, 0)
        after[out] = step
        held = sum(x * p for x, p in zip(after, [*basis[:out], pattern, *basis[out + 1 :]]) if x > 0)
        if after.sum() > total * (1 + 1e-9) or not np.allclose(held, demand, rtol=1e-6, atol=1e-6):
            break  # a column that improves can't raise the total: the inverse has lost its digits, what is held is right
        amount = after
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
        basis[out] = pattern
    return [(p, float(x)) for p, x in zip(basis, amount)], bound


def patterns(demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Whole patterns with their numbers of uses; together they hold demand[l] pieces of each length l."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if left[capacity]:
        full = np.zeros(capacity + 1, np.int64)
        full[capacity] = 1
        out.append((full, int(left[capacity])))
        left[capacity] = 0
    for pattern, amount in sorted(solve(left, capacity)[0], key=lambda x: -x[1]):
        used = np.flatnonzero(pattern)
        times = min(int(amount + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    while len(have := np.flatnonzero(left > 0)):
        pattern = _fill(left, capacity, int(have[-1]))
        used = np.flatnonzero(pattern)
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def _table(plan: list[tuple[np.ndarray, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) with: first rank, copies in a sequence, first sequence, offset of the first copy."""
    taken, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for pattern, times in plan:
        offset = 0
        for length in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[length])
            rows.append(((int(length) << _RANK_BITS) + int(taken[length]), int(taken[length]), n, sequence, offset))
            taken[length] += n * times
            offset += n * int(length)
        sequence += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def _assigned(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, copies, sequence, offset = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1
            place = rank - first[at]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("start"), pa.array(length), batch.column("ids_crc32"), batch.column("doc_tokens"),
                 pa.array(sequence[at] + place // copies[at]), pa.array(offset[at] + place % copies[at] * length)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end: int = END_OF_TEXT) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text; further columns are left out): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the byte-level BPE file `vocabulary` (`ranks` is the same one as ranks), then `end`; a null or empty text is `end` alone.
    start counts the document's ids ahead of the piece, offset the sequence's. No sequence exceeds `capacity`; offsets have
    no gaps. Repeated rows are separate documents. Ids may be null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    files = (vocabulary or default_path("byte_bpe_50k.json"), ranks or default_path("byte_bpe_50k.tiktoken"))
    shared = spark.sparkContext.broadcast(tuple(Path(x).read_text(encoding="utf-8") for x in files))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = saved(texts.mapInArrow(_pieces(shared, capacity, end), PIECES), "pieces")
    counts = saved(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    demand = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `capacity` rows at most
        demand[row.length] = row.n
    table = spark.sparkContext.broadcast(_table(patterns(demand, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["length", "part"]).withColumn("rank", F.col("local") + F.col("ahead"))
    return ranked.mapInArrow(_assigned(table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
