"""Arcs of a similarity graph over vectors, found once and held, so that label propagation makes the products a single time.

A node's arcs lie in one row with those of a few other nodes, so its votes are final where they are read: a round reads the arcs, and what else it needs of
the nodes (a number or three of each) is broadcast. Nodes are counted from 0 by frame, then id; the arcs and numbers refer to these positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaloom.storage import written

#: Nodes at most (of each, 28 bytes are broadcast), values of all vectors (a task has them in memory while arcs are found) and arcs (10 bytes of disk each).
NODES, VALUES, ARCS = 1 << 20, 1 << 26, 5 << 30
#: Arcs of a row, more only if a node has more; vectors that some nodes meet at once; arcs of these nodes, about; how many they are at first, at least, at most.
ROW, WIDTH, MET, LEFT = 1 << 16, 2048, 1 << 21, (64, 16, 512)
#: Rows of a batch.
BATCH = 64
SCHEMA = "own binary, counts binary, low binary, value binary"


def rounded(total: np.ndarray) -> np.ndarray:
    return np.floor(total * 1e9 + 0.5) / 1e9


def waits(loss: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Whether a mover waits, as graph._hindered says."""
    return (loss > 0) & (loss >= gain - 1e-9)


def _wholes(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """mine, frame, quality and vectors of all n nodes, once for each panel of the partition."""
    at = 0
    for batch in batches:
        while len(batch):
            part, batch = batch.slice(0, n - at), batch.slice(n - at)
            flat = part.column("enc").flatten().to_numpy(zero_copy_only=False)
            if not at:
                mine, frame, quality, x = np.empty(n, bool), np.empty(n, np.int64), np.empty(n), np.empty((n, len(flat) // len(part)), flat.dtype)
            to = slice(at, at + len(part))
            for whole, name in ((mine, "mine"), (frame, "frame_num"), (quality, "quality")):
                whole[to] = part.column(name).to_numpy(zero_copy_only=False)
            x[to] = flat.reshape(len(part), -1)
            at += len(part)
            if at == n:
                yield mine, frame, quality, x
                at = 0


def _found(n: int, threshold: float, temporal_weight: float, max_frame_diff: int):
    """The arcs of a panel's own nodes, some nodes at once."""
    first_left, least_left, most_left = LEFT

    def of(own, frame, quality, x, space):
        """row, at, value of the arcs of the nodes `own`, in the order of (row, at)."""
        a, fa, parts = x[own].astype(float), frame[own], []
        known = fa[fa > 0]
        for start in range(0, n, WIDTH):
            b, fb = x[start:start + WIDTH].astype(float), frame[start:start + WIDTH]
            product = np.matmul(a, b.T, out=space[:len(a) * len(b)].reshape(len(a), len(b))).ravel()
            near = bool(len(known)) and bool(((fb > 0) & (fb > known.min() - max_frame_diff) & (fb < known.max() + max_frame_diff)).any())
            at = np.flatnonzero(product >= (0.8 * threshold if near else max(threshold, 0.8 * threshold)))
            w = product[at]
            i, j = np.divmod(at, len(b))
            if near:
                gap = np.abs(fa[i] - fb[j])
                close = (fa[i] > 0) & (fb[j] > 0) & (gap < max_frame_diff)
                w = np.where(close, (1 - temporal_weight) * w + temporal_weight * (1 - gap / max_frame_diff), w)
            j += start
            keep = (w > threshold) & (own[i] != j)
            i, j = i[keep], j[keep]
            parts.append((i.astype(np.uint16), j.astype(np.int32), w[keep] * (0.5 + 0.5 * quality[j])))
        row, at, value = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(row, kind="stable")
        return row[order], at[order], value[order]

    def run(batches):
        space, high = np.empty(most_left * WIDTH), (n - 1 >> 16) + 1
        for mine, frame, quality, x in _wholes(batches, n):
            mine, left = np.flatnonzero(mine), first_left
            while len(mine):
                own, mine = mine[:left], mine[left:]
                row, at, value = of(own, frame, quality, x, space)
                left = int(min(max(MET * len(own) / max(len(row), 1), least_left), most_left))
                ends, first = np.cumsum(np.bincount(row, minlength=len(own))), 0
                while first < len(own):
                    begin = ends[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, begin + ROW, side="right")))
                    rows, arcs = own[first:last], slice(begin, ends[last - 1])
                    counts = np.bincount((row[arcs].astype(np.int64) - first) * high + (at[arcs] >> 16), minlength=len(rows) * high)
                    some = counts.reshape(-1, high).any(axis=1)
                    if some.any():
                        held = rows[some].astype(np.int32).tobytes(), counts.reshape(-1, high)[some].astype(np.uint32).tobytes(), at[arcs].astype(np.uint16).tobytes(), value[arcs].tobytes()
                        yield pa.record_batch([pa.array([v], pa.binary()) for v in held], ["own", "counts", "low", "value"])
                    first = last

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """own (some nodes), how many arcs each has, the arcs' other ends and values."""
    for k in range(len(batch)):
        own, counts, low, value = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("own", np.int32), ("counts", np.uint32), ("low", np.uint16), ("value", np.float64)))
        high = len(counts) // len(own)
        at = np.repeat(np.tile(np.arange(high, dtype=np.int32) << 16, len(own)), counts)
        at += low
        yield own, counts.reshape(-1, high).sum(axis=1, dtype=np.int64), at, value


def _best(degree: np.ndarray, was: np.ndarray, label: np.ndarray, value: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the label (of `labels`, counted from 0) with the greatest sum of values, rounded to 9 places (ties to the smaller), and by how much it exceeds the sum of the
    label that it was. All have arcs."""
    n = len(degree)
    if n * labels <= 4 * len(value) and value.min() > 1e-6:
        total, row = rounded(np.bincount(np.repeat(np.arange(n) * labels, degree) + label, value, n * labels)).reshape(n, labels), np.arange(n)
        best = total.argmax(axis=1)
        return best, total[row, best] - total[row, was]
    bits = int(labels).bit_length()
    key = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(bits + 32), degree)
    key |= label.astype(np.uint64) << np.uint64(32)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    value = value[(key & np.uint64(0xFFFFFFFF)).view(np.int64)]
    key >>= np.uint64(32)
    cell = key.view(np.int64)
    start = np.flatnonzero(np.diff(cell, prepend=-1))
    total, cell = rounded(np.add.reduceat(value, start)), cell[start]
    row = cell >> bits
    start = np.flatnonzero(np.diff(row, prepend=-1))
    most = np.maximum.reduceat(total, start)
    first = np.flatnonzero(total == np.repeat(most, np.diff(np.append(start, len(row)))))
    first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
    mine = (np.arange(n) << bits) + was
    at = np.minimum(np.searchsorted(cell, mine), len(cell) - 1)
    return cell[first] & (1 << bits) - 1, most - np.where(cell[at] == mine, total[at], 0.0)


def _voted(nodes, shared):
    def run(batches):
        ids, (label, labels) = nodes.value, shared.value
        for batch in batches:
            found = []
            for own, degree, at, value in _rows(batch):
                best, gain = _best(degree, label[own], label[at], value, len(labels))
                found.append((ids[own], labels[best], gain))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)], ["node", "new", "gain"])

    return run


def _waiting(nodes, shared):
    def run(batches):
        ids, (label, new, rank, gain) = nodes.value, shared.value
        for batch in batches:
            found = []
            for own, degree, at, value in _rows(batch):
                moves = new[own] >= 0
                if not moves.all():
                    arcs = np.repeat(moves, degree)
                    own, degree, at, value = own[moves], degree[moves], at[arcs], value[arcs]
                wanted, given = np.repeat(new[own], degree) == label[at], new[at] == np.repeat(label[own], degree)
                hit = np.flatnonzero(wanted | given)
                row = np.repeat(np.arange(len(own)), degree)[hit]
                before = rank[at[hit]] < rank[own[row]]
                hit, row = hit[before], row[before]
                found.append(ids[own[waits(np.bincount(row, value[hit] * (1.0 * wanted[hit] + given[hit]), len(own)), gain[own])]])
            if found:
                yield pa.record_batch([pa.array(np.concatenate(found))], ["node"])

    return run


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows of arcs are large: meanwhile Parquet is read, and passed to Python, by BATCH of them."""
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, str(BATCH))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Arcs:
    """The held arcs of nodes (node, frame_num, quality, enc; node unique, frames and qualities known), for graph.settled. What vote() and hindered() return is read before the next call of the same."""

    def __init__(self, nodes: DataFrame, panels: int, threshold: float, temporal_weight: float, max_frame_diff: int):
        spark = nodes.sparkSession
        known = nodes.select("node", "frame_num").toArrow()
        ids = known.column("node").to_numpy()
        ids = ids[np.lexsort((ids, known.column("frame_num").to_numpy()))]
        self.by_id = np.argsort(ids)
        self.ids = ids[self.by_id]
        self.send, self.nodes, self.sent = spark.sparkContext.broadcast, spark.sparkContext.broadcast(ids), {}
        own = F.pmod(F.xxhash64("node"), F.lit(panels)).cast("int")
        every = nodes.withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(panels - 1)))).select("panel", (own == F.col("panel")).alias("mine"), "node", "frame_num", "quality", "enc")
        whole = every.repartitionById(panels, "panel").sortWithinPartitions("panel", "frame_num", "node")
        self.held = written(whole.mapInArrow(_found(len(ids), threshold, temporal_weight, max_frame_diff), SCHEMA), "arcs", compression="none")

    def _at(self, ids: pa.ChunkedArray) -> np.ndarray:
        """Positions of ids (labels are ids, too)."""
        return self.by_id[np.searchsorted(self.ids, ids.to_numpy())]

    def _run(self, step: Callable, values: tuple, schema: str) -> DataFrame:
        if step in self.sent:
            self.sent[step].destroy()
        self.sent[step] = self.send(values)
        return self.held.mapInArrow(step(self.nodes, self.sent[step]), schema)

    def vote(self, labels: DataFrame) -> DataFrame:
        """node, new, gain: what graph._vote says."""
        rows = labels.select("node", "label").toArrow()
        label = np.empty(len(self.ids), np.int64)
        label[self._at(rows.column("node"))] = rows.column("label").to_numpy()
        names, label = np.unique(label, return_inverse=True)
        return self._run(_voted, (label.astype(np.int32), names), "node long, new long, gain double")

    def hindered(self, movers: DataFrame) -> DataFrame:
        """node: what graph._hindered says."""
        rows = movers.select("node", "label", "new", "rank", "gain").toArrow()
        from_, to = (self._at(rows.column(c)) for c in ("label", "new"))
        met = np.isin(from_, to) | np.isin(to, from_)  # the others hinder nobody and aren't hindered
        if not met.any():
            return movers.sparkSession.createDataFrame([], "node long")
        at = self._at(rows.column("node"))[met]
        label, new, rank = (np.full(len(self.ids), -1, np.int32) for _ in range(3))
        label[at], new[at], gain = from_[met], to[met], np.zeros(len(self.ids))
        rank[at] = np.unique(rows.column("rank").to_numpy()[met], return_inverse=True)[1]
        gain[at] = rows.column("gain").to_numpy()[met]
        return self._run(_waiting, (label, new, rank, gain), "node long")

    def close(self) -> None:
        for shared in (self.nodes, *self.sent.values()):
            shared.destroy()
