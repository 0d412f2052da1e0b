"""Parallel prefix scans: running values along an order of rows, however long one key's stretch is.

Rows are dealt by range partitions over key and order, so a hot key is spread over many tasks. Each task scans its own rows as if
nothing came before, with state of a few numbers. The task's last value is then handed to the partitions behind it (a
row for each partition, combined on the driver) and applied to the rows that go on with the same key.

exponential() folds row by row in the very arithmetic of a loop: a partition is folded from nothing first, and its first key's rows again from the value they go on from.

A step of a scan is an affine map y -> a * y + b, which composes: sums are a = 1, exponential smoothing is a = 1 - alpha, a value
carried along is a = 0 where there is a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaloom.storage import written


def ordered(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """rows dealt by ranges of keys and order and sorted in each partition (nulls first)."""
    by = [*keys, *order]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def _starts(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """(where a new key begins, the last row's key). last: the key of the row before the batch."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        column = batch.column(k)
        if pa.types.is_floating(column.type):
            raise TypeError("keys of a scan can't be floating point")
        a, b = column.slice(0, n - 1), column.slice(1)
        differs = pc.not_equal(a, b)
        differs = pc.if_else(pc.is_null(differs), pc.xor(pc.is_null(a), pc.is_null(b)), differs)
        new[1:] |= differs.to_numpy(zero_copy_only=False).astype(bool)
    key = tuple(batch.column(k)[0].as_py() for k in keys)
    new[0] = last is None or key != last
    return new, tuple(batch.column(k)[n - 1].as_py() for k in keys)


def _compose(a: np.ndarray, b: np.ndarray, new: np.ndarray) -> None:
    """Turns the steps a, b in place into the maps from the start of each run to each row, by doubling."""
    n = len(a)
    if n and (a == 1).all():
        total = np.cumsum(b, axis=0)
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        if b.dtype.kind == "i":  # wraps around, and so does the difference
            b[:] = total - (total - b)[first]
            return
    run = np.cumsum(new)
    step = 1
    while step < n:
        same = run[step:] == run[:-step]
        if not same.any():
            break
        at = np.flatnonzero(same)
        b[step + at] = a[step + at] * b[at] + b[step + at]
        a[step + at] = a[step + at] * a[at]
        step *= 2


def _local(keys: list[str], names: list[str], kind: str, held: bool):
    """Adds to sorted rows the maps since the partition's first row of the key, what they give from nothing (if held), whether that key began before, and the place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, part, at, head = None, None, TaskContext.get().partitionId(), 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins, last_now = _starts(batch, keys, last)
            changed = begins.copy()
            changed[0] &= last is not None
            heads = head & (np.cumsum(changed) == 0)
            take = lambda x: np.stack([batch.column(f"_s{i}{x}").to_numpy(zero_copy_only=False).astype(kind) for i in range(len(names))], axis=1)
            a, b = take("a"), take("b")
            on = np.cumsum(begins) == 0
            fresh = np.full_like(b, np.nan if held else 0)
            if held:
                # The first value that is there counts as it is, and the steps go on from it.
                first = take("f")
                run_at = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
                for i in range(len(names)):
                    some = ~np.isnan(first[:, i])
                    seen = np.cumsum(some)
                    before = seen - some - (seen - some)[run_at]
                    c, d = a[:, i : i + 1].copy(), b[:, i : i + 1].copy()
                    start = some & (before == 0)
                    c[start], d[start, 0] = 0, first[start, i]
                    _compose(c, d, begins)
                    fresh[:, i] = np.where(before + some > 0, d[:, 0], np.nan)
            _compose(a, b, begins)
            if state is not None and on.any():
                if held:
                    known = ~np.isnan(state[2])
                    fresh[np.ix_(on, known)] = a[np.ix_(on, known)] * state[2][known] + b[np.ix_(on, known)]
                b[on] += a[on] * state[1]
                a[on] *= state[0]
            last, state, head = last_now, (a[-1].copy(), b[-1].copy(), fresh[-1].copy()), bool(heads[-1])
            added = [pa.array(part + np.zeros(n, np.int32)), pa.array(at + np.arange(n)), pa.array(heads)]
            added += [pa.array(np.ascontiguousarray(x[:, i]), from_pandas=held) for i in range(len(names)) for x in (a, b, fresh)]
            at += n
            yield pa.record_batch([*batch.columns, *added], [*batch.schema.names, "_part", "_at", "_head", *(f"_{x}{i}" for i in range(len(names)) for x in "abf")])

    return run


def affine(rows: DataFrame, keys: list[str], order: list[str | Column], steps: dict[str, tuple[Column, ...]], whole: bool = False) -> DataFrame:
    """rows with, for each name of steps (a, b) or (a, b, first), its value after the row: a * (value of the key's row before) + b.

    Ahead of a key's first row the value is 0. With `first` (for all names or none) there is none: it stays null until a row's `first` isn't null, which then
    is the value itself. Values are doubles, or with `whole` longs, whose sums wrap around. Rows of a key come in the given order, nulls first; equal ones in any.
    a and b must not be null. A null key is a key. An empty table gives an empty result.
    """
    kind, sql = ("i8", T.LongType()) if whole else ("f8", T.DoubleType())
    names, held = list(steps), len(next(iter(steps.values()))) == 3
    own = rows.withColumns({f"_s{i}{x}": c.cast(sql) for i, n in enumerate(names) for x, c in zip("abf", steps[n])})
    sorted_rows = ordered(own, keys, order)
    added = [("_part", T.IntegerType()), ("_at", T.LongType()), ("_head", T.BooleanType()), *((f"_{x}{i}", sql) for i in range(len(names)) for x in "abf")]
    schema = T.StructType([*sorted_rows.schema.fields, *(T.StructField(n, t) for n, t in added)])
    local = written(sorted_rows.mapInArrow(_local(keys, names, kind, held), schema), "scan")
    values = [f"_{x}{i}" for i in range(len(names)) for x in "abf"]
    ends = local.groupBy("_part").agg(
        F.min_by(F.struct(*keys), "_at").alias("first"), F.max_by(F.struct(*keys), "_at").alias("last"), F.max_by(F.struct(*values), "_at").alias("to"), F.bool_and("_head").alias("single"))
    nothing = None if held else 0
    carry, before, state = [], None, None
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):  # a row for each partition
        goes_on = before is not None and tuple(before) == tuple(row["first"])
        if goes_on:
            carry.append((row["_part"], *state))
        start = state if goes_on and row["single"] else [nothing] * len(names)
        to = row["to"]
        state = [to[f"_f{i}"] if start[i] is None else _wrapped(to[f"_a{i}"] * start[i] + to[f"_b{i}"], whole) for i in range(len(names))]
        before = row["last"]
    found = ", ".join(f"_c{i} {'long' if whole else 'double'}" for i in range(len(names)))
    handed = F.broadcast(rows.sparkSession.createDataFrame(carry, f"_part int, {found}"))
    out = local.join(handed, "_part", "left")
    after = {}
    for i, n in enumerate(names):
        given = F.col("_head") & F.col(f"_c{i}").isNotNull()
        if held:
            after[n] = F.when(given, F.col(f"_a{i}") * F.col(f"_c{i}") + F.col(f"_b{i}")).otherwise(F.col(f"_f{i}"))
        else:
            after[n] = _sum(F.col(f"_b{i}"), F.when(given, F.col(f"_a{i}") * F.col(f"_c{i}")).otherwise(F.lit(0).cast(sql)), whole)
    return out.withColumns(after).select(*(f"`{c}`" for c in rows.columns if c not in names), *names)


def _wrapped(x, whole: bool):
    return (int(x) + (1 << 63)) % (1 << 64) - (1 << 63) if whole else x


def _sum(x: Column, y: Column, whole: bool) -> Column:
    """x + y; of longs modulo 2**64, whatever the session says of overflows."""
    if not whole:
        return x + y
    high = F.shiftright(x, 32) + F.shiftright(y, 32)
    low = x.bitwiseAND((1 << 32) - 1) + y.bitwiseAND((1 << 32) - 1)
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND((1 << 32) - 1))


def _smooth(values: list[float | None], begins: Iterable[bool], last: float | None, alpha: float, rest: float) -> tuple[list[float | None], float | None]:
    out = []
    for v, new in zip(values, begins):
        if new:
            last = None
        if v is not None:
            last = v if last is None else alpha * v + rest * last
        out.append(last)
    return out, last


def _fold(keys: list[str], n: int, alpha: float, rest: float):
    """Adds to sorted rows the place, whether the partition's first key goes on, and the smoothed values, begun from nothing or (if _c0, .. are there) from these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, at, head, part = None, [None] * n, 0, True, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            begins, now = _starts(batch, keys, last)
            changed = begins.copy()
            changed[0] &= last is not None
            heads = head & (np.cumsum(changed) == 0)
            last, head = now, bool(heads[-1])
            out, new = [], begins.tolist()
            for i in range(n):
                column, state[i] = _smooth(batch.column(f"_v{i}").to_pylist(), new, state[i], alpha, rest)
                out.append(pa.array(column, pa.float64()))
            added = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at + np.arange(batch.num_rows)), pa.array(heads), *out]
            at += batch.num_rows
            yield pa.record_batch([*batch.columns, *added], [*batch.schema.names, "_part", "_at", "_head", *(f"_y{i}" for i in range(n))])

    return run


def _fold_on(starts: dict[int, tuple], n: int, alpha: float, rest: float):
    """The same for the heads of partitions (_part), which go on from what starts says."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, [None] * n
        for batch in batches:
            of = batch.column("_part").to_numpy()
            for start, stop in zip(cuts := np.flatnonzero(np.diff(of, prepend=-1)), [*cuts[1:], len(of)]):
                rows = batch.slice(start, stop - start)
                if part != of[start]:
                    part, state = int(of[start]), list(starts[int(of[start])])
                columns = {c: rows.column(c) for c in batch.schema.names}
                for i in range(n):
                    column, state[i] = _smooth(rows.column(f"_v{i}").to_pylist(), [False] * rows.num_rows, state[i], alpha, rest)
                    columns[f"_y{i}"] = pa.array(column, pa.float64())
                yield pa.record_batch(list(columns.values()), list(columns))

    return run


def exponential(rows: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, Column], alpha: float) -> DataFrame:
    """rows with each of values smoothed along its key: the first one as it is, then alpha * value + (1 - alpha) * last; a null holds the last.

    Other than affine() this gives the bits of a loop over the key's rows. A partition whose first key goes on from the one before is begun from that one's end, as folded
    from nothing; the bits of two such runs soon are the same, so a second pass over these rows mostly is the last, and passes go on where an end still changed.
    """
    n, rest = len(values), round(1 - alpha, 12)
    own = ordered(rows.withColumns({f"_v{i}": c.cast("double") for i, c in enumerate(values.values())}), keys, order)
    ys = [f"_y{i}" for i in range(n)]
    schema = T.StructType([*own.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_head", T.BooleanType()), *(T.StructField(y, T.DoubleType()) for y in ys)])
    local = written(own.mapInArrow(_fold(keys, n, alpha, rest), schema), "fold")
    ends = local.groupBy("_part").agg(F.min_by(F.struct(*keys), "_at").alias("first"), F.max_by(F.struct(*keys), "_at").alias("last"), F.max_by(F.struct(*ys), "_at").alias("to"), F.bool_and("_head").alias("single"))
    ends = sorted(ends.collect(), key=lambda r: r["_part"])  # a row for each partition
    end = {r["_part"]: tuple(r["to"]) for r in ends}
    before = {b["_part"]: a["_part"] for a, b in zip(ends, ends[1:]) if tuple(a["last"]) == tuple(b["first"])}
    single, used, mended = {r["_part"] for r in ends if r["single"]}, {}, []
    while again := {p: end[q] for p, q in before.items() if repr(end[q]) != repr(used.get(p, (None,) * n))}:
        heads = local.where(F.col("_head") & F.col("_part").isin(list(again))).repartition("_part").sortWithinPartitions("_part", "_at")
        heads = written(heads.mapInArrow(_fold_on(again, n, alpha, rest), schema), "heads")
        mended = [(df, parts - again.keys()) for df, parts in mended] + [(heads, set(again))]
        used |= again
        if on := list(again.keys() & single):
            end |= {r["_part"]: tuple(r["to"]) for r in heads.where(F.col("_part").isin(on)).groupBy("_part").agg(F.max_by(F.struct(*ys), "_at").alias("to")).collect()}
    out = local.where(~(F.col("_head") & F.col("_part").isin(list(used)))) if used else local
    for df, parts in mended:
        if parts:
            out = out.unionByName(df.where(F.col("_part").isin(list(parts))))
    return out.select(*(f"`{c}`" for c in rows.columns if c not in values), *(F.col(y).alias(name) for y, name in zip(ys, values)))


def running_sums(rows: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """rows with the sums of longs over the key's rows so far, modulo 2**64."""
    return affine(rows, keys, order, {n: (F.lit(1), c) for n, c in values.items()}, whole=True)


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows with their number, 0, 1, .. along the order over the whole table; equal rows in any order. No task sees more than its range."""
    own = written(ordered(rows, [], order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_id", 33)
    sizes = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    at = F.col("_id").bitwiseAND((1 << 33) - 1)
    return own.withColumn("_part", part).join(F.broadcast(ahead), "_part").select(*(f"`{c}`" for c in rows.columns), (F.col("_ahead") + at).alias(name))


def sliding(rows: DataFrame, keys: list[str], order: list[str], reach: int, values: dict[str, Callable[[WindowSpec], Column]], block: int = 4096) -> DataFrame:
    """rows with values over windows of a key's last `reach` rows and the row itself; values make a column of the window they are given.

    A key's rows are cut into blocks, each of which gets the last `reach` rows ahead of it as well, so no task sorts a whole key.
    """
    placed = running_sums(rows, keys, order, {"_place": F.lit(1)}).withColumn("_place", F.col("_place") - 1)
    own = F.expr(f"_place div {block}")
    lent = F.when(F.col("_place") % block >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.withColumn("_own", own).withColumn("_block", F.explode(lent))
    window = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(-reach, 0)
    return dealt.withColumns({n: make(window) for n, make in values.items()}).where("_own = _block").drop("_own", "_block", "_place")
