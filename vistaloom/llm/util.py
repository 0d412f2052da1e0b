"""Shared pieces of the training-data operators: the shared folder, tables in it, and vectorised word hashing."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words in the contracts that split on ASCII white space.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Upper-case A-Z to lower case, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        own = tempfile.mkdtemp(prefix="vistaloom-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(given := f"file://{own}")
    return given.rstrip("/")


_written: list[str] = []


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that saved() wrote inside it, but for the last one."""
    known = len(_written)
    yield
    for path in _written[known:-1]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _written[known:-1] = []


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vistaloom-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Filters have 16 bits or more for each key, but 8 MB at most; beyond some millions of keys more rows pass than need to.
LEAST_LOG2, MOST_LOG2 = 18, 26


def filter_log2(keys: int) -> int:
    return min(MOST_LOG2, max(LEAST_LOG2, math.ceil(math.log2(16 * max(keys, 1)))))


class Bits:
    """A filter over longs: a set bit for each one's highest log2 bits."""

    def __init__(self, log2: int):
        self.log2, self.bytes = log2, np.zeros(1 << (log2 - 3), np.uint8)

    def has(self, key: int) -> bool:
        slot = (key & _MASK) >> (64 - self.log2)
        return bool(self.bytes[slot >> 3] >> (slot & 7) & 1)


def bits(rows: DataFrame, key: str) -> Bits:
    """A filter over the longs in column key of a saved table.

    Its size follows the number of rows and has a bound (MOST_LOG2), so it can be broadcast at any size of the input; it only
    spares work, since what passes is still joined exactly.
    """
    out = Bits(filter_log2(rows.count()))
    for row in slots(rows, key, out.log2).collect():
        out.bytes[row["_block"] << 12 : (row["_block"] + 1) << 12] = np.frombuffer(bytes(row["_bits"]), np.uint8)
    return out


def record(df: DataFrame) -> Column:
    """All columns as one, so that helper columns beside it can't clash with any of them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("record")


def slots(rows: DataFrame, key: str, log2: int) -> DataFrame:
    """A filter over the longs in column key, as a small table: block, bits (4 KB each, 2**(log2 - 15) rows at most)."""
    slot = F.shiftrightunsigned(F.col(key), 64 - log2)
    return rows.groupBy(F.shiftrightunsigned(slot, 15).alias("_block")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position((shiftrightunsigned({key}, {64 - log2}) & 32767) + 1))").alias("_bits"))


def maybe_in(df: DataFrame, key: str, keys: DataFrame, their_key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose long in key may be in column their_key of keys, and those where it surely isn't.

    The filter is broadcast: its size follows the number of keys and has a bound. keys is read twice, so it should be a saved table.
    """
    log2 = filter_log2(keys.count())
    slot = F.shiftrightunsigned(F.col(key), 64 - log2)
    joined = df.withColumn("_block", F.shiftrightunsigned(slot, 15)).join(F.broadcast(slots(keys, their_key, log2)), "_block", "left")
    place = slot.bitwiseAND(32767)
    byte = F.conv(F.hex(F.expr(f"substring(_bits, int((shiftrightunsigned(`{key}`, {64 - log2}) & 32767) div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return joined.where(hit).drop("_block", "_bits"), joined.where(~hit).drop("_block", "_bits")


# ---- hashing -------------------------------------------------------------------------------------------------

_U = np.uint64
_MASK = (1 << 64) - 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
#: Runs of words are polynomials in the words' hashes modulo 2**64, which are safe up to this length (two words in a certain pattern of 1,024 or more collide).
MOST_WORDS = 512
_powers: dict[int, np.ndarray] = {}
BLOCK = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the public splitmix64 finaliser)."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _MASK)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), base, _U)
        factors[0] = 1
        have = np.cumprod(factors, dtype=_U)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


def _spans(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span [start, end): the polynomial in base of the values in it, modulo 2**64."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return (sums[ends] - sums[starts]) * _power(inverse, len(values) + 1)[starts]


class Words:
    """The words of a batch of texts. first[d]:first[d + 1] are those of text d; starts and ends are byte places in data."""

    def __init__(self, texts: pa.Array, drop: np.ndarray = ASCII_SPACE, lower: bool = True):
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        inside = ~drop[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits of each word: the sum of what each byte and its place in the word scramble to. A polynomial in the bytes would give the
        same bits to different long words of a certain pattern. Bytes are widened in blocks of about BLOCK, which bounds the memory."""
        h = np.empty(len(self.starts), _U)
        cuts = np.flatnonzero(np.r_[True, np.diff(self.starts // BLOCK) > 0, True]) if len(h) else np.zeros(1, int)
        for a, b in zip(cuts, cuts[1:]):
            low, high = self.starts[a], self.ends[b - 1]
            own = self.starts[a:b] - low
            place = np.ones(high - low, np.int64)
            place[0] = 0
            place[own[1:]] = own[:-1] - own[1:] + 1
            sums = np.zeros(high - low + 1, _U)
            np.cumsum(mix((np.cumsum(place) << 8 | self.data[low:high]).view(_U), 11), out=sums[1:])
            h[a:b] = sums[self.ends[a:b] - low] - sums[own]
        return mix(h ^ ((self.ends - self.starts).astype(_U) << _U(40)))

    def grams(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, 64-bit hashes) of all runs of k words inside one text; a place counts words of the batch."""
        if k > MOST_WORDS:
            raise ValueError(f"runs of more than {MOST_WORDS} words aren't hashed")
        h = self.hashes() if hashes is None else hashes
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(len(h)) + k <= last)
        return at, mix(_spans(h, _WORD_BASE, at, at + k), k)

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """A hash of each text's sequence of words."""
        return mix(_spans(hashes, _WORD_BASE, self.first[:-1], self.first[1:]) ^ self.counts.astype(_U), 77)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most about limit bytes of text (one row at least), so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def buckets_for(entries: int, each: int = 1 << 21) -> int:
    """How many buckets hold so many entries with about `each` in one: it grows with the input, a bucket doesn't."""
    return max(16, math.ceil(entries / each))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int32)
