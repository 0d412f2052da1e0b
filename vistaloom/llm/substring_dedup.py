"""Removal of repeated passages by fixed-block anchors.

Any window of `span` words contains a whole block of b = (span + 1) // 2 words out of the blocks that cut its own
document at multiples of b. So the blocks are indexed, all rolling windows of b words probe them, and a window can only
repeat elsewhere if one of its own blocks was hit. Hits are extended to maximal repeats: around hit blocks every window
of `span` words is looked up among all such windows of all documents.

What moves: of a probe 32 bits inside its bucket (sorted, each once from a chunk of text), of a block also where it
stands; of a window around a hit block 64 bits and its place. Equal hashes of one chunk are settled in it and sent on
once, so a passage that a third of all documents hold costs one entry from each chunk, and nothing is paired. The
number of buckets follows the input; a bucket's size doesn't. Blocks hit by chance (32 bits and the bucket) are
harmless, since their windows are looked up by 64 bits; a wrong verdict needs a collision of those.

A document is named by 64 bits of its text in between: what repeats depends on its text alone, so copies share marks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaloom.llm.util import Words, bucket_of, buckets_for, maybe_in, mix, saved, slices

_U = np.uint64
#: Bytes of text in a chunk, and entries in a bucket.
CHUNK, BUCKET = 8 << 20, 1 << 21
#: Average bytes of a word with its separator, to lay out buckets by (their number isn't critical).
WORD_BYTES = 6
EXCHANGE = "bucket int, probes binary, hashes binary, names binary, places binary"


def _grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each run of equal hashes in that order, its length)."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.r_[starts, len(h)])


def _packed(names: np.ndarray, places: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(group, names, places) for each group of names that has some."""
    group = bucket_of(mix(names.view(_U), 3), groups)
    order = np.argsort(group, kind="stable")
    group, names, places = group[order], names[order].astype("<i8"), places[order].astype("<i4")
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
    for x, y in zip(cuts, cuts[1:]):
        yield int(group[x]), names[x:y].tobytes(), places[x:y].tobytes()


def _send(hashes: np.ndarray, wanted: np.ndarray, names: np.ndarray, places: np.ndarray, buckets: int, width: str) -> Iterator[pa.RecordBatch]:
    """Entries of a chunk for the exchange. wanted: those that need a verdict, if they stand alone in the chunk; places that
    are known to repeat inside the chunk go as marks, in rows of bucket -1 - group."""
    order, starts, lengths = _grouped(hashes)
    alone = np.repeat(lengths == 1, lengths)
    settled = order[~alone]
    settled = settled[wanted[settled]]
    rows: dict[str, list] = {c: [] for c in ("bucket", "probes", "hashes", "names", "places")}
    for group, *own in _packed(names[settled], places[settled], buckets):
        for column, value in zip(rows, (-1 - group, b"", b"", *own)):
            rows[column].append(value)
    single = order[alone]
    blocks = np.sort(single[wanted[single]])
    probes = np.r_[hashes[order[starts[lengths > 1]]], hashes[single[~wanted[single]]]]
    bp, bb = bucket_of(probes, buckets), bucket_of(hashes[blocks], buckets)
    at = np.lexsort((probes.astype(np.uint32), bp))
    probes, bp = probes[at].astype(width), bp[at]
    at = np.argsort(bb, kind="stable")
    blocks, bb = blocks[at], bb[at]
    present = np.union1d(bp, bb)  # the chunk's own buckets: how many there are in all costs nothing here
    cuts = (np.searchsorted(side, present, which) for side in (bp, bb) for which in ("left", "right"))
    for x, a, b, c, d in zip(present.tolist(), *cuts):
        own = blocks[c:d]
        for column, value in zip(rows, (x, probes[a:b].tobytes(), hashes[own].astype(width).tobytes(), names[own].astype("<i8").tobytes(), places[own].astype("<i4").tobytes())):
            rows[column].append(value)
    yield pa.record_batch([pa.array(rows["bucket"], pa.int32()), *(pa.array(v, pa.binary()) for v in list(rows.values())[1:])], list(rows))


def _anchors(span: int, block: int, buckets: int):
    """Blocks and rolling probes of all texts long enough for a window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=CHUNK):
            words = Words(batch.column("text"), lower=False)
            at, grams = words.grams(block)
            row = np.searchsorted(words.first, at, side="right") - 1
            keep = words.counts[row] >= span
            at, grams, row = at[keep], grams[keep], row[keep]
            place = at - words.first[row]
            names = batch.column("name").to_numpy(zero_copy_only=False)[row]
            yield from _send(grams, place % block == 0, names, place // block, buckets, "<u4")

    return run


def _windows(span: int, block: int, buckets: int):
    """The windows around the hit blocks of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=CHUNK):
            words = Words(batch.column("text"), lower=False)
            at, grams = words.grams(span)
            chosen = np.zeros(len(words.starts) + 1, np.int32)
            for row, places in enumerate(batch.column("hits")):
                own = np.frombuffer(places.as_buffer(), "<i4").astype(np.int64) * block
                first, last = int(words.first[row]), int(words.first[row + 1])
                np.add.at(chosen, np.maximum(own + first + block - span, first), 1)
                np.add.at(chosen, np.minimum(own + first + 1, last), -1)
            keep = (np.cumsum(chosen)[:-1] > 0)[at]
            at, grams = at[keep], grams[keep]
            row = np.searchsorted(words.first, at, side="right") - 1
            names = batch.column("name").to_numpy(zero_copy_only=False)[row]
            yield from _send(grams, np.ones(len(at), bool), names, at - words.first[row], buckets, "<u8")

    return run


def _by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(first column, the rest of its rows) of sorted rows."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, own in groupby(rows, key=lambda row: row[0]):
        yield key, (row[1:] for row in own)


def _verdicts(width: str, groups: int):
    """Of sorted buckets: the places whose hash is among the probes, or among the places of another text or chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _by_key(batches):
            if bucket < 0:
                out = [(-1 - bucket, names, places) for _, _, names, places in parts]
            else:
                parts = list(parts)
                probes, hashes, names, places = (np.concatenate([np.frombuffer(p[i], kind) for p in parts]) for i, kind in enumerate((width, width, "<i8", "<i4")))
                probes = np.unique(probes)
                hit = probes[np.minimum(np.searchsorted(probes, hashes), len(probes) - 1)] == hashes if len(probes) else np.zeros(len(hashes), bool)
                order, _, lengths = _grouped(hashes)
                hit[order] |= np.repeat(lengths > 1, lengths)
                out = list(_packed(names[hit], places[hit], groups))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["grp", "names", "places"])

    return run


def _collected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted groups: each name with its places, each once. Repeats are dropped on the way, so they don't add up in memory."""
    for _, parts in _by_key(batches):
        held, size = [], 0

        def once() -> np.ndarray:
            return np.unique(np.concatenate(held))

        for names, places in parts:
            own = np.empty(len(places) // 4, [("name", "<i8"), ("place", "<i4")])
            own["name"], own["place"] = np.frombuffer(names, "<i8"), np.frombuffer(places, "<i4")
            held.append(own)
            size += len(own)
            if size > 4 * BUCKET:
                held = [once()]
                size = 2 * len(held[0])
        marks = once()
        cuts = np.flatnonzero(np.r_[True, marks["name"][1:] != marks["name"][:-1], True])
        yield pa.record_batch([pa.array(marks["name"][cuts[:-1]]), pa.array([marks["place"][a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["name", "hits"])


def _settle(sent: DataFrame, width: str, groups: int, name: str) -> DataFrame:
    """name, hits (its places, sorted) of what repeats."""
    marks = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verdicts(width, groups), "grp int, names binary, places binary")
    return saved(marks.repartition("grp").sortWithinPartitions("grp").mapInArrow(_collected, "name long, hits binary"), name)


def _cut(span: int):
    """Each text without the words that its marks cover, joined by single spaces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=CHUNK):
            words = Words(batch.column("text"), lower=False)
            cover = np.zeros(len(words.starts) + 1, np.int32)
            for row, places in enumerate(batch.column("hits")):
                if places.is_valid:
                    at = np.frombuffer(places.as_buffer(), "<i4") + words.first[row]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, np.minimum(at + span, len(words.starts)), -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept = np.flatnonzero(~gone)
            row = np.searchsorted(words.first, kept, side="right") - 1
            inner = np.r_[row[1:] == row[:-1], False] if len(kept) else np.zeros(0, bool)
            edge = np.zeros(len(words.data) + 1, np.int32)
            edge[words.starts[kept]] += 1
            edge[words.ends[kept]] -= 1  # a word's end is no word's start
            mask = np.cumsum(edge)[:-1] > 0
            gaps = words.ends[kept[inner]]
            data = words.data.copy()
            data[gaps] = 0x20
            mask[gaps] = True
            sizes = np.r_[0, np.cumsum(mask)][words.offsets]
            text = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[mask])).cast(pa.string())
            removed = np.diff(np.r_[0, np.cumsum(gone)][words.first])
            yield pa.record_batch([batch.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), text], ["doc_id", "n_words", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, span: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and the remaining text of each row of docs (doc_id, text; further columns are left out).

    Words are runs of characters other than ASCII white space, unchanged. Every word goes that lies in a window of `span` words
    whose word sequence also starts elsewhere, in the same text or another; what remains is joined by single spaces. Of
    two equal passages both go. Null, empty and blank texts have no words and become empty. Repeated rows are copies
    of each other. Ids may be null or repeated. An empty table gives an empty result.
    """
    if span < 2:
        raise ValueError("span must be 2 words or more")
    block = (span + 1) // 2
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = texts.withColumn("name", F.xxhash64("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(total // WORD_BYTES, BUCKET)
    sent = named.select("name", "text").mapInArrow(_anchors(span, block, buckets), EXCHANGE)
    hits = _settle(sent, "<u4", buckets, "block-hits")
    maybe, _ = maybe_in(named, "name", hits, "name")
    around = maybe.select("name", "text").join(hits, "name").mapInArrow(_windows(span, block, buckets), EXCHANGE)
    repeats = _settle(around, "<u8", buckets, "window-hits")
    maybe, rest = maybe_in(named, "name", repeats, "name")
    marked = maybe.join(repeats, "name", "left").select("doc_id", "text", "hits")
    both = marked.unionByName(rest.select("doc_id", "text", F.lit(None).cast("binary").alias("hits")))
    return both.mapInArrow(_cut(span), "doc_id long, n_words long, n_removed long, text string")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 34], ' ')) AS t FROM d, unnest(range(1, len(w) - 33)) AS r(s)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY t) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p FROM rep, unnest(range(s, s + 35)) AS r(p)),
words AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
