"""Scoring texts by an n-gram language model with deleted interpolation.

The probability of a token is mixed from below: P0 is the same for every known word and one unknown one, and
Pk = w * (count of the k-gram / count of its first k - 1 tokens) + (1 - w) * P(k-1), where w depends on the bucket (powers of two) of that context's
count, and is 0 for contexts never seen. The weights are learnt by expectation-maximisation: one of HELD learnable documents is
put aside, the others are counted, and w is what makes the tokens put aside likeliest under those counts, level by level. Texts are scored
with the counts of all learnable documents.

Counts cover the corpus. Texts are packed into chunks of about CHUNK bytes. A chunk sends each of its distinct n-grams once, as part of
a hash, with how often it stands there, to the bucket of its hash; the bucket adds up all chunks and replies with the totals; so an n-gram that a third
of all documents hold costs an entry from each chunk. The number of buckets follows the input, a bucket's size doesn't. Words are counted by 64 bits, longer n-grams by 40 bits
inside their bucket: of two million there some four in a million share their count with another.

What tokens put aside say about a weight is summed up by bucket and by the ratio of the two mixed probabilities, in steps of 1/16 of a power of
two with the mean ratio of each step, so the driver's tables have a bound and a pass over them a level is enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaloom.llm.util import Words, bucket_of, buckets_for, mix, saved, slices
from vistaloom.storage import written

_U = np.uint64
#: Longest n-gram; bytes of text in a chunk; one of so many learnable documents teaches the weights; entries in a bucket.
ORDER, CHUNK, HELD, BUCKET = 3, 8 << 20, 10, 1 << 21
#: Buckets of context counts: 0, 1, 2-3, 4-7, .. ; steps of the ratio a power of two.
LEVELS, STEPS = 32, 16
#: What a token, with what separates it, takes in bytes, to lay out buckets by (their number isn't critical).
TOKEN_BYTES = 6
_END, _BEGIN, _STEP = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F), _U(0xDA942042E4DD58B5)
_LOW = _U((1 << 40) - 1)
COUNTED, PUT_ASIDE, NOT_LEARNT = 0, 1, 2
_TEXTS = "chunk long, kind int, ids binary, nulls binary, held binary, sizes binary, texts binary"
_ENTRIES = "bucket int, chunk long, kind int, words binary, word_n binary, word_more binary, low binary, high binary, n binary, more binary"
_REPLIES = "chunk long, bucket int, words binary, words_more binary, grams binary, grams_more binary, own_words binary, own_words_more binary, own_grams binary, own_grams_more binary, stats array<long>, kind int"


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, kind, text) packed by kind."""
    number = TaskContext.get().partitionId() << 32
    packer = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches, limit=CHUNK):
        kinds = batch.column("kind").to_numpy()
        for kind in np.unique(kinds):
            rows = batch.filter(pa.array(kinds == kind))
            texts = [(x or "").encode() for x in rows.column("text").to_pylist()]
            ids = rows.column("doc_id")
            row = (number, int(kind), ids.fill_null(0).to_numpy().astype("<i8").tobytes(), ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes(),
                   rows.column("held_out").to_numpy(zero_copy_only=False).astype("u1").tobytes(), np.array([len(x) for x in texts], "<i8").tobytes(), packer.compress(b"".join(texts)))
            number += 1
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 5))], [x.split()[0] for x in _TEXTS.split(", ")])


class Chunk:
    """The tokens of a chunk's texts and their n-grams. first[d] is where text d's tokens begin; each ends with one end token."""

    def __init__(self, row: dict, order: int, buckets: int):
        sizes = np.frombuffer(row["sizes"], "<i8")
        data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(sizes.sum()) + 1) if sizes.sum() else b""
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        words = Words(pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data)))
        n = len(sizes)
        ends = words.first[1:] + np.arange(n)
        tokens = np.full(len(words.starts) + n, _END)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = words.hashes()
        self.first, self.lengths = words.first[:-1] + np.arange(n), words.counts + 1
        place = np.arange(len(tokens)) - np.repeat(self.first, self.lengths)
        gram, grams = mix(tokens, 1), []
        self.words, self.word_at, self.word_n = np.unique(gram, return_inverse=True, return_counts=True)
        for k in range(1, order):
            before = np.full(len(tokens), _BEGIN)
            before[k:] = np.where(place[k:] >= k, tokens[:-k], _BEGIN)
            gram = mix(gram * _STEP + before, k + 1)
            grams.append((bucket_of(gram, buckets).astype(_U) << _U(40)) | (gram & _LOW))
        whole = np.concatenate(grams) if grams else np.zeros(0, _U)
        self.grams, at, self.gram_n = np.unique(whole, return_inverse=True, return_counts=True)
        self.gram_at = at.reshape(order - 1, len(tokens))
        self.word_bucket = bucket_of(self.words, buckets)

    def counts(self, words: np.ndarray, grams: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(counts of each token's n-grams, counts of their contexts but for the empty one), from the totals of distinct ones."""
        own = [words[self.word_at], *(grams[at] for at in self.gram_at)]
        # As many texts begin as end: that is how often the context of a first token occurs.
        begun = own[0][self.first + self.lengths - 1]
        contexts = []
        for counts in own[:-1]:
            c = np.empty_like(counts)
            c[1:] = counts[:-1]
            c[self.first] = begun
            contexts.append(c)
        return own, contexts


def _small(n: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each; those of 255 or more follow at full length."""
    n = np.asarray(n)
    return np.minimum(n, 255).astype("u1").tobytes(), n[n >= 255].astype("<i8").tobytes()


def _large(small: bytes, more: bytes) -> np.ndarray:
    n = np.frombuffer(small, "u1").astype(np.int64)
    n[n == 255] = np.frombuffer(more, "<i8")
    return n


def _entries(order: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row, order, buckets)
                of_grams = (chunk.grams >> _U(40)).astype(np.int32)
                present = np.union1d(chunk.word_bucket, of_grams)
                cuts = [np.searchsorted(x, present, side) for x in (chunk.word_bucket, of_grams) for side in ("left", "right")]
                learnt = row["kind"] != NOT_LEARNT
                out = []
                for bucket, a, b, c, d in zip(present.tolist(), *cuts):
                    low = chunk.grams[c:d] & _LOW
                    out.append((bucket, row["chunk"], row["kind"], chunk.words[a:b].astype("<u8").tobytes(), *(_small(chunk.word_n[a:b]) if learnt else (b"", b"")),
                                (low & _U(0xFFFFFFFF)).astype("<u4").tobytes(), (low >> _U(32)).astype("u1").tobytes(), *(_small(chunk.gram_n[c:d]) if learnt else (b"", b""))))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7))], [x.split()[0] for x in _ENTRIES.split(", ")])

    return run


def _grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each key of sorted rows."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _added(keys: list[np.ndarray], counts: list[np.ndarray | None], kinds: list[int]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
    """(total, counted only) of each entry's key over all entries, the ranges of the parts, and both kinds of counts of each distinct key."""
    sizes = np.array([len(x) for x in keys])
    at = np.r_[0, np.cumsum(sizes)]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((2, len(distinct)))
    for n, kind, a, b in zip(counts, kinds, at, at[1:]):
        if n is not None:
            sums[kind] += np.bincount(place[a:b], n, len(distinct)) if b - a > len(distinct) // 16 else 0
            if b - a <= len(distinct) // 16:
                sums[kind][place[a:b]] += n  # keys of a part are distinct
    sums = sums.astype(np.int64)
    return (sums[0] + sums[1])[place], sums[0][place], list(zip(at, at[1:])), sums


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted buckets: replies to each chunk, and the numbers of known words and of tokens (all learnable ones, counted ones)."""
    names = [x.split()[0] for x in _REPLIES.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 8, pa.list_(pa.int64()), pa.int32()]
    for parts in _grouped(batches, "bucket"):
        kinds = [p["kind"] for p in parts]
        words = [np.frombuffer(p["words"], "<u8") for p in parts]
        grams = [np.frombuffer(p["low"], "<u4").astype(_U) | np.frombuffer(p["high"], "u1").astype(_U) << _U(32) for p in parts]
        word_n, gram_n = ([_large(p[a], p[b]) if kind != NOT_LEARNT else None for p, kind in zip(parts, kinds)] for a, b in (("word_n", "word_more"), ("n", "more")))
        w, w_own, w_at, sums = _added(words, word_n, kinds)
        g, g_own, g_at, _ = _added(grams, gram_n, kinds)
        both = sums[0] + sums[1]
        out = [(-1, parts[0]["bucket"], *[None] * 8, [int((both > 0).sum()), int(both.sum()), int((sums[0] > 0).sum()), int(sums[0].sum())], -1)]
        for p, kind, (a, b), (c, d) in zip(parts, kinds, w_at, g_at):
            own = (*_small(w_own[a:b]), *_small(g_own[c:d])) if kind == PUT_ASIDE else [None] * 4
            out.append((p["chunk"], p["bucket"], *_small(w[a:b]), *_small(g[c:d]), *own, None, kind))
        for a in range(0, len(out), 64):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out[a : a + 64]), types)], names)


def _with_replies(batches: Iterable[pa.RecordBatch], order: int, buckets: int) -> Iterator[tuple[dict, Chunk, list[dict]]]:
    """(row, chunk, its replies by bucket) of rows sorted by chunk and bucket; the chunk's own row has bucket -1."""
    for rows in _grouped(batches, "chunk"):
        yield rows[0], Chunk(rows[0], order, buckets), rows[1:]


def _joined(replies: list[dict], name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_large(r[name], r[f"{name}_more"]) for r in replies)])


def _events(order: int, buckets: int):
    """Of chunks put aside: the counts of each token's n-grams and contexts in the counted documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, replies in _with_replies(batches, order, buckets):
            own, contexts = chunk.counts(_joined(replies, "own_words"), _joined(replies, "own_grams"))
            for a in range(0, len(own[0]), 1 << 18):
                yield pa.record_batch([pa.array([np.stack([x[a : a + (1 << 18)] for x in side]).astype("<i8").tobytes() if side else b""]) for side in (own, contexts)], ["counts", "contexts"])

    return run


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one for each power of two."""
    return np.minimum(np.frexp(context.astype(float))[1], LEVELS - 1)


def probabilities(own: list[np.ndarray], contexts: list[np.ndarray], weights: list[np.ndarray], known: int, tokens: int) -> list[np.ndarray]:
    """P0, P1, .. of each token, as far as there are weights (an array by bucket for each level)."""
    out = [np.full(len(own[0]), 1 / (known + 1))]
    for k, w in enumerate(weights):
        context = np.full(len(own[0]), tokens) if k == 0 else contexts[k - 1]
        share = w[bucket(context)]
        out.append(share * own[k] / np.maximum(context, 1) + (1 - share) * out[-1])
    return out


def _histogram(level: int, order: int, weights: list[np.ndarray], known: int, tokens: int):
    """(bucket, step, n, sum of ratios) of the events, for the next level's weights."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["counts"], "<i8").reshape(order, -1)
                contexts = np.frombuffer(row["contexts"], "<i8").reshape(order - 1, own.shape[1])
                below = probabilities(list(own), list(contexts), weights, known, tokens)[-1]
                context = np.full(own.shape[1], tokens) if level == 0 else contexts[level - 1]
                ratio = own[level] / np.maximum(context, 1) / below
                step = np.where(ratio > 0, np.floor(np.log2(np.maximum(ratio, 1e-300)) * STEPS), -(1 << 20)).astype(np.int64)
                which, at = np.unique(bucket(context).astype(np.int64) << 32 | (step + (1 << 21)), return_inverse=True)
                n, sums = np.bincount(at), np.bincount(at, ratio)
                for key, a, b in zip(which.tolist(), n.tolist(), sums.tolist()):
                    total[key] = total.get(key, 0) + np.array([a, b])
        if total:
            yield pa.record_batch([pa.array([k >> 32 for k in total], pa.int32()), pa.array([k & 0xFFFFFFFF for k in total], pa.int64()), pa.array([int(x[0]) for x in total.values()]), pa.array([float(x[1]) for x in total.values()])], ["bucket", "step", "n", "ratios"])

    return run


def mixture_weight(n: np.ndarray, ratio: np.ndarray, rounds: int = 500) -> float:
    """The weight of the upper estimate, by expectation-maximisation over n tokens each whose upper probability is `ratio` times the lower one.

    One token for and one against are added, so the weight is never 0 or 1.
    """
    w = 0.5
    for _ in range(rounds):
        after = (float((n * (w * ratio / (w * ratio + 1 - w))).sum()) + 1) / (float(n.sum()) + 2)
        if abs(after - w) < 1e-9:
            return after
        w = after
    return w


def _weights(events: DataFrame, order: int, known: int, tokens: int) -> list[np.ndarray]:
    """For each level the weights by bucket. A bucket without tokens takes the weight of the next lower one that has some, else of the next higher, else a half."""
    weights: list[np.ndarray] = []
    for level in range(order):
        parts = events.mapInArrow(_histogram(level, order, weights, known, tokens), "bucket int, step long, n long, ratios double")
        rows = parts.groupBy("bucket", "step").agg(F.sum("n").alias("n"), F.sum("ratios").alias("ratios")).collect()  # LEVELS times some hundred steps at most
        learnt = {}
        for b in sorted({r.bucket for r in rows} - {0}):
            own = [(r.n, r.ratios / r.n) for r in rows if r.bucket == b]
            learnt[b] = mixture_weight(np.array([x[0] for x in own], float), np.array([x[1] for x in own]))
        w = np.zeros(LEVELS)
        for b in range(1, LEVELS):
            w[b] = learnt[max((x for x in learnt if x <= b), default=min(learnt))] if learnt else 0.5
        weights.append(w)
    return weights


def _scores(order: int, buckets: int, weights: list[np.ndarray], known: int, tokens: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk, replies in _with_replies(batches, order, buckets):
            own, contexts = chunk.counts(_joined(replies, "words"), _joined(replies, "grams"))
            p = probabilities(own, contexts, weights, known, tokens)[-1]
            base, score = (np.add.reduceat(np.log10(x), chunk.first) for x in ((own[0] + 1) / (tokens + known + 1), p))
            columns = [pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], "u1").astype(bool)), pa.array(np.frombuffer(row["held"], "u1").astype(bool)), pa.array(chunk.lengths.astype(np.int64)),
                       pa.array(np.add.reduceat((own[0] > 0).astype(np.int64), chunk.first)), pa.array(np.full(len(chunk.first), tokens, np.int64)), pa.array(base), pa.array(score)]
            yield pa.record_batch(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _met(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Each chunk's row, then its replies by bucket."""
    texts = chunks.withColumn("bucket", F.lit(-1))
    both = texts.unionByName(replies.drop("kind", "stats"), allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", "bucket")


def score(docs: DataFrame, learnable: Column, held_out: Column, order: int = ORDER, held: int = HELD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text; further columns are left out).

    Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end token a text. The model (see above) learns from the rows where `learnable` holds (not
    null); one of `held` of them, by a hash of doc_id and text, teaches the weights. n_known: tokens that learnable texts hold; train_tokens: how many tokens those hold;
    base_score: the sum of log10((count + 1) / (train_tokens + distinct + 1)); score: the text's log10 probability.

    Null, empty and blank texts are one end token. Repeated rows count as often as they stand, and each gets its score. With nothing to learn from,
    every token is the unknown word, of probability 1. A text of any length is scored whole, in one chunk. An empty table gives an empty result.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learnable, F.lit(False)).alias("learn"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    aside = F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(held)) == 0
    kind = F.when(~F.col("learn"), NOT_LEARNT).when(aside, PUT_ASIDE).otherwise(COUNTED)
    chunks = written(own.select("doc_id", "held_out", kind.alias("kind"), "text").mapInArrow(_chunks, _TEXTS), "lm-chunks", by=["kind"])
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = buckets_for(order * total // TOKEN_BYTES, BUCKET)
    sent = chunks.select([x.split()[0] for x in _TEXTS.split(", ")]).mapInArrow(_entries(order, buckets), _ENTRIES)
    replies = written(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_totals, _REPLIES), "lm-replies", by=["kind"])
    stats = replies.where("kind = -1").agg(*(F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(4))).first()
    aside_rows = _met(chunks.where(F.col("kind") == PUT_ASIDE), replies.where(F.col("kind") == PUT_ASIDE))
    events = saved(aside_rows.mapInArrow(_events(order, buckets), "counts binary, contexts binary"), "lm-events")
    weights = _weights(events, order, stats[2], stats[3])
    return _met(chunks, replies.where("kind >= 0")).mapInArrow(
        _scores(order, buckets, weights, stats[0], stats[1]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
