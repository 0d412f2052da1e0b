"""Character n-gram classifiers: language identification and toxicity.

Both hash the n-grams of lower-cased text into a fixed number of slots. What is gathered from the corpus is a vector of counts of that
size: each task adds up its own, and blocks of the vectors are added across tasks. Learning runs over a bounded sample of
labelled rows, drawn by a hash of the row; scoring is a pass over all texts with the model broadcast, and shuffles nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaloom.llm.util import maybe_in, mix, record, saved, slices

_U = np.uint64
BLOCK = 4096
_GRAM_BASE = 0xD6E8FEB86659FD93


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


class Grams:
    """Slots of the character n-grams of a batch of texts: windows of code points over lower-cased text with each run of other characters as one space.

    Characters that count are ASCII letters, all beyond ASCII and, with `digits`, 0-9. With `inside` set, n-grams don't cross from one word into
    the next (a space may begin or end one).
    """

    def __init__(self, orders: tuple[int, ...], log2: int, inside: bool = False, digits: bool = False):
        self.orders, self.log2, self.inside, self.digits = orders, log2, inside, digits

    def slot(self, gram: str) -> int:
        """The slot of one n-gram."""
        packed = 0
        for c in gram:
            packed = (packed * _GRAM_BASE + ord(c)) % (1 << 64)
        return int(mix(np.array([packed], _U), len(gram))[0] >> _U(64 - self.log2))

    def __call__(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order (slots, first): slots[first[i]:first[i + 1]] are text i's."""
        texts = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        # Each text gets a space of its own in front and behind; of a run of other characters the first stays, as a space.
        bounds = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets - offsets[0]] + 2 * np.arange(n + 1)
        padded = np.full(len(points) + 2 * n, 0x20, np.uint32)
        hole = np.ones(len(padded), bool)
        hole[bounds[:-1]] = hole[bounds[1:] - 1] = False
        padded[hole] = points
        letter = (padded >= 0x80) | ((padded >= 0x61) & (padded <= 0x7A))
        if self.digits:
            letter |= (padded >= 0x30) & (padded <= 0x39)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[bounds[:-1]] = True
        clean = np.where(letter, padded, 0x20)[keep]
        bounds = np.r_[0, np.cumsum(keep)][bounds]
        last = np.repeat(bounds[1:], np.diff(bounds))
        total, space, value = len(clean), clean == 0x20, clean.astype(_U)
        packed, out = np.zeros(total, _U), []
        for k in range(1, max(self.orders) + 1):
            own = packed[: max(total - k + 1, 0)]
            own *= _U(_GRAM_BASE)
            own += value[k - 1 :]
            if k in self.orders:
                at = np.arange(k, total + k) <= last
                at &= ~space if k == 1 else True
                if self.inside:
                    for j in range(1, k - 1):
                        at[: total - j] &= ~space[j:]
                i = np.flatnonzero(at)
                out.append(((mix(packed[i], k) >> _U(64 - self.log2)).astype(np.int32), np.searchsorted(i, bounds)))
        return out


def _of(found: list[tuple[np.ndarray, np.ndarray]], i: int) -> np.ndarray:
    return np.concatenate([slots[first[i] : first[i + 1]] for slots, first in found])


def _once(found: list[tuple[np.ndarray, np.ndarray]], i: int, latest: np.ndarray) -> np.ndarray:
    """Text i's slots, each once. latest, a number a slot, is scratch space."""
    own = _of(found, i)
    order = np.arange(len(own), dtype=np.int32)
    latest[own] = order
    return own[latest[own] == order]


def _document_counts(grams: Grams, groups: int):
    """Rows (group, block, counts): in how many texts of each group a slot occurs, and in an extra block -1 how many texts there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << grams.log2
        counts, texts = np.zeros((groups, size), np.int32), np.zeros(groups, np.int64)
        latest = np.zeros(size, np.int32)
        for batch in slices(batches, limit=2 << 20):
            found = grams(batch.column("text"))
            for i, group in enumerate(batch.column("grp").to_pylist()):
                counts[group][_once(found, i, latest)] += 1
                texts[group] += 1
        out = []
        for g in range(groups):
            if texts[g]:
                out.append((g, -1, np.array([texts[g]], "<i8").tobytes()))
                out += [(g, b, x.astype("<i8").tobytes()) for b, x in enumerate(counts[g].reshape(-1, BLOCK)) if x.any()]
        for a in range(0, len(out), 128):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out[a : a + 128]), (pa.int32(), pa.int32(), pa.binary()))], ["grp", "block", "counts"])

    return run


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for g, b, counts in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(counts, "<i8")
            total[g, b] = total[g, b] + own if (g, b) in total else own
    if total:
        yield pa.record_batch([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["grp", "block", "counts"])


def document_counts(rows: DataFrame, grams: Grams, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """rows (grp 0..groups-1, text) -> (texts a group, texts with each slot a group), over all rows."""
    schema = "grp int, block int, counts binary"
    parts = rows.select("grp", "text").mapInArrow(_document_counts(grams, groups), schema).repartition("grp", "block").mapInArrow(_add, schema)
    texts, counts = np.zeros(groups, np.int64), np.zeros((groups, 1 << grams.log2), np.int64)
    for row in parts.collect():  # groups * 2**log2 numbers at most
        own = np.frombuffer(bytes(row.counts), "<i8")
        if row.block < 0:
            texts[row.grp] = own[0]
        else:
            counts[row.grp, row.block * BLOCK : (row.block + 1) * BLOCK] = own
    return texts, counts


#: Bytes of text in a sample's group at most.
SAMPLE_BYTES = 32 << 20


def bounded_sample(rows: DataFrame, group: str, per_group: int, seed: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most per_group rows and most_bytes of text of each group, those with the smallest seeded hash of doc_id and text.

    Texts of more than a sixteenth of most_bytes come after all others, so none of them ends a sample early; the first row stays whatever its size, so no
    group is lost. Equal rows count once. A first cut by the hash leaves about twice as many rows, so no window holds more than that of a group. Rows that
    tie in the hash go by doc_id, then length.
    """
    keyed = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    size = F.octet_length("text")
    large = size > most_bytes // 16
    sizes = {(r[group], r["large"]): r["n"] for r in rows.groupBy(group, large.alias("large")).agg(F.count("*").alias("n")).collect()}
    cut = F.lit(False)
    for (value, is_large), n in sizes.items():
        share = min(1.0, (2 * per_group + 200) / n)
        limit = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
        cut = cut | ((F.col(group) == F.lit(value)) & (large == F.lit(is_large)) & (F.col("_h") <= F.lit(limit)))
    ahead = Window.partitionBy(group).orderBy(large, "_h", "doc_id", size).rowsBetween(Window.unboundedPreceding, 0)
    once = keyed.where(cut).dropDuplicates([group, "_h", "doc_id"])
    ranked = once.withColumn("_n", F.count("*").over(ahead)).withColumn("_b", F.sum(size).over(ahead))
    return ranked.where((F.col("_n") == 1) | ((F.col("_n") <= per_group) & (F.col("_b") <= most_bytes))).drop("_n", "_b", "_h")


def _features(grams: Grams):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            found = grams(batch.column("text"))
            own = []
            for i in range(batch.num_rows):
                slots, counts = np.unique(_of(found, i), return_counts=True)
                own.append((slots.astype("<i4").tobytes(), counts.astype("<i4").tobytes()))
            yield pa.record_batch([batch.column("grp"), batch.column("h"), pa.array([x[0] for x in own], pa.binary()), pa.array([x[1] for x in own], pa.binary())], ["grp", "h", "slots", "counts"])

    return run


def features(sample: DataFrame, grams: Grams) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(group, slots, counts) of the rows of a bounded sample, in the order of a hash."""
    rows = sample.select("grp", F.xxhash64(F.lit(5), "doc_id", "text").alias("h"), "text").mapInArrow(_features(grams), "grp int, h long, slots binary, counts binary").collect()
    rows.sort(key=lambda r: (r.h, r.grp))
    return [(r.grp, np.frombuffer(bytes(r.slots), "<i4"), np.frombuffer(bytes(r.counts), "<i4").astype(float)) for r in rows]


# ---- language identification ---------------------------------------------------------------------------------

LANGUAGE_GRAMS = Grams((1, 2, 3), 16)
#: Labelled rows learnt from at most, of each language; a tenth of them is held back for the temperature.
PER_LANGUAGE, EPOCHS = 600, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.2, 0.00001
#: Languages learnt at most, those with the most rows; the part of a label that is shared out when the temperature is sought.
LANGUAGES, SMOOTH = 200, 0.01


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_regularised_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, size: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights (size, classes) of multinomial logistic regression by FTRL-proximal steps, a row at a time, with elastic-net penalties."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for label, slots, x in rows:
            w = weights(slots)
            p = _softmax((x[:, None] * w).sum(axis=0))
            p[label] -= 1
            g = x[:, None] * p[None, :]
            grown = n[slots] + g * g
            z[slots] += g - (np.sqrt(grown) - np.sqrt(n[slots])) / alpha * w
            n[slots] = grown
    return weights(slice(None))


def temperature(scores: np.ndarray, labels: np.ndarray, smooth: float = SMOOTH) -> float:
    """The temperature, of a fixed grid, under which the labels are likeliest.

    A label counts as `smooth` shared out over all classes, the rest its own; else rows that are all right would ask for the least temperature there is.
    """
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.001), np.log(20), 300))
    own = np.arange(len(labels)), labels

    def loss(t: float) -> float:
        logs = np.log(np.maximum(_softmax(scores / t), 1e-12))
        return float(-((1 - smooth) * logs[own] + smooth * logs.mean(axis=1)).mean())

    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def calibration_error(scores: np.ndarray, right: np.ndarray, steps: int = 10) -> float:
    """The expected calibration error: how far the mean score of a step of scores is from the share of right answers in it, weighted by rows."""
    at = np.minimum((scores * steps).astype(int), steps - 1)
    return float(sum(abs(scores[at == k].mean() - right[at == k].mean()) * (at == k).mean() for k in range(steps) if (at == k).any()))


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Relative frequencies times inverse document frequencies, at a fixed scale."""
    return counts / max(counts.sum(), 1) * idf * 10


_ASCII_LETTER = re.compile("[A-Za-z]")


def _has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _add_up(sums: np.ndarray, values: np.ndarray, first: np.ndarray) -> None:
    """Adds the sum of values[first[i]:first[i + 1]] to sums[i]."""
    some = np.flatnonzero(np.diff(first))
    if len(some):
        sums[some] += np.add.reduceat(values, first[some], axis=0, dtype=float)


def _languages(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, t = shared.value
        for batch in slices(batches, limit=2 << 20):
            sums, n = np.zeros((batch.num_rows, max(len(names), 1))), np.zeros(batch.num_rows)
            if names:
                for slots, first in LANGUAGE_GRAMS(batch.column("text")):
                    _add_up(sums, table[slots], first)
                    n += np.diff(first)
            p = _softmax(sums / np.maximum(n, 1)[:, None] / t)
            letters = np.array([_has_letter(x) for x in batch.column("text").to_pylist()], bool)
            best = p.argmax(axis=1)
            known = letters & bool(names)
            lang = [names[b] if k else "und" for b, k in zip(best, known)]
            score = np.where(known, p[np.arange(len(p)), best], 0.0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def train_languages(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, float]:
    """labelled (doc_id, text, lang without null) -> languages, weight of a slot's one occurrence for each, temperature."""
    frequent = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    names = sorted(r.lang for r in frequent.collect())
    if not names:
        return [], np.zeros((1 << LANGUAGE_GRAMS.log2, 0), np.float32), 1.0
    number = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1
    rows = labelled.select("doc_id", "text", number.alias("grp")).where("grp >= 0")
    texts, counts = document_counts(rows.select(F.lit(0).alias("grp"), "text"), LANGUAGE_GRAMS, 1)
    idf = np.log((1 + texts[0]) / (1 + counts[0])) + 0.1
    sample = [(g, s, _tfidf(c, idf[s])) for g, s, c in features(bounded_sample(rows, "grp", per_language, 3), LANGUAGE_GRAMS) if len(s)]
    apart = max(1, len(sample) // 10)
    weights = follow_regularised_leader(sample[apart:], len(names), 1 << LANGUAGE_GRAMS.log2)
    scores = np.array([(x[:, None] * weights[s]).sum(axis=0) for _, s, x in sample[:apart]]).reshape(-1, len(names))
    t = temperature(scores, np.array([g for g, _, _ in sample[:apart]], int))
    return names, (weights * idf[:, None] * 10).astype(np.float32), t


def identify(docs: DataFrame, learnable: Column, held_out: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang; further columns are left out).

    A model is trained on the rows where `learnable` holds and text and lang are not null; document frequencies count all of these, the
    regression at most per_language of each language (and SAMPLE_BYTES). Of equally likely languages the first by name is predicted. Texts of any length are scored whole. Null texts and texts without a letter are `und` with score 0, and so is
    everything if there is nothing to learn from. Repeated rows count as often as they stand; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), learnable.alias("_learn"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    labelled = own.where(F.col("_learn") & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(train_languages(labelled, per_language))
    return own.select("doc_id", "held_out", "text").mapInArrow(_languages(shared), "doc_id long, held_out boolean, lang_pred string, score double")


# ---- toxicity ------------------------------------------------------------------------------------------------

TOXIC_GRAMS = Grams((4, 5, 6), 20, inside=True, digits=True)
#: Labelled rows of each class that the classifier is fitted on at most; the log-count ratios count all of them.
PER_CLASS, PASSES = 2500, 6
#: Counts added to a slot's, shared out as the classes are; standard errors at which a ratio is halved; cost of a row's loss, and of one of class 1 beside it.
SMOOTHING, HALVED, COST, MISSED = 1.0, 3.5, 1.0, 2.0


def log_count_ratios(texts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each slot: log of how much more frequent it is, smoothed, in texts of class 1 than of class 0.

    A ratio is drawn towards 0 as its standard error e demands, by r**4 / (r**4 + (HALVED e)**4): most slots of a text are rare and say little, and thousands
    of them would drown the few that do. No slot is left out.
    """
    return np.concatenate([_ratios(texts, part) for part in np.array_split(counts, max(1, counts.shape[1] // (1 << 16)), axis=1)])


def _ratios(texts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    more = 2 * SMOOTHING * texts / texts.sum()
    p, q = ((counts[c] + more[c]) / (texts[c] + 2 * more[c]) for c in (1, 0))
    ratio = np.log(p / q)
    squared = sum(1 / (counts[c] + more[c]) - 1 / (texts[c] + 2 * more[c]) for c in (1, 0))
    return ratio**5 / (ratio**4 + (HALVED**2 * squared) ** 2)


class Occurrences:
    """The slots (under 2**20) of a text, ascending, at two bytes each: the low halves, and how many slots each high half has."""

    def __init__(self, low: bytes, parts: bytes):
        self.low, self.parts = low, parts

    @staticmethod
    def packed(slots: np.ndarray) -> tuple[bytes, bytes]:
        return (slots & 0xFFFF).astype("<u2").tobytes(), np.bincount(slots >> 16, minlength=16).astype("<i4").tobytes()

    def slots(self) -> np.ndarray:
        high = np.repeat(np.arange(16, dtype=np.int32) << 16, np.frombuffer(self.parts, "<i4"))
        return high | np.frombuffer(self.low, "<u2")


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=2 << 20):
        found = TOXIC_GRAMS(batch.column("text"))
        own = [Occurrences.packed(np.unique(_of(found, i))) for i in range(batch.num_rows)]
        yield pa.record_batch([batch.column("grp"), batch.column("h"), pa.array([x[0] for x in own], pa.binary()), pa.array([x[1] for x in own], pa.binary())], ["grp", "h", "low", "parts"])


def occurrences(sample: DataFrame) -> list[tuple[int, Occurrences]]:
    """(group, all slots) of the rows of a bounded sample, in the order of a hash."""
    rows = sample.coalesce(4).select("grp", F.xxhash64(F.lit(5), "doc_id", "text").alias("h"), "text").mapInArrow(_occurrences, "grp int, h long, low binary, parts binary")
    found = [(r.h, r.grp, Occurrences(bytes(r.low), bytes(r.parts))) for r in rows.toLocalIterator()]  # a partition at a time
    found.sort(key=lambda x: x[:2])
    return [x[1:] for x in found]


def train_toxicity(labelled: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """labelled (doc_id, text, toxic 0/1) -> weight of each slot (its log-count ratio included), intercept.

    Logistic regression with a quadratic penalty on whether a slot occurs, scaled by its ratio.
    """
    rows = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("grp"))
    texts, counts = document_counts(rows, TOXIC_GRAMS, 2)
    size = 1 << TOXIC_GRAMS.log2
    if not texts.all():
        return np.zeros(size, np.float32), 4.0 if texts[1] else -4.0
    ratio = log_count_ratios(texts, counts)
    del counts  # the driver holds the sample next
    w, b = fit(occurrences(bounded_sample(rows, "grp", per_class, 4)), ratio, float(texts[1] / texts.sum()))
    return (w * ratio).astype(np.float32), b


def fit(sample: list[tuple[int, Occurrences]], ratio: np.ndarray, share: float, passes: int = PASSES, cost: float = COST, missed: float = MISSED) -> tuple[np.ndarray, float]:
    """Weights of the scaled features, and intercept: the least of (w.w + b b) / 2 + the sum of each row's cost times its logistic loss.

    Rows are weighted so that class 1 has the share it has in all rows, and then `missed` times that. Solved by dual coordinate ascent: a row's multiplier, between 0
    and its cost, is set by bisection with all others held, and w and b follow; no step size is needed.
    """
    ones = sum(g for g, _ in sample)
    costs = {1: cost * missed * share * len(sample) / max(1, ones), 0: cost * (1 - share) * len(sample) / max(1, len(sample) - ones)}
    w, b, multipliers = np.zeros(len(ratio)), 0.0, np.zeros(len(sample))
    squares = [float((ratio[own.slots()] ** 2).sum()) + 1 for _, own in sample]
    order = np.random.default_rng(1)
    for _ in range(passes):
        for i in order.permutation(len(sample)):
            label, own = sample[i]
            slots, sign, most = own.slots(), 2 * label - 1, costs[label]
            x = ratio[slots]
            margin, low, high = sign * (float(x @ w[slots]) + b), 0.0, most
            for _ in range(30):
                middle = (low + high) / 2
                loss = most / (1 + math.exp(min(50.0, max(-50.0, margin + (middle - multipliers[i]) * squares[i]))))
                low, high = (middle, high) if loss > middle else (low, middle)
            step = sign * (low - multipliers[i])
            multipliers[i] = low
            w[slots] += step * x
            b += step
    return w, float(b)


def _toxicity(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, b = shared.value
        latest = np.zeros(len(table), np.int32)
        for batch in slices(batches, limit=2 << 20):
            found = TOXIC_GRAMS(batch.column("text"))
            z = b + np.array([table[_once(found, i, latest)].sum(dtype=float) for i in range(batch.num_rows)])
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            yield pa.record_batch([*columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*(x for x in batch.schema.names if x != "text"), "score", "predicted"])

    return run


def _clean(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _toxicity(shared)
        for batch in slices(batches, limit=2 << 20):
            found = pa.concat_arrays([x.column("predicted") for x in score([batch.select(["text"])])])
            yield batch.select(["record"]).filter(pc.equal(found, 0))

    return run


def _model(texts: DataFrame, labels: DataFrame, per_class: int):
    """The broadcast model, learnt from texts (doc_id, text) that labels covers."""
    marks = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    marks = marks.withColumn("key", F.xxhash64("doc_id"))
    known, _ = maybe_in(texts.where(F.col("text").isNotNull()).withColumn("key", F.xxhash64("doc_id")), "key", marks, "key")
    # The same join at every size: labels grow with the corpus, so they are never broadcast.
    labelled = saved(known.hint("merge").join(marks.drop("key"), "doc_id").drop("key"), "labelled")
    return texts.sparkSession.sparkContext.broadcast(train_toxicity(labelled, per_class))


def _texts(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]


def drop_toxic(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that toxicity() predicts 0 for, all columns unchanged."""
    shared = _model(docs.where(learnable).select(*_texts(docs)), labels, per_class)
    rows = docs.select(record(docs), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_clean(shared), T.StructType([rows.schema["record"]])).select("record.*")


def toxicity(docs: DataFrame, labels: DataFrame, learnable: Column, held_out: Column, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text; further columns are left out).

    A model is trained on the rows where `learnable` holds and that labels (doc_id, toxic 0/1) covers; other values of toxic, nulls
    and null texts teach nothing. Null and empty texts get the score of no features. With labels of one class only, or none,
    there are no features. Texts of any length are scored whole. Rows repeated in docs or labels count as often as they stand; an empty table gives an
    empty result.
    """
    shared = _model(docs.where(learnable).select(*_texts(docs)), labels, per_class)
    own = docs.select(*_texts(docs), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return own.select("doc_id", "held_out", "text").mapInArrow(_toxicity(shared), "doc_id long, held_out boolean, score double, predicted int")
