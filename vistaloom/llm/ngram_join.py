"""N-gram Jaccard join by multiple-global-order prefix filtering.

Two documents link when their sets of word shingles have a Jaccard similarity of at least `percent` / 100: sets of n and m
shingles must then share o = ceil(percent (n + m) / (100 + percent)). Under any total order of all shingles let a set's prefix
be its first p = n - ceil(percent n / 100) + 1 + n // SHARED. Of the prefix that ends first, at most n - o shingles are missing
in the other set, so the two prefixes share at least p - n + o. That must hold under three orders at once: order 0 puts rare shingles first (by
counts in a sketch of fixed size), which keeps common passages out of the prefixes; orders 1 and 2 are hashed. What passes all
three filters is verified on whole sets.

Candidates are found in lists (the sets that have a shingle in their prefix of order 0) without making all pairs of a list:

- A set takes part only if enough of its prefix is in lists with sets of other components and of sizes that suit it (`_open`).
  That is counted by bands of sizes, in rows that grow with the lists, not with their squares.
- Two linear rounds pair each set with the one representative of another component that most of its lists name. They merge
  groups of near copies into components.
- What is still open is enumerated exactly, between components only, at the shingle that may be the first one a pair shares
  and for sizes whose bound both sets can meet. So no link between components is missed and none inside one is needed.

Shingles are compared by 64-bit hashes: a wrong verdict on a pair of 1,000-shingle sets needs a collision between those
two sets (chance about 1e-13); a set's own identity is 64 bits of its content and size. Prefixes of fetched sets are cut to
32 bits, with the number of collisions inside each, which the filters allow for.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaloom.llm.graph import components
from vistaloom.llm.util import LOWER_AZ, UPPER_AZ, Words, bits, bucket_of, buckets_for, mix, saved, slices

_U = np.uint64
SKETCH_LOG2 = 20
BLOCK = 4096
#: A shingle counted this much more often than the sketch's mean (or 8 times the spread, if that is more) is hot: its list is dealt over many buckets.
HOT = 512
#: Linear rounds ahead of the exact enumeration, which finds whatever they leave; and the width of a band of sizes.
ROUNDS, BAND = 2, 1.04
FLUSH = 1 << 19


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text that has words."""
    words = Words(batch.column("text"))
    hashes = words.hashes()
    at, grams = words.grams(k, hashes)
    whole = words.whole(hashes)
    first = np.searchsorted(at, words.first)
    for row in np.flatnonzero(words.counts):
        own = grams[first[row] : first[row + 1]]
        yield row, np.unique(own) if len(own) else whole[row : row + 1]


def _signature(grams: np.ndarray) -> int:
    return int((mix(grams, 5).sum(dtype=_U) ^ mix(np.array([len(grams)], _U), 6)[0]).astype(np.int64))


#: Prefixes are longer by this part of the set than the least that makes similar sets share a shingle of them.
SHARED = 10


def _prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 + n // SHARED


def _overlap(n: str, m: str, percent: int) -> str:
    """SQL: the shingles that similar sets of n and m shingles share at least."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _needed(n: str, m: str, percent: int) -> str:
    """SQL: how many of them are in both prefixes, under any order."""
    extra = [f"(1 + {x} div {SHARED} - ({percent} * {x} + 99) div 100)" for x in (n, m)]
    return f"({_overlap(n, m, percent)} + least({', '.join(extra)}))"


def _needed_in_band(n: str, band: str, percent: int) -> str:
    """SQL: a lower bound of _needed over all sizes of a band. Between the sizes that suit n it rises up to n and falls beyond, but for roundings of under 2."""
    ends = [f"greatest({n} * {percent / 100}D, least({n} * {100 / percent}D, power({BAND}D, {band} + {i})))" for i in (0, 1)]
    return f"least({', '.join(f'({percent / (100 + percent)}D * ({n} + {m}) - {percent / 100 - 1 / SHARED}D * greatest({n}, {m}) - 1)' for m in ends)})"


def _statistics(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_LOG2, np.int64)
        for batch in slices(batches, limit=2 << 20):
            n, sig, seen = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for row, grams in _sets(batch, k):
                n[row], sig[row] = len(grams), _signature(grams)
                seen.append(grams)
            if seen:
                counts += np.bincount(np.concatenate(seen) >> _U(64 - SKETCH_LOG2), minlength=1 << SKETCH_LOG2)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(sig), pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], ["doc_id", "n", "sig", "block", "counts"])
        if counts.any():
            rows = counts.reshape(-1, BLOCK).astype("<i4")
            m = len(rows)
            yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.arange(m, dtype=np.int32)), pa.array([x.tobytes() for x in rows], pa.binary())], ["doc_id", "n", "sig", "block", "counts"])

    return run


def _add_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            own = np.frombuffer(counts, "<i4").astype(np.int64)
            total[block] = total[block] + own if block in total else own
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def sketch_of(stats: DataFrame) -> np.ndarray:
    """Counts of all shingles in 2**SKETCH_LOG2 slots: 4 MB, whatever the input."""
    parts = stats.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_add_blocks, "block int, counts binary")
    out = np.zeros(1 << SKETCH_LOG2, np.int32)
    for row in parts.collect():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(bytes(row.counts), "<i4")
    return out


def _ranks(grams: np.ndarray, counts: np.ndarray | None, order: int) -> np.ndarray:
    """Each shingle's place in a global order: by count and then hash in order 0, by a seeded hash in the others."""
    h = mix(grams, 100 + order)
    return h if counts is None else (np.minimum(counts, (1 << 24) - 1).astype(_U) << _U(40)) | (h >> _U(24))


def _prefix(grams: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """Those of the set that come first; all that tie with the last of them too, so that the filter stays exact."""
    p = _prefix_length(len(grams), percent)
    return grams[ranks <= np.partition(ranks, p - 1)[p - 1]] if p < len(grams) else grams


def _postings(k: int, percent: int, buckets: int, sketch, hot_at: int):
    """Rows of postings of order 0, bucketed by shingle: the blobs of a row have an entry for each posting."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held, size = sketch.value, set(), [], 0

        def flush() -> pa.RecordBatch:
            tokens, place, hot = (np.concatenate([x[i] for x in held]) for i in (0, 3, 4))
            lengths = [len(x[0]) for x in held]
            sig, n = (np.repeat(np.array([x[i] for x in held], kind), lengths) for i, kind in ((1, "<i8"), (2, "<i4")))
            bucket = bucket_of(np.where(hot, mix(tokens ^ sig.view(_U), 9), tokens), buckets)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            columns = [x[order] for x in (tokens, sig, n, place, hot)]
            return pa.record_batch([pa.array(bucket[cuts[:-1]]), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in columns)], ["bucket", "token", "sig", "n", "place", "hot"])

        for batch in slices(batches, limit=2 << 20):
            for _, grams in _sets(batch, k):
                sig = _signature(grams)
                if sig in seen:
                    continue
                seen.add(sig)
                own = counts[(grams >> _U(64 - SKETCH_LOG2)).astype(np.int64)]
                first = np.argsort(_ranks(grams, own, 0), kind="stable")[: _prefix_length(len(grams), percent)]
                held.append((grams[first], sig, len(grams), np.arange(len(first), dtype="<i4"), own[first] > hot_at))
                size += len(first)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
                    seen = set() if len(seen) > 1 << 20 else seen
        if held:
            yield flush()

    return run


LIST_SCHEMA = "token long, sig long, n int, place int"


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted buckets: the lists of two sets or more, each set once. Of hot shingles, whose lists are spread, all entries."""
    kinds = (("token", "<u8"), ("sig", "<i8"), ("n", "<i4"), ("place", "<i4"), ("hot", "?"))

    def done(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        token, sig, n, place, hot = (np.concatenate([np.frombuffer(p[i], kind) for p in parts]) for i, (_, kind) in enumerate(kinds))
        order = np.argsort(token, kind="stable")
        t = token[order]
        same = np.r_[False, t[1:] == t[:-1]]
        order = order[same | np.r_[same[1:], False] | hot[order]]
        order = order[np.lexsort((sig[order], token[order]))]
        token, sig, n, place, hot = (x[order] for x in (token, sig, n, place, hot))
        fresh = np.r_[True, (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])] if len(token) else np.zeros(0, bool)
        token, sig, n, place, hot = (x[fresh] for x in (token, sig, n, place, hot))
        same = np.r_[False, token[1:] == token[:-1]] if len(token) else np.zeros(0, bool)
        keep = np.flatnonzero(same | np.r_[same[1:], False] | hot) if len(token) else np.zeros(0, int)
        for a in range(0, len(keep), 1 << 16):
            i = keep[a : a + (1 << 16)]
            yield pa.record_batch([pa.array(token[i].view(np.int64)), pa.array(sig[i]), pa.array(n[i]), pa.array(place[i])], ["token", "sig", "n", "place"])

    current, parts = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != current and parts:
                yield from done(parts)
                parts = []
            current = row[0]
            parts.append(row[1:])
    if parts:
        yield from done(parts)


SET_SCHEMA = "sig long, n int, grams binary, first0 array<int>, first1 array<int>, first2 array<int>, lost int"


def _chosen_sets(k: int, percent: int, wanted, sketch):
    """The sets that may still link, each with its prefixes under the three orders and the collisions in them at 32 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, counts, seen = wanted.value, sketch.value, set()
        types = (pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.int32())
        for batch in slices(batches, limit=2 << 20):
            out: list[tuple] = []
            for _, grams in _sets(batch, k):
                sig = _signature(grams)
                if sig in seen or not chosen.has(sig):
                    continue
                seen.add(sig)
                firsts, lost = [], 0
                for order in (0, 1, 2):
                    own = counts[(grams >> _U(64 - SKETCH_LOG2)).astype(np.int64)] if order == 0 else None
                    first = _prefix(grams, _ranks(grams, own, order), percent)
                    cut = np.unique(first.astype(np.uint32))
                    firsts.append(cut.view(np.int32))
                    lost = max(lost, len(first) - len(cut))
                out.append((sig, len(grams), grams.tobytes(), *firsts, lost))
            seen = set() if len(seen) > 1 << 20 else seen
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], [x.split()[0] for x in SET_SCHEMA.split(", ")])

    return run


def _verify(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b): those that pass the filters of all three orders, and whose sets are similar enough."""
    side = lambda name, *columns: sets.select(F.col("sig").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
    needed = F.expr(_needed("n_a", "n_b", percent)) - F.least("lost_a", "lost_b")
    prefixes = ("n", "lost", "first0", "first1", "first2")
    both = pairs.join(side("a", *prefixes), "a").join(side("b", *prefixes), "b")
    for order in (0, 1, 2):
        both = both.where(F.size(F.array_intersect(f"first{order}_a", f"first{order}_b")) >= needed)
    whole = both.select("a", "b").join(side("a", "grams"), "a").join(side("b", "grams"), "b").select("a", "b", F.col("grams_a").alias("x"), F.col("grams_b").alias("y"))
    return whole.mapInArrow(_verify(percent), "a long, b long")


def _similar_size(n: str, m: str, percent: int) -> Column:
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _open(rows: DataFrame, label: DataFrame | None, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, able): the rows (token, sig, n, place) of sets that may still link with a set of another component, with band and component,
    and (sig, other, c): to sets of which bands, and in how many tokens it meets such sets of other components."""
    rows = rows.select("token", "sig", "n", "place")
    if label is None:
        rows = rows.withColumn("component", F.col("sig"))
    else:
        rows = rows.join(label.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int"))
    bands = rows.groupBy("token", F.col("band").alias("other")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    reach = math.ceil(math.log(100 / percent) / math.log(BAND))
    faced = rows.join(bands, "token").where((F.abs(F.col("band") - F.col("other")) <= reach) & ((F.col("lo") != F.col("component")) | (F.col("hi") != F.col("component"))))
    able = faced.groupBy("sig", "other").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.expr(f"c >= {_needed_in_band('n', 'other', percent)}"))
    able = saved(able.select("sig", "other", "c"), f"{name}-able")
    rows = rows.join(able.groupBy("sig").agg(F.max("c").alias("c")), "sig")
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    return saved(rows.join(mixed, "token", "left_semi"), name), able


def _offers(rows: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """a, b: each set with the representative of another component that most of its lists name. A list's representative is the set with the largest
    part of its prefix in lists; for sets of its own component it is the one of another component."""
    share = rows.groupBy("sig").agg((F.count("*") / F.first("n")).alias("share"))
    rows = rows.join(share, "sig")
    best = F.max(F.struct("share", "sig", "n", "component"))
    leads = rows.groupBy("token").agg(best.alias("lead"))
    seconds = rows.join(leads, "token").where(F.col("component") != F.col("lead.component")).groupBy("token").agg(best.alias("second"), F.first("lead").alias("lead"))
    other = F.when(F.col("component") == F.col("lead.component"), F.col("second")).otherwise(F.col("lead"))
    met = rows.join(seconds, "token").select("sig", "n", other.alias("o")).select("sig", "n", F.col("o.sig").alias("other"), F.col("o.n").alias("other_n"))
    named = met.where(_similar_size("n", "other_n", percent)).groupBy("sig", "other").agg(F.count("*").alias("c"))
    if tried is not None:
        named = named.join(tried.select(F.col("a").alias("sig"), F.col("b").alias("other")).unionByName(tried.select(F.col("b").alias("sig"), F.col("a").alias("other"))), ["sig", "other"], "left_anti")
    chosen = named.groupBy("sig").agg(F.max(F.struct("c", "other")).alias("x"))
    return chosen.select(*_pair("sig", "x.other")).distinct()


def _across(rows: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs of sets of different components that may be similar, by the tokens that may be the first they share."""
    rows = rows.where(F.expr(f"place <= n - ({percent} * n + 99) div 100"))
    left = rows.drop("c", "band").join(able, "sig").withColumnRenamed("other", "band")
    right = rows.select("token", "band", *(F.col(c).alias(f"other_{c}") for c in ("sig", "n", "place", "component", "c")))
    overlap, needed = _overlap("n", "other_n", percent), _needed("n", "other_n", percent)
    fits = F.expr(f"place <= n - {overlap} and other_place <= other_n - {overlap} and c >= {needed} and other_c >= {needed}")
    met = left.join(right, ["token", "band"]).where((F.col("component") < F.col("other_component")) & _similar_size("n", "other_n", percent) & fits)
    return met.select(*_pair("sig", "other_sig")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text; further columns are left out).

    Words are runs of characters other than ASCII white space, A-Z lower-cased. component_id is the smallest doc_id
    reachable by links, a document's own if it has none. Texts with fewer than k words have their whole sequence as
    their one shingle. Null, empty and blank texts have none, link with nothing and are their own component. Repeated rows
    stay; equal sets are one component. A null doc_id keeps its row and counts for no component's smallest doc_id.
    Texts of any length are one set each. An empty table gives an empty result. `hot` and `rounds` change the work, not the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select("doc_id", "text")
    stats = saved(texts.mapInArrow(_statistics(k), "doc_id long, n long, sig long, block int, counts binary"), "shingle-stats")
    sketch = sketch_of(stats)
    counted = stats.where("block is null")
    entries = counted.agg(F.sum("n")).first()[0] or 0
    buckets = buckets_for(entries * (100 - percent + 100 // SHARED) // 100, 1 << 19)
    shared = spark.sparkContext.broadcast(sketch)
    hot_at = int(sketch.mean()) + (max(hot, int(8 * math.sqrt(sketch.mean()))) if hot > 0 else hot)
    postings = texts.mapInArrow(_postings(k, percent, buckets, shared, hot_at), "bucket int, token binary, sig binary, n binary, place binary, hot binary")
    lists = saved(postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_lists, LIST_SCHEMA), "shingle-lists")

    rows, able = _open(lists, None, percent, "open-0")
    live = able.select("sig").distinct()
    wanted = spark.sparkContext.broadcast(bits(live, "sig"))
    sets = saved(texts.mapInArrow(_chosen_sets(k, percent, wanted, shared), SET_SCHEMA).dropDuplicates(["sig"]), "sets")
    wanted.destroy()
    shared.destroy()
    links = tried = label = None
    for i in range(1, rounds + 1):
        pairs = saved(_offers(rows, tried, percent), f"pairs-{i}")
        found = saved(_links(pairs, sets, percent), f"links-{i}")
        tried, links = (pairs, found) if tried is None else (tried.unionByName(pairs), links.unionByName(found))
        label = components(links, "a", "b")
        rows, able = _open(rows, label, percent, f"open-{i}")
    across = _across(rows, able, percent)
    if tried is not None:
        across = across.join(tried, ["a", "b"], "left_anti")
    found = saved(_links(saved(across, "pairs-across"), sets, percent), "links-across")
    label = components(found if links is None else links.unionByName(found), "a", "b")

    first = counted.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id")).join(label.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = first.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = first.join(least, "component").select("sig", F.lit(True).alias("has"), "component_id")
    out = counted.withColumn("has", F.col("n") > 0).join(named, ["sig", "has"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS t FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
