"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of the hashes of k consecutive words, the smallest in each sliding window of `span` - k + 1 such hashes is kept (the rightmost
of equal ones), so texts that share `span` words keep the same hash at the same place of that span: its fingerprint. Fingerprints of the
benchmark are joined with those of the documents, and each hit is extended to the windows of `span` words that kept it,
which are compared word by word. So what counts in the end are exact runs of words, and no shared span is missed.

A Bloom filter of the benchmark's fingerprints (its size follows from their number and has a bound) is tested inside the
scan, before winnowing and before any row is made. A document makes one row for each of its windows whose fingerprint
passes, at most one a word, and a window meets each different text of the benchmark once, however often either side repeats
it: a text of one word repeated 20,000 times costs 20,000 rows. A passage that a third of all documents hold makes
rows of these documents only. Items that hold the same window are told by a number of that set of items, listed once a document.

Items of fewer words than `span` are one window each, whose fingerprint is the hash of all its words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaloom.llm.util import LOWER_AZ, UPPER_AZ, saved

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the filter for each fingerprint, and the most bits in all (2 MB).
BITS_EACH, MOST_LOG2 = 64, 24
#: Probes of the filter for each hash: three cuts of its 64 bits.
PROBES = 3
#: A table of windows up to so many rows (about 150 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1 << 18
WINDOW = ["length", "offset", "fingerprint", "window"]


def _words(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER_AZ, LOWER_AZ)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _range(first, last) -> Column:
    """first..last as an array, empty if last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, n: Column, k: int) -> Column:
    return F.transform(_range(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(hashes, i + t) for t in range(k))))


def _kept(grams: Column, s: Column, k: int, span: int) -> Column:
    """The place of the gram that the window of `span` words at s keeps: its smallest, the rightmost of equal ones."""
    w = span - k + 1
    part = F.slice(grams, s + 1, w)
    return (s + w - F.array_position(F.reverse(part), F.array_min(part))).cast("int")


def _window(s: Column, place: Column, length, fingerprint: Column) -> Column:
    """A window of words: where it starts, its fingerprint and where in it that is, and its text (words hold no spaces)."""
    text = F.array_join(F.slice("words", s + 1, length), " ")
    return F.struct(s.alias("start"), F.lit(length).cast("int").alias("length"), (place - s).cast("int").alias("offset"), fingerprint.alias("fingerprint"), text.alias("window"))


def _whole(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))


def _numbered(table: DataFrame, key: str) -> DataFrame:
    """row, the key, words, n, and a hash of each word."""
    words = table.select(F.monotonically_increasing_id().alias("row"), F.col(key), _words("text").alias("words"))
    return words.withColumn("n", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def windows(items: DataFrame, k: int, span: int) -> DataFrame:
    """item_id, start, length, offset, fingerprint, window: all windows of numbered items."""
    long = items.where(F.col("n") >= span).withColumn("g", _grams(F.col("h"), F.col("n"), k))

    def one(s: Column) -> Column:
        place = _kept(F.col("g"), s, k, span)
        return _window(s, place, span, F.get("g", place))

    long = long.select("item_id", F.explode(F.transform(_range(F.lit(0), F.col("n") - span), one)).alias("w"))
    short = items.where((F.col("n") < span) & (F.col("n") > 0))
    short = short.select("item_id", F.struct(F.lit(0).alias("start"), F.col("n").alias("length"), F.lit(0).alias("offset"), _whole(F.col("h")).alias("fingerprint"), F.array_join("words", " ").alias("window")).alias("w"))
    return long.unionByName(short).select("item_id", "w.*")


def _slots(h: Column, log2: int) -> list[Column]:
    return [F.shiftrightunsigned(h, shift).bitwiseAND((1 << log2) - 1) for shift in (0, 20, 40)[:PROBES]]


def _filter(prints: DataFrame, log2: int) -> DataFrame:
    """One row: the Bloom filter's bits, 64 in a long."""
    places = prints.select(F.explode(F.array(*_slots(F.col("fingerprint"), log2))).alias("s"))
    longs = places.groupBy((F.shiftright("s", 6)).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("bits"))
    whole = prints.sparkSession.range(1 << (log2 - 6)).join(longs, "id", "left")
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bits"))


def _constant(longs: list[int]) -> Column:
    """An array as a constant of the plan (higher-order functions take no subqueries, and a column would be copied into each row)."""
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")


def _passes(bits: Column, h: Column, log2: int) -> Column:
    out = None
    for s in _slots(h, log2):
        one = F.getbit(F.get(bits, F.shiftright(s, 6).cast("int")), s.bitwiseAND(63).cast("int")) == 1
        out = one if out is None else out & one
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and all characters beyond ASCII. A window is `span` consecutive words
    of an item (item_id, text), or a shorter item whole; n_hit counts the words of the document inside occurrences of
    windows, n_items the item_ids with one. Null and empty texts have no words, on either side. Items without an id
    count for hits but are not listed. Repeated rows are each their own; an empty benchmark hits nothing. Texts of any length
    are scanned whole; what they add is at most a row for each of their words.
    """
    items = saved(_numbered(benchmark, "item_id"), "items")
    told = saved(windows(items, k, span).select(F.col("item_id").cast("string").alias("item_id"), *WINDOW).distinct(), "item-windows")
    # Different windows, each with a number of the set of items that hold it; and the items of each set, from one of its windows.
    named = F.col("item_id").isNotNull()
    xor = [F.coalesce(F.bit_xor(F.when(named, F.xxhash64(F.lit(seed), "item_id"))), F.lit(0).cast("long")).alias(f"x{seed}") for seed in (1, 2)]
    known = saved(told.groupBy(*WINDOW).agg(F.struct(F.count("item_id").alias("items"), *xor).alias("held")), "windows")
    shown = known.groupBy("held").agg(F.min(F.struct(*WINDOW)).alias("w")).select("held", "w.*")
    holders = told.where(named).join(shown, WINDOW).select("held", "item_id")
    prints = known.select("fingerprint").distinct()
    count = known.count()
    short = [r.length for r in known.where(F.col("length") < span).select("length").distinct().collect()]  # below span: a bounded list
    log2 = min(MOST_LOG2, max(16, math.ceil(math.log2(BITS_EACH * max(count, 1)))))
    bits = _constant(_filter(prints, log2).first().bits)

    scan = _numbered(docs, "doc_id").withColumn("g", _grams(F.col("h"), F.col("n"), k))
    n = F.col("n")

    def extended(p: Column) -> Column:
        starts = F.filter(_range(F.greatest(F.lit(0), p - (span - k)), F.least(p, n - span)), lambda s: _kept(F.col("g"), s, k, span) == p)
        return F.transform(starts, lambda s: _window(s, p, span, F.get("g", p)))

    found = F.flatten(F.transform(F.filter(_range(F.lit(0), n - k), lambda i: _passes(bits, F.get("g", i), log2)), extended))
    for length in short:
        def gram(i: Column, length: int = length) -> Column:
            return _whole(F.slice("h", i + 1, length))

        found = F.concat(found, F.transform(
            F.filter(_range(F.lit(0), n - length), lambda i: _passes(bits, gram(i), log2)), lambda i: _window(i, i, length, gram(i))))
    scanned = saved(scan.select("row", "doc_id", n.cast("long").alias("n_words"), found.alias("found")), "scanned")

    probes = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    hits = saved(probes.join(F.broadcast(known) if count <= BROADCAST_ROWS else known, WINDOW).select("row", "start", "length", "held"), "hits")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words")),
        lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["words"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("words")))
    marked = hits.groupBy("row").agg(covered["words"].alias("n_hit"))
    listed = hits.select("row", "held").distinct().join(holders, "held").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = scanned.select("row", "doc_id", "n_words").join(marked, "row", "left").join(listed, "row", "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_LOWER = f"translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS need, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
       FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, need, s, array_to_string(w[s:s + need - 1], ' ') AS t
       FROM d, (SELECT DISTINCT need FROM iw), unnest(range(1, len(w) - need + 2)) AS r(s)),
hits AS (SELECT doc_id, item_id, s, need FROM dw JOIN iw USING (need, t)),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + need)) AS r(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
