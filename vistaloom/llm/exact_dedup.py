"""Exact deduplication with a log-structured merge index of text digests, in DataFrame operations only.

Tasks flush their rows, their memtables, as files sorted by a 64-bit digest, dealt over RUNS runs. A run is summed up to an
entry a digest (identifier that stays, number of rows) and has a filter, a bitmap over its digests. Compaction probes the
filters: an entry that misses those of all other runs goes on as it is, only the others meet by a shuffle and are merged.
What repeats is verified byte by byte. Where one digest turns out to hold different texts, those rows are grouped by the texts themselves.

An index grows by batches (add): each is a run of level 0, and RUNS runs of a level are compacted into one of the next.
New texts are looked up (look_up) only in the runs whose filters they hit, and verified by the bytes of the old texts.

Hot groups: every grouping combines before it shuffles, so a task sends one entry (or two texts) of a digest however
many copies it has read; the joins are plain equi-joins, which adaptive execution splits. Filters have 16 bits a key and a
bound (util.MOST_LOG2) of 8 MB a run; beyond it more entries pass than need to, and the shuffle, not the filter, bears the size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaloom.llm.util import LOWER_AZ, UPPER_AZ, filter_log2, maybe_in, record, saved

#: Runs of one level; so many are compacted into one of the next.
RUNS = 4


def normalised(text: str = "text") -> Column:
    """Null as empty; A-Z to lower case, all else unchanged."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER_AZ, LOWER_AZ)


def flush(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows of docs (doc_id, text) as files sorted by digest: run, digest, doc_id, row (a number of its own for each row), text_sha256."""
    rows = docs.select(
        F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"), digest(normalised()).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"), F.sha2(normalised().cast("binary"), 256).alias("text_sha256"))
    return saved(rows.sortWithinPartitions("digest"), "dedup-run")


def summed(rows: DataFrame, largest: bool = False) -> DataFrame:
    """An entry for each digest of each run: run, digest, keep (doc_id, row) of the smallest identifier, or the largest, and the number of rows."""
    pick = F.max if largest else F.min
    return saved(rows.groupBy("run", "digest").agg(pick(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("size")).sortWithinPartitions("digest"), "dedup-entries")


def _marks(entries: DataFrame, log2: int) -> DataFrame:
    """The runs' filters: block, a map from run to its bitmap of the block (4 KB)."""
    slot = F.shiftrightunsigned("digest", 64 - log2)
    bitmaps = entries.groupBy(F.shiftrightunsigned(slot, 15).alias("_block"), F.col("run").alias("_run")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position((shiftrightunsigned(digest, {64 - log2}) & 32767) + 1))").alias("_bits"))
    return bitmaps.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_run", "_bits"))).alias("_marks"))


def probed(keyed: DataFrame, entries: DataFrame) -> DataFrame:
    """keyed (digest and more) with `runs`: the runs of entries whose filters its digest hits. What is broadcast has a bound."""
    most = entries.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    log2 = filter_log2(most)
    place = F.shiftrightunsigned("digest", 64 - log2).bitwiseAND(32767)
    joined = keyed.withColumn("_block", F.shiftrightunsigned(F.shiftrightunsigned("digest", 64 - log2), 15)).join(F.broadcast(_marks(entries, log2)), "_block", "left")

    def hit(_, marks: Column) -> Column:
        byte = F.conv(F.hex(F.substring(marks, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (place % 8).cast("int")) == 1

    runs = F.coalesce(F.map_keys(F.map_filter("_marks", hit)), F.array().cast("array<int>"))
    return joined.withColumn("runs", runs).drop("_block", "_marks")


def compact(entries: DataFrame, largest: bool = False) -> DataFrame:
    """All runs of entries as one: digest, keep, size, an entry for each digest, sorted in each file.

    Only entries whose digest hits the filter of another run move.
    """
    pick = F.max if largest else F.min
    met = saved(probed(entries, entries).select("digest", "keep", "size", (F.size("runs") > 1).alias("meets")), "dedup-probed")
    merged = met.where("meets").groupBy("digest").agg(pick("keep").alias("keep"), F.sum("size").alias("size"))
    return saved(met.where("NOT meets").select("digest", "keep", "size").unionByName(merged).sortWithinPartitions("digest"), "dedup-compacted")


def add(index: DataFrame | None, docs: DataFrame, largest: bool = False, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """An index (level, run, digest, keep, size) with docs (doc_id, text) as one more run of level 0; full levels are compacted into the next."""
    batch = summed(flush(docs, digest).withColumn("run", F.lit(0)), largest).select(F.lit(0).alias("level"), "run", "digest", "keep", "size")
    if index is None:
        return batch
    runs = [(r.level, r.run) for r in index.select("level", "run").distinct().collect()]  # RUNS - 1 for each level at most
    number = max((run for _, run in runs), default=-1) + 1
    index = index.unionByName(batch.withColumn("run", F.lit(number)))
    runs.append((0, number))
    level = 0
    while sum(own == level for own, _ in runs) >= RUNS:
        number += 1
        full = compact(index.where(F.col("level") == level).select("run", "digest", "keep", "size"), largest)
        index = index.where(F.col("level") != level).unionByName(full.select(F.lit(level + 1).alias("level"), F.lit(number).alias("run"), "digest", "keep", "size"))
        runs = [x for x in runs if x[0] != level] + [(level + 1, number)]
        level += 1
    return index


def look_up(index: DataFrame, known: DataFrame, docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64, largest: bool = False) -> DataFrame:
    """doc_id, text_sha256, keep_id of the rows of docs (doc_id, text) whose text is in the index; known (doc_id, text) are the texts that it was made of.

    Digests go only to the runs whose filters they hit. A hit counts if a known text of that digest has the same bytes, whichever of several texts that share the digest a run
    keeps; so no text is lost. keep_id is the smallest identifier of the known rows with that text, or the `largest`; a null one is smaller than all others.
    """
    pick = F.max if largest else F.min
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("bytes"), digest(normalised()).alias("digest"), F.monotonically_increasing_id().alias("row"))
    keyed = saved(keyed, "dedup-asked")
    asked = probed(keyed.select("digest").distinct(), index).select("digest", F.explode("runs").alias("run"))
    hits = saved(asked.join(index.select("run", "digest"), ["run", "digest"]).select("digest").distinct(), "dedup-hits")
    held = known.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("bytes"), digest(normalised()).alias("digest")).join(hits, "digest", "left_semi")
    held = held.groupBy("digest", "bytes").agg(pick(F.struct("doc_id")).alias("keep"))
    return keyed.join(held, ["digest", "bytes"]).select("doc_id", F.sha2(F.col("bytes").cast("binary"), 256).alias("text_sha256"), F.col("keep.doc_id").alias("keep_id"))


def _hits(keyed: DataFrame, compacted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their digests, parted by the filter of repeated digests: (may be repeated, surely not)."""
    return maybe_in(keyed, "digest", compacted.where("size > 1"), "digest")


def mark_duplicates(docs: DataFrame, largest: bool = False, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs (doc_id, text; further columns are left out).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    smallest doc_id stays (with `largest`, the largest); of rows that also share it, exactly one does. A null doc_id is
    smaller than all others. An empty table gives an empty result.
    """
    pairs = docs.select("doc_id", "text")
    runs = flush(pairs, digest)
    compacted = compact(summed(runs, largest), largest)
    hits, _ = _hits(pairs.select(digest(normalised()).alias("digest"), normalised().alias("bytes")), compacted)
    sides = hits.groupBy("digest").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
    clashes = saved(sides.where("lo <> hi").select("digest"), "dedup-clashes")
    found = runs.join(compacted, "digest")
    columns = ["doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"]
    if clashes.isEmpty():
        return found.select(*columns)
    own = pairs.withColumn("digest", digest(normalised())).join(clashes, "digest", "left_semi")
    own = saved(own.select("doc_id", normalised().alias("bytes"), F.monotonically_increasing_id().alias("row")), "dedup-clashing")
    pick = F.max if largest else F.min
    groups = own.groupBy("bytes").agg(pick(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "row")).alias("keep"), F.count("*").alias("size"))
    again = own.join(groups, "bytes").withColumn("text_sha256", F.sha2(F.col("bytes").cast("binary"), 256)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return found.join(clashes, "digest", "left_anti").select(*columns).unionByName(again.select(*columns))


def drop_duplicates(docs: DataFrame, largest: bool = False, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows of docs that stay (as in mark_duplicates), all columns unchanged.

    Only rows that hit the filter move; they are grouped by their bytes, so a clash of digests can't merge two texts.
    """
    compacted = compact(summed(flush(docs.select("doc_id", "text"), digest), largest), largest)
    hits, rest = _hits(docs.select(record(docs), digest(normalised()).alias("digest"), normalised().alias("bytes")), compacted)
    pick = F.max_by if largest else F.min_by
    one = hits.groupBy("bytes").agg(pick("record", F.struct("record.doc_id")).alias("record"))
    return rest.select("record.*").unionByName(one.select("record.*"))


ORACLE = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
