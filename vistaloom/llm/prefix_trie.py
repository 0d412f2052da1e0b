"""Prefix trie of conversations: every distinct sequence of first turns is a node, from the textless root down.

A prefix is named by its depth and 128 bits: position-bound hashes of its turns, summed up along the conversation by a scan, so a long
conversation is spread over tasks. The least conversation of each prefix that several share (prefix-digest minima) owns that node.
If a conversation owns the node at one depth, it owns all deeper ones; so its first owned depth is found by binary search, for all
conversations at once: a round joins what each one probes next with the minima. Every depth is probed in one round only, which follows
from the length, so prefixes are stored by round and each is read once. The last probe that failed names the parent.

The depths that a conversation owns are a chain. Chains hang on each other where they begin; a conversation that owns nothing hangs on the
chain that its last turn belongs to. Sums over all that hangs below a chain go up by doubling: after k rounds each has what is less than 2**k
steps below. Inside a chain they are running sums from its end, again by a scan.

Hot keys: minima combine before the shuffle; a prefix or chain that more than a thousandth of all rows ask for is looked up by a
broadcast, of which there are less than a thousand, the others by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaloom.llm.util import saved
from vistaloom.operators.scan import ordered, running_sums
from vistaloom.storage import written

#: A key is hot if more than this part of all rows ask for it.
HOT = 1000


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, ..), digest (128 bits of role and text), bytes (UTF-8 length of the text), in the order of turns (null first; ties by digest)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return saved(running_sums(turns, ["conv_id"], ["turn", "digest"], {"pos": F.lit(1)}).select("conv_id", "pos", "digest", "bytes"), "trie-turns")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def rebuilt(turns: DataFrame, by: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations with their length) where conversation c begins with the first h turns of c - c % by, h being crc32(c) % most, and
    goes on with its own after its first h. That other conversation may be shorter, or not there."""
    own = saved(lengths(turns), "trie-lengths")
    convs = own.select("conv_id", F.col("length").alias("n"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % by).alias("base"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("length").alias("there")), "base", "left")
    convs = convs.withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    convs = saved(convs.select("conv_id", "h", "base", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    kept = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "digest", "bytes")
    first = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    lent = first.join(convs.select("base", "conv_id", "h"), "base").where("pos <= h").select("conv_id", "pos", "digest", "bytes")
    return kept.unionByName(lent), convs.select("conv_id", "length")


def _rounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the round in which a binary search over 0..length + 1 probes a depth."""
    for batch in batches:
        depth, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("depth", "length"))
        low, high = np.zeros_like(depth), length + 1
        out, open_ = np.zeros(len(depth), np.int32), np.ones(len(depth), bool)
        while open_.any():
            middle = (low + high) // 2
            open_ &= middle != depth
            out += open_
            before = depth < middle
            high, low = np.where(open_ & before, middle, high), np.where(open_ & ~before, middle + 1, low)
        yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "round"])


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth (0 to length), length, lo, hi (the prefix's digest), ahead (bytes of its texts), bytes (of its last one), round."""
    steps = turns.select("conv_id", F.col("pos").cast("long").alias("depth"), F.xxhash64("pos", "digest").alias("x"), F.xxhash64(F.lit(1), "digest", "pos").alias("y"), "bytes")
    roots = convs.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y", "bytes")))
    summed = running_sums(steps.unionByName(roots), ["conv_id"], ["depth"], {"lo": F.col("x"), "hi": F.col("y"), "ahead": F.col("bytes")})
    whole = summed.join(convs.select("conv_id", "length"), "conv_id").select("conv_id", "depth", F.col("length").cast("long").alias("length"), "lo", "hi", "ahead", "bytes")
    return written(whole.mapInArrow(_rounds, T.StructType([*whole.schema.fields, T.StructField("round", T.IntegerType())])), "trie-prefixes", by=["round"])


def _looked_up(rows: DataFrame, keys: list[str], found: DataFrame, value: str, asked: str, total: int) -> DataFrame:
    """rows with `value` of found (keys, value, asked: how many rows of all `total` ask for it at most), null where there is none."""
    hot = found.where(F.col(asked) * HOT > total).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_hot"))
    first = rows.join(F.broadcast(hot), [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    # Rows that are served already are spread by a key that no other row has.
    apart = F.col("_hot").isNotNull()
    dealt = first.withColumn("_apart", F.when(apart, F.xxhash64("conv_id")).otherwise(0)).withColumn("_some", F.when(apart, 1).otherwise(0))
    cold = found.where(F.col(asked) * HOT <= total).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_cold"))
    on = [dealt[k] == F.col(f"_{k}") for k in keys] + [F.col("_apart") == F.lit(0).cast("long") + F.col("_zero"), F.col("_some") == F.col("_zero")]
    out = dealt.join(cold.withColumn("_zero", F.lit(0).cast("long")), on, "left")
    return out.select(*rows.columns, F.coalesce("_hot", "_cold").alias(value))


def _first_owned(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, length, first (owned depth; length + 1 without any), above (the owner of the node before it), base (bytes of the texts before it)."""
    total = prefixes.count()
    shared = prefixes.groupBy("depth", "lo", "hi").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    shared = saved(shared, "trie-minima")
    state = convs.select("conv_id", F.col("length").cast("long").alias("length"), F.lit(0).cast("long").alias("low"), (F.col("length") + 1).cast("long").alias("high"), F.lit(None).cast("long").alias("above"), F.lit(0).cast("long").alias("base"))
    longest = convs.agg(F.max("length")).first()[0]
    done = []
    for n in range((longest + 1).bit_length() if longest is not None else 0):
        probes = state.withColumn("depth", F.expr("(low + high) div 2")).join(prefixes.where(F.col("round") == n).select("conv_id", "depth", "lo", "hi", "ahead"), ["conv_id", "depth"])
        known = _looked_up(probes, ["depth", "lo", "hi"], shared, "owner", "n", total)
        owned = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        state = saved(known.select(
            "conv_id", "length", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high"),
            F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above"), F.when(owned, F.col("base")).otherwise(F.col("ahead")).alias("base")), "trie-search")
        done.append(state.where("low = high"))
        state = state.where("low < high")
    out = state.where("low = high")
    for part in done:
        out = out.unionByName(part)
    return saved(out.select("conv_id", "length", F.col("low").alias("first"), "above", "base"), "trie-chains")


def _sums_below(chains: DataFrame) -> DataFrame:
    """chains with n, bases, leaves: the number, the sum of base and the number of leaves of a chain and all that hangs below it."""
    total = chains.count()
    hangs = chains.where("first <= length AND above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("length")).agg(F.count("*").alias("kids"))
    leaf = (F.col("first") <= F.col("length")) & F.col("kids").isNull()
    now = chains.join(hangs, ["conv_id", "length"], "left").select(
        "conv_id", "length", "first", "above", "base", leaf.alias("leaf"), F.lit(1).cast("long").alias("n"), F.col("base").alias("bases"), leaf.cast("long").alias("leaves"), F.col("above").alias("far"))
    now = saved(now, "trie-sums")
    while not now.where("far IS NOT NULL").isEmpty():
        asking = now.where("far IS NOT NULL")
        up = asking.groupBy(F.col("far").alias("at")).agg(F.count("*").alias("asked"), *(F.sum(c).alias(f"more_{c}") for c in ("n", "bases", "leaves")))
        up = saved(up.join(now.select(F.col("conv_id").alias("at"), F.col("far").alias("farther")), "at"), "trie-up")
        jumped = _looked_up(asking.select("conv_id", F.col("far").alias("at")), ["at"], up, "farther", "asked", total).select("conv_id", F.col("farther").alias("next"))
        grown = now.join(up.select(F.col("at").alias("conv_id"), "more_n", "more_bases", "more_leaves"), "conv_id", "left").join(jumped, "conv_id", "left")
        now = saved(grown.select("conv_id", "length", "first", "above", "base", "leaf", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("n", "bases", "leaves")), F.col("next").alias("far")), "trie-sums")
    return now.drop("far")


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of one node's identifiers, in order, as text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node, depth, ids = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "id"))
        cuts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1]), True])
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, cuts[1:])]
        at = cuts[:-1]
        yield pa.record_batch([pa.array(node[at]), pa.array(depth[at]), pa.array(ids[at]), pa.array(texts)], ["conv_id", "depth", "id", "text"])


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's stretches, which come in order."""
    node, state = None, None
    for batch in batches:
        out = []
        for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "text"))):
            if (conv, depth) == node:
                state.update(b"," + text.encode())
                continue
            if node is not None:
                out.append((*node, state.hexdigest()))
            node, state = (conv, depth), hashlib.sha256(text.encode())
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out)], ["conv_id", "depth", "ends"])
    if node is not None:
        yield pa.record_batch([pa.array([x]) for x in (*node, state.hexdigest())], ["conv_id", "depth", "ends"])


def _ends(chains: DataFrame) -> DataFrame:
    """conv_id, depth, ends of the nodes that end several conversations: the hash of their identifiers, ascending, comma-joined."""
    copies = chains.where("first > length").select(F.col("above").alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("id"))
    own = chains.where("first <= length").select("conv_id", F.col("length").alias("depth"), F.col("conv_id").alias("id")).join(copies.select("conv_id", "depth").distinct(), ["conv_id", "depth"])
    stretches = ordered(copies.unionByName(own), ["conv_id", "depth"], ["id"]).mapInArrow(_joined, "conv_id long, depth long, id long, text string")
    return stretches.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "id").mapInArrow(_digested, "conv_id long, depth long, ends string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations convs (conv_id, length, each once) with turns (conv_id, pos 1..length, digest, bytes).

    A node is named by its smallest member and its depth: conv_id, depth, parent_conv_id (null for the root), n_convs (members),
    n_children, n_leaves (childless nodes below, itself included), saved_tokens (over the nodes below and itself, bytes of the last
    text times members but one), ends_sha256 (of the identifiers, ascending, comma-joined, of the members that end there).
    Without conversations there are no nodes.
    """
    prefixes = _prefixes(turns, convs)
    chains = saved(_sums_below(_first_owned(prefixes, convs)), "trie-chains-summed")
    hung = chains.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(
        F.sum("n").alias("more_n"), F.sum("bases").alias("more_bases"), F.sum("leaves").alias("more_leaves"), F.count_if(F.expr("first <= length")).alias("kids"))
    owners = chains.where("first <= length").select("conv_id", "first", "above", F.col("leaf").cast("long").alias("leaf"))
    nodes = prefixes.select("conv_id", "depth", "length", (F.col("ahead") - F.col("bytes")).alias("before")).join(owners, "conv_id").where("depth >= first")
    nodes = nodes.join(hung, ["conv_id", "depth"], "left").fillna(0, ["more_n", "more_bases", "more_leaves", "kids"])
    summed = running_sums(nodes, ["conv_id"], [F.desc("depth")], {"others": F.col("more_n"), "bases": F.col("more_bases"), "leaves": F.col("more_leaves")})
    summed = summed.join(_ends(chains), ["conv_id", "depth"], "left")
    alone = F.sha2(F.when(F.col("depth") == F.col("length"), F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256)
    return summed.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), (F.col("others") + 1).alias("n_convs"),
        (F.col("kids") + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"), (F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("bases") - F.col("others") * F.col("before")).alias("saved_tokens"), F.coalesce("ends", alone).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie (see there) of conversations (conv_id, turn, role, text, a row for each turn; further columns are left out) as they are.

    Turns come in order, null first; those of one number by a digest of role and text. A null role or text counts as empty. Rows with a null conv_id belong
    to no conversation. Repeated rows are turns of their own; equal conversations share all nodes. Texts of any length count whole.
    """
    turns = numbered_turns(conversations)
    return trie(turns, saved(lengths(turns), "trie-convs"))


def rebuilt_trie(conversations: DataFrame, by: int = 5, most: int = 9) -> DataFrame:
    """The trie of the conversations that rebuilt() makes of those given; nulls, ties and repeats as in prefix_trie."""
    turns, convs = rebuilt(numbered_turns(conversations), by, most)
    return trie(turns, convs)


_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x) + 1), lambda i: ord(substr(x, i, 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295)"
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p, k, bytes FROM
  (SELECT *, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
l AS (SELECT c, max(p) AS n, c - c % 5 AS b FROM t GROUP BY 1), h AS (SELECT c, n, b, {_CRC} % 9 AS h FROM (SELECT *, c::VARCHAR AS x FROM l)),
g AS (SELECT h.*, least(h.h, coalesce(o.n, 0)) AS lent FROM h LEFT JOIN l o ON o.c = h.b),
re AS (SELECT c, p - h + lent AS d, k, bytes FROM t JOIN g USING (c) WHERE p > h UNION ALL SELECT g.c, p, k, bytes FROM g JOIN t ON t.c = g.b AND p <= h),
r AS (SELECT c, d, sha256(array_to_string(list(k) OVER (PARTITION BY c ORDER BY d), '')) AS key, bytes FROM re UNION ALL SELECT c, 0, '', 0 FROM g),
x AS (SELECT key, d, min(c) AS c, count(*) AS n, max(bytes) AS bytes FROM r GROUP BY 1, 2),
up AS (SELECT x.*, r.key AS above FROM x LEFT JOIN r ON r.c = x.c AND r.d = x.d - 1),
kids AS (SELECT above AS key, count(*) AS n FROM up WHERE above IS NOT NULL GROUP BY 1),
leaves AS (SELECT r.key, count(*) AS n FROM x JOIN r USING (c) WHERE x.key NOT IN (SELECT key FROM kids) AND r.d <= x.d GROUP BY 1),
spare AS (SELECT r.key, sum((n - 1) * x.bytes) AS s FROM x JOIN r USING (c) WHERE r.d <= x.d GROUP BY 1),
ends AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS s FROM (SELECT c, arg_max(key, d) AS key FROM r GROUP BY 1) GROUP BY 1)
SELECT up.c AS conv_id, up.d AS depth, o.c AS parent_conv_id, up.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves.n AS n_leaves, spare.s::BIGINT AS saved_tokens, sha256(coalesce(ends.s, '')) AS ends_sha256
FROM up LEFT JOIN x o ON o.key = up.above LEFT JOIN kids ON kids.key = up.key LEFT JOIN leaves ON leaves.key = up.key LEFT JOIN spare ON spare.key = up.key LEFT JOIN ends ON ends.key = up.key
"""
