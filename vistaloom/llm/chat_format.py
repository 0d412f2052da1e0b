"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once, depth first.

A node is a turn after a given history; its id is a digest of the chain of turns up to it. All conversations with
the same first turn make one tree, whose nodes, in depth-first order, are one sequence of tokens. A node carries its tokens, its place in
that sequence, the position of its first token (the tokens of its ancestors come before it, siblings don't count) and
the intervals of the sequence that its tokens attend to besides their own node's past: its ancestors.

Nodes without a fork between them are one run, which stands in one piece. Depth-first order is the order of the paths of runs, and of
turns in a run, so a long conversation costs no path for each of its turns. Nodes are sorted over all trees by range partitions, summed up
in each partition and shifted by what lies ahead, so a tree that a third of all conversations share is no one's task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaloom.llm.tokens import BytePairs, default_path
from vistaloom.llm.util import saved

#: What stands before and after a text, by role; other roles are named in front of their text.
TURNS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<s><<SYS>>\n", "\n<</SYS>>")}
OTHER = ("<s>[ROLE] ", " [/ROLE]")
LEARNT = "assistant"
#: A control string of the template: an opening, any number of backslashes, the rest. One backslash more or less escapes it or takes that back.
CONTROL = r"(<<|<|\[)(\\*)(/?(?:s>|SYS>>|INST\]|ROLE\]))"
ESCAPED = r"(<<|<|\[)\\(\\*)(/?(?:s>|SYS>>|INST\]|ROLE\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, leaf (the digest of the whole), step (0, 1, ..), node_id and parent_id (digests of the chains so far), role, text: turns in order; ties by role and text."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chain = F.aggregate(
        "turns", F.array().cast("array<string>"),
        lambda path, t: F.concat(path, F.array(F.substring(F.sha2(F.concat_ws("\n", F.coalesce(F.element_at(path, F.when(F.size(path) > 0, -1)), F.lit("")), F.length(t["role"]).cast("string"), t["role"], t["text"]).cast("binary"), 256), 1, 32))))
    above = F.concat(F.array(F.lit(None).cast("string")), F.slice("chain", 1, F.size("chain") - 1))
    zipped = F.arrays_zip(F.col("turns").alias("t"), F.col("chain").alias("node_id"), above.alias("parent_id"))
    stepped = whole.withColumn("chain", chain).select("conv_id", F.element_at("chain", -1).alias("leaf"), zipped.alias("z")).select("conv_id", "leaf", F.posexplode("z").alias("step", "z"))
    return stepped.select("conv_id", "leaf", "step", "z.node_id", "z.parent_id", "z.t.role", "z.t.text")


def _runs(turns: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, paths). A run is a stretch of nodes without a fork: its head is a root or one of several children.

    places: node_id, head_id (its run), step. paths: head_id, rank (runs in depth-first order), path (heads from the root's to its own).
    A node is placed by one of its conversations only, so a path is made once a run: all of them together hold no more than
    twice as many heads as there are turns, since every fork on a path belongs to another conversation that is as long.
    """
    forks = nodes.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("parent_id").alias("node_id"), F.lit(True).alias("forked"))
    flagged = nodes.select("node_id", F.col("leaf").alias("placed_by")).join(forks, "node_id", "left").withColumn("forked", F.coalesce("forked", F.lit(False)))
    in_order = Window.partitionBy("leaf").orderBy("step")
    chains = turns.select("leaf", "step", "node_id").distinct().join(flagged, "node_id").withColumn("is_head", F.coalesce(F.lag("forked").over(in_order), F.lit(True)))
    own_head = F.last(F.when(F.col("is_head"), F.col("node_id")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    chains = saved(chains.withColumn("head_id", own_head).drop("forked"), "chains")
    places = chains.where(F.col("leaf") == F.col("placed_by")).select("node_id", "head_id", "step")
    heads = chains.where("is_head").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("step", "node_id", "placed_by"))).alias("heads"))
    own = F.filter("heads", lambda x: x["placed_by"] == F.col("leaf"))
    # A conversation places what it doesn't share with those before it: the last ones of its heads.
    own = F.transform(own, lambda x, i: F.struct(x["node_id"].alias("head_id"), F.transform(F.filter("heads", lambda y: y["step"] <= x["step"]), lambda y: y["node_id"]).alias("path")))
    paths = heads.select(F.explode(own).alias("x")).select("x.*")
    ranked = paths.repartitionByRange("path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id())
    return places, saved(ranked, "paths")


def _format(nodes: DataFrame) -> DataFrame:
    """Adds head, body and tail of each node's text."""
    head, tail = F.concat(F.lit(OTHER[0]), escape(F.col("role")), F.lit("\n")), F.lit(OTHER[1])
    for role, (a, b) in TURNS.items():
        head, tail = F.when(F.col("role") == role, a).otherwise(head), F.when(F.col("role") == role, b).otherwise(tail)
    return nodes.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("tail", tail)


_INTERVALS = "array<struct<start:bigint,end:bigint>>"
_ADDED = [("tokens", pa.list_(pa.int32())), ("body_tokens", pa.list_(pa.int32())), ("part", pa.int32()), ("before", pa.int64())]


def _encoded(shared):
    """Adds to sorted nodes: tokens, the range of the body's tokens, the partition, and the tokens of it that come before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = BytePairs(*shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            tokens, ranges, ahead = [], [], []
            for head, body, tail in zip(*(batch.column(c).to_pylist() for c in ("head", "body", "tail"))):
                h, b, t = (np.frombuffer(encoder.encode(x), "<i4") for x in (head, body, tail))
                tokens.append(np.concatenate([h, b, t]))
                ranges.append([len(h), len(h) + len(b)])
                ahead.append(before)
                before += len(tokens[-1])
            values = (tokens, ranges, [part] * len(tokens), ahead)
            added = [pa.array(v, t) for v, (_, t) in zip(values, _ADDED)]
            yield pa.record_batch([*batch.columns, *added], [*batch.schema.names, *(n for n, _ in _ADDED)])

    return run


def prefix_trees(conversations: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of conversations (conv_id, turn, role, text, a row for each turn; further columns are left out).

    nodes: tree_id, node_id, parent_id (null for a root), depth, role, text (formatted, control strings inside escaped),
    body_start and body_length (code points of text), tokens, body_tokens (from, to), learn (loss on the body: assistant turns),
    start and n_tokens (the node's place in its tree's sequence), position (of its first token), ancestors (array of
    (start, end) in the sequence, root first; ancestors without a fork between them are one interval). members: conv_id, step, node_id.

    A null role or text counts as empty, a null turn comes first; rows of a turn that occurs twice follow by role and text. Rows
    with a null conv_id are one conversation. Equal conversations share all nodes. A conversation is sorted as one array,
    and may have many turns: what is kept of a node doesn't grow with its depth but with the forks above it. An empty table gives empty results.
    """
    spark = conversations.sparkSession
    files = (vocabulary or default_path("byte_bpe_50k.json"), ranks or default_path("byte_bpe_50k.tiktoken"))
    shared = spark.sparkContext.broadcast(tuple(Path(x).read_text(encoding="utf-8") for x in files))
    turns = saved(_turns(conversations), "turns")
    members = turns.select("conv_id", "step", "node_id")
    distinct = saved(turns.groupBy("node_id").agg(F.min("leaf").alias("leaf"), *(F.first(c).alias(c) for c in ("parent_id", "role", "text"))), "distinct")
    places, paths = _runs(turns, distinct)
    ranked = places.join(paths.select("head_id", "rank"), "head_id").join(distinct.drop("leaf"), "node_id")
    ordered = _format(ranked).repartitionByRange("rank", "step").sortWithinPartitions("rank", "step")
    schema = T.StructType([*ordered.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("body_tokens", T.ArrayType(T.IntegerType())), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])
    placed = saved(ordered.mapInArrow(_encoded(shared), schema), "nodes").withColumn("n_tokens", F.size("tokens").cast("long"))
    ahead = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition
    ahead = ahead.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = placed.join(ahead, "part").withColumn("at", F.col("ahead") + F.col("before"))
    extents = saved(placed.groupBy("head_id").agg(F.min("at").alias("from"), F.max(F.col("at") + F.col("n_tokens")).alias("to")), "extents")
    above = paths.select("head_id", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("level", "ancestor"))
    lists = above.join(extents.withColumnRenamed("head_id", "ancestor"), "ancestor").groupBy("head_id").agg(F.array_sort(F.collect_list(F.struct("level", "from", "to"))).alias("found"))
    runs = extents.join(paths.select("head_id", F.element_at("path", 1).alias("tree_id")), "head_id").join(lists, "head_id", "left")
    root = F.coalesce(F.element_at("found", F.when(F.size("found") > 0, 1))["from"], F.col("from"))
    shifted = F.transform("found", lambda x: F.struct((x["from"] - F.col("root")).alias("start"), (x["to"] - F.col("root")).alias("end")))
    runs = runs.withColumn("root", root).select("head_id", "tree_id", "root", (F.col("from") - F.col("root")).alias("from"), F.coalesce(shifted, F.array().cast(_INTERVALS)).alias("ancestors"))
    out = placed.join(runs, "head_id").withColumn("start", F.col("at") - F.col("root"))
    own = F.when(F.col("start") > F.col("from"), F.array(F.struct(F.col("from").alias("start"), F.col("start").alias("end")))).otherwise(F.array().cast(_INTERVALS))
    ancestors = F.concat("ancestors", own)
    return out.select(
        "tree_id", "node_id", "parent_id", F.col("step").alias("depth"), "role",
        F.concat("head", "body", "tail").alias("text"), F.length("head").alias("body_start"), F.length("body").alias("body_length"), "tokens", "body_tokens",
        (F.col("role") == LEARNT).alias("learn"), "start", "n_tokens", F.aggregate(ancestors, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("position"), ancestors.alias("ancestors")), members


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Each conversation's digests, from the formatted text and the loss mask of its nodes."""
    body = unescape(F.expr("substring(text, body_start + 1, body_length)"))
    turns = members.join(nodes.select("node_id", "role", "learn", F.length("text").cast("long").alias("chars"), body.alias("body")), "node_id")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("step", "role", "body", "learn", "chars"))).alias("t"))
    learnt = F.array_join(F.transform(F.filter("t", lambda x: x["learn"]), lambda x: x["body"]), "")
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["body"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("formatted_chars"))


_HEADS = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in TURNS.items())
_ESCAPE = rf"regexp_replace({{}}, '{CONTROL}', '\1\\\2\3', 'g')"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNT}'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNT}'), '')) AS loss_sha256,
       sum(length({_ESCAPE.format("text")}) + CASE role {_HEADS} ELSE {len(OTHER[0]) + len(OTHER[1]) + 1} + length({_ESCAPE.format("role")}) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
