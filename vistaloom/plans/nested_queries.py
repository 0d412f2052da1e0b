"""Queries over nested records made of conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaloom.functions import nested as N
from vistaloom.sources.tables import table


def _records(s, d):
    """A record for each conversation: who speaks, its turns as a list, and a nested summary; every tenth is a list itself."""
    turns = table(s, d, "conversations")
    turn = F.struct(F.col("turn").alias("frame_num"), F.length("text").alias("chars"), F.col("role").alias("label"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("turn").alias("last"))
    inner = F.struct(F.struct(F.struct((F.col("conv_id") % 7).alias("cluster_id"), F.lit("x").alias("note")).alias("deep"), F.col("last").alias("class_ids")).alias("faces"), (F.col("conv_id") % 3).alias("match_idx"))
    record = F.to_variant_object(F.struct(F.col("conv_id").alias("Person_ID"), inner.alias("summary"), "turns"))
    return whole.select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 10 == 3, F.to_variant_object("turns")).otherwise(record).alias("data"))


QUERIES = {
    "nested_key_search": lambda s, d: N.find_keys(_records(s, d), N.CHARACTER_KEYS),
    "nested_structure": lambda s, d: N.structure(_records(s, d)),
    "nested_schema": lambda s, d: N.merged_schema(_records(s, d).withColumn("kind", F.when(F.col("id") % 10 == 3, "list").otherwise("record")), ["kind"]),
}

_R = """c AS (SELECT conv_id AS id, max(turn) AS last, arg_min(role, struct_pack(turn := turn, n := length(text), role := role)) AS role, least(count(*), 5) AS items FROM conversations GROUP BY 1),
o AS (SELECT * FROM c WHERE id % 10 <> 3), l AS (SELECT * FROM c WHERE id % 10 = 3)"""
ORACLE = {
    "nested_key_search": f"""WITH {_R}, f AS (SELECT id, '{{"cluster_id":' || id % 7 || ',"note":"x"}}' AS deep FROM o)
SELECT id, 0 AS level, 'list' AS kind, '[0].label' AS path, '"' || role || '"' AS value FROM l
UNION ALL SELECT id, 0, 'field', 'Person_ID', id::VARCHAR FROM o
UNION ALL SELECT id, 0, 'inner', 'summary.match_idx', (id % 3)::VARCHAR FROM o
UNION ALL SELECT id, 0, 'item', 'turns[0].label', '"' || role || '"' FROM o
UNION ALL SELECT id, 1, 'field', 'summary.match_idx', (id % 3)::VARCHAR FROM o
UNION ALL SELECT id, 1, 'inner', 'summary.faces.class_ids', last::VARCHAR FROM o
UNION ALL SELECT id, 2, 'field', 'summary.faces.class_ids', last::VARCHAR FROM o
UNION ALL SELECT id, 2, 'inner', 'summary.faces.deep.cluster_id', (id % 7)::VARCHAR FROM o
UNION ALL SELECT id, 3, 'field', 'summary.faces.deep.cluster_id', (id % 7)::VARCHAR FROM o""",
    "nested_structure": f"""WITH {_R}, p AS (
SELECT '$' AS path, 'object' AS type, 1 AS n FROM o UNION ALL SELECT unnest(['$.Person_ID', '$.summary.match_idx', '$.summary.faces.class_ids']), 'bigint', 1 FROM o
UNION ALL SELECT unnest(['$.summary', '$.summary.faces', '$.summary.faces.deep']), 'object', 1 FROM o UNION ALL SELECT '$.turns', 'list', 1 FROM o UNION ALL SELECT '$.turns[]', 'object', items FROM o
UNION ALL SELECT unnest(['$.turns[].frame_num', '$.turns[].chars']), 'bigint', items FROM o UNION ALL SELECT '$.turns[].label', 'string', items FROM o
UNION ALL SELECT '$', 'list', 1 FROM l UNION ALL SELECT '$[]', 'object', items FROM l UNION ALL SELECT unnest(['$[].frame_num', '$[].chars']), 'bigint', items FROM l UNION ALL SELECT '$[].label', 'string', items FROM l)
SELECT path, type, sum(n)::BIGINT AS n, count(*) AS records FROM p GROUP BY 1, 2""",
    "nested_schema": f"""WITH {_R} SELECT DISTINCT 'list' AS kind, 'ARRAY<OBJECT<chars: BIGINT, frame_num: BIGINT, label: STRING>>' AS schema FROM l UNION ALL
SELECT DISTINCT 'record', 'OBJECT<Person_ID: BIGINT, summary: OBJECT<faces: OBJECT<class_ids: BIGINT, deep: OBJECT<cluster_id: BIGINT, note: STRING>>, match_idx: BIGINT>, turns: ARRAY<OBJECT<chars: BIGINT, frame_num: BIGINT, label: STRING>>>' FROM o""",
}
