"""Search and summaries of nested records of unknown shape, kept as VARIANT.

A level of nesting is a lateral explode of what the level above has left open, so records of any size and shape are rows that Spark
splits as it likes; levels have a fixed bound. A variant's fields stand in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of names that tell who or when.
CHARACTER_KEYS = ("character_id", "match_idx", "center_id", "cluster_id", "person_id", "face_id", "label", "class_id")
FRAME_KEYS = ("frame", "frame_num", "frame_idx", "frame_number", "timestamp")
#: A key that is a number below this may be a frame.
FRAMES = 1_000_000


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY<"), F.lit(False))


def _fields(rows: DataFrame, value: str = "data") -> DataFrame:
    """rows with a row for each field (_pos, _key, _value) or item (_key null) of the variant in column value."""
    spark = rows.sparkSession
    fields = spark.tvf.variant_explode(F.col(value).outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value"))
    return rows.lateralJoin(fields)


def find_keys(records: DataFrame, words: tuple[str, ...], depth: int = 5, first: int = 20, numbers: bool = False) -> DataFrame:
    """id, level, kind, path, value (JSON) of the fields in records (id, data: VARIANT) whose name, in lower case, holds one of words.

    kind `field`: a field of an object; `inner`: one of an object inside its `first` fields; `item`: one of the first item of a list there; `list`: one of the first
    item of a record that is a list. Objects are searched from the record (level 0) on, `depth` levels deep, the `first` fields of each; so a field may be found as inner at one
    level and as field at the next. With numbers, a name that is a whole number below FRAMES is found too, as kind `number`. Null records and plain values have no fields.
    """
    named = lambda key: F.lower(key).rlike("|".join(words))
    below = lambda path, key: F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))
    shown = lambda level, kind, path, value: (F.col("id"), F.lit(level).alias("level"), F.lit(kind).alias("kind"), path.alias("path"), F.to_json(value).alias("value"))
    open_ = records.select("id", F.lit("").alias("path"), "data").where("data IS NOT NULL")
    lists = _fields(open_.where(is_list(F.col("data"))).select("id", F.variant_get("data", "$[0]", "variant").alias("data")).where(is_object(F.col("data"))))
    found = [lists.where(named(F.col("_key"))).select(*shown(0, "list", F.concat(F.lit("[0]."), F.col("_key")), F.col("_value")))]
    open_ = open_.where(is_object(F.col("data")))
    for level in range(depth):
        fields = _fields(open_).where(F.col("_pos") < first).select("id", below(F.col("path"), F.col("_key")).alias("path"), F.col("_key").alias("key"), F.col("_value").alias("data"))
        found.append(fields.where(named(F.col("key"))).select(*shown(level, "field", F.col("path"), F.col("data"))))
        if numbers:
            number = F.expr("try_cast(key AS bigint)")
            found.append(fields.where((number >= 0) & (number < FRAMES)).select(*shown(level, "number", F.col("path"), F.col("data"))))
        open_ = fields.where(is_object(F.col("data"))).select("id", "path", "data")
        inner = _fields(open_).where(named(F.col("_key")))
        found.append(inner.select(*shown(level, "inner", below(F.col("path"), F.col("_key")), F.col("_value"))))
        items = fields.where(is_list(F.col("data"))).select("id", F.concat("path", F.lit("[0]")).alias("path"), F.variant_get("data", "$[0]", "variant").alias("data"))
        items = _fields(items.where(is_object(F.col("data")))).where(named(F.col("_key")))
        found.append(items.select(*shown(level, "item", below(F.col("path"), F.col("_key")), F.col("_value"))))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def structure(records: DataFrame, depth: int = 3, keys: int = 10, items: int = 5) -> DataFrame:
    """path, type, n, records: how often each path is of each type in records (id, data: VARIANT), `depth` levels deep, and in how many records.

    Of an object the first `keys` fields are followed, of a list the first `items` items, under one path ending in []. type is object, list, or the name of a plain type in
    lower case; the record itself has the path `$`.
    """
    plain = F.lower(F.regexp_extract(F.schema_of_variant("data"), "^[A-Z]+", 0))
    kind = F.when(is_object(F.col("data")), "object").when(is_list(F.col("data")), "list").otherwise(plain)
    level = records.select("id", F.lit("$").alias("path"), "data").where("data IS NOT NULL")
    seen = level.select("id", "path", kind.alias("type"))
    for _ in range(depth):
        inner = _fields(level.where(is_object(F.col("data")) | is_list(F.col("data")))).where(F.col("_pos") < F.when(F.col("_key").isNull(), items).otherwise(keys))
        level = inner.select("id", F.when(F.col("_key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.lit("."), F.col("_key"))).alias("path"), F.col("_value").alias("data"))
        seen = seen.unionByName(level.select("id", "path", kind.alias("type")))
    each = seen.groupBy("path", "type", "id").agg(F.count("*").alias("n"))  # combined by record first, so that no count needs all ids of a path
    return each.groupBy("path", "type").agg(F.sum("n").alias("n"), F.count("*").alias("records"))


def merged_schema(records: DataFrame, by: list[str]) -> DataFrame:
    """by, schema: the one type that all records of a group fit into."""
    return records.groupBy(*by).agg(F.schema_of_variant_agg("data").alias("schema"))
