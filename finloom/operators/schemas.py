"""Large schemas asked for in parts of bounded size, and the parts' results put together.

``fields`` is one row per field of a schema: schema, place, path; a path is dotted, and
``[]`` marks items of an array.  A property is the first name of a path; it stays whole
however many fields lie beneath it, in the order of the schema.

``results`` is one row per part and key of a record: record, part, key, value (JSON).

A null path or key is no field; a field that is given twice counts once; null values are
absent; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_FIELDS = 100


def properties(fields: DataFrame) -> DataFrame:
    """schema, property, place, n_fields: the property itself and all names beneath it, those that only lead to others among them."""
    names = F.split(F.regexp_replace("path", r"\[\]", ""), r"\.")
    leading = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "."))
    each = fields.where("path IS NOT NULL").select("schema", "place", F.get(names, F.lit(0)).alias("property"), F.explode(leading).alias("name"))
    once = each.groupBy("schema", "property", "name").agg(F.min("place").alias("place"))
    return once.groupBy("schema", "property").agg(F.min("place").alias("place"), F.count("*").alias("n_fields"))


def chunks(fields: DataFrame, most: int = MOST_FIELDS) -> DataFrame:
    """schema, property, n_fields, chunk (from 0): a part is closed when the next property would pass ``most``.

    A property of more fields than that is a part of its own; a schema within ``most`` is one part.
    """
    state = "struct<chunk:int,used:bigint,out:array<struct<property:string,n_fields:bigint,chunk:int>>>"
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<property:string,n_fields:bigint,chunk:int>>").alias("out")).cast(state)

    def step(s, p):
        full = (s["used"] > 0) & (s["used"] + p["n_fields"] > most)
        chunk = F.when(full, s["chunk"] + 1).otherwise(s["chunk"])
        used = F.when(full, p["n_fields"]).otherwise(s["used"] + p["n_fields"])
        put = F.struct(p["property"].alias("property"), p["n_fields"].alias("n_fields"), chunk.alias("chunk"))
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.concat(s["out"], F.array(put)).alias("out")).cast(state)

    listed = properties(fields).groupBy("schema").agg(F.sort_array(F.collect_list(F.struct("place", "property", "n_fields"))).alias("p"))
    return listed.select("schema", F.explode(F.aggregate("p", start, step)["out"]).alias("x")).select("schema", "x.*")


def merged(results: DataFrame) -> DataFrame:
    """record, key, value: the keys of a record's first part; of several parts, the values in one list.

    Lists are joined in order of the parts, other values become items; keys without values
    are empty lists.  A record of one part is left as it is.
    """
    known = results.where("key IS NOT NULL")
    parts = results.groupBy("record").agg(F.min("part").alias("first"), F.count_distinct("part").alias("n_parts"))
    items = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.regexp_replace(F.trim("value"), r"^\[\s*|\s*\]$", "")).otherwise(F.col("value"))
    per_key = known.withColumn("items", F.when(items != "", items)).join(parts, "record").groupBy("record", "key").agg(
        F.max(F.col("part") == F.col("first")).alias("asked"), F.first("n_parts").alias("n_parts"), F.max("value").alias("only"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("part", "items")))), lambda x: x["items"]), ",").alias("joined"),
    )
    return per_key.where("asked").select("record", "key", F.when(F.col("n_parts") == 1, F.col("only")).otherwise(F.concat(F.lit("["), "joined", F.lit("]"))).alias("value"))
