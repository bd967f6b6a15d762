"""Nested facts (attestations, profiles) as rows of path, type and value, and their differences.

Documents are parsed to VARIANT; each level of nesting is one expression that takes objects and arrays apart in their
row. Paths are JSON pointers. Types are those that the text has: 1, 1.5, "1", true and null differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut

#: Levels of nesting that one plan opens; deeper documents are written and read between.
LEVELS = 8


def once(value: Column, use) -> Column:
    """use(value), with the value found once however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def type_of(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null of a VARIANT."""
    name = lambda t: F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BIGINT", "integer").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number")
    return once(F.schema_of_variant(value), name)


def depth(doc: Column) -> Column:
    """How deep objects and arrays of a JSON text are nested; some number for texts that are no JSON."""
    bare = F.regexp_replace(F.regexp_replace(doc, r"(?s)\\.", ""), r'"[^"]*"|[^\[\]{}"]+', "")
    step = lambda x, c: F.struct((x["at"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("at"), F.greatest(x["most"], x["at"] + 1).alias("most"))
    return F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda x: x["most"])


def entry_of(path: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), type_of(v).alias("type"), v.alias("v"))


def opened(values: Column) -> Column:
    """Values (path, type, v), with what is in objects and arrays in their place; empty ones stay."""

    def inside(x):
        name = lambda key: F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        under = lambda key, v: entry_of(F.concat(x["path"], F.lit("/"), key), v)
        fields = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: under(name(e["key"]), e["value"]))
        items = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda v, k: under(k.cast("string"), v))
        parts = F.when(x["type"] == "object", fields).when(x["type"] == "array", items)
        return once(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(x)))

    return F.flatten(F.transform(values, inside))


def in_rows(df: DataFrame, *docs: str) -> DataFrame:
    """Columns of JSON documents replaced by arrays of path, type and value (text): one entry for every value that isn't
    an object or array, and for empty ones; one of type `malformed` where it is no JSON; null for null.

    No row leaves its partition: one pass finds the deepest document, then a row's levels are opened in the row.
    """
    deepest = max([0, *(n for n in df.agg(*(F.max(depth(F.col(c))).alias(f"_{k}") for k, c in enumerate(docs))).first() if n)])
    bad = F.array(F.struct(F.lit("").alias("path"), F.lit("malformed").alias("type"), F.lit(None).cast("variant").alias("v")))
    whole = lambda c: once(F.try_parse_json(c), lambda v: F.when(v.isNull(), bad).otherwise(F.array(entry_of(F.lit(""), v))))
    df = df.withColumns({c: F.when(F.col(c).isNotNull(), whole(c)) for c in docs})
    for k in range(deepest):
        df = df.withColumns({c: opened(F.col(c)) for c in docs})
        if k % LEVELS == LEVELS - 1:
            df = cut(df)
    nested = lambda x: x["type"].isin("object", "array", "null", "malformed")
    text = lambda x: F.when(x["type"] == "string", F.try_variant_get(x["v"], "$", "string")).when(~nested(x), F.to_json(x["v"]))
    return df.withColumns({c: F.transform(c, lambda x: F.struct(x["path"].alias("path"), x["type"].alias("type"), text(x).alias("value"))) for c in docs})


def flat(df: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """keys, path, type and value (text) of every value in JSON documents that isn't an object or array, and of empty ones.
    A document that is no JSON has one row of type `malformed`; null documents have none."""
    # An inner inline would have Spark find the array once more for a filter on its size.
    return in_rows(df.select(*keys, doc), doc).select(*keys, F.inline_outer(doc)).filter("path is not null")


def row_differences(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """differences() of two documents of each row, found in the row: both sides' values in the order of their paths,
    where equal paths are neighbours (a document has no path twice)."""
    rows = in_rows(df.select(*keys, left, right), left, right)
    side = lambda c, n: F.transform(F.coalesce(c, F.array().cast("array<struct<path:string,type:string,value:string>>")), lambda x: F.struct(x["path"].alias("path"), F.lit(n).alias("side"), x["type"].alias("type"), x["value"].alias("value")))
    rows = rows.select(*keys, F.array_sort(F.concat(side(left, 0), side(right, 1))).alias("_v"))

    def met(x, k):
        before, after = F.get("_v", k - 1), F.get("_v", k + 1)
        both = after["path"].eqNullSafe(x["path"])
        a, b = F.when(x["side"] == 0, x), F.when(x["side"] == 1, x).when(both, after)
        why = F.when(b.isNull(), "missing").when(a.isNull(), "unexpected").when(a["type"] != b["type"], "type").when(~a["value"].eqNullSafe(b["value"]), "value")
        why = F.when((x["side"] == 0) | ~before["path"].eqNullSafe(x["path"]), why)
        return F.struct(x["path"].alias("path"), why.alias("difference"), *(y[c].alias(f"{n}_{c}") for n, y in (("left", a), ("right", b)) for c in ("type", "value")))

    found = F.filter(F.transform("_v", met), lambda x: x["difference"].isNotNull())
    return rows.select(*keys, F.inline_outer(found)).filter("difference is not null")


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, difference (missing or unexpected on the right, type, value), and both sides' types and values."""
    a = left.select(*keys, "path", F.col("type").alias("left_type"), F.col("value").alias("left_value"), F.lit(True).alias("_a"))
    b = right.select(*keys, "path", F.col("type").alias("right_type"), F.col("value").alias("right_value"), F.lit(True).alias("_b"))
    why = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("left_type") != F.col("right_type"), "type").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "value")
    return a.join(b, [*keys, "path"], "full_outer").withColumn("difference", why).filter("difference is not null").select(*keys, "path", "difference", "left_type", "left_value", "right_type", "right_value")


def typed(df: DataFrame, doc: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds fields of a JSON document: name -> (path as $.a.b, type). A field that isn't there or of another type is null."""
    v = F.try_parse_json(doc)
    return df.withColumns({name: F.try_variant_get(v, path, kind) for name, (path, kind) in fields.items()})
