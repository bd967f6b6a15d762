"""Difference and projection queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import diff as D
from plumbline.plans.rules import NODES, nodes
from plumbline.sources import load


def tree_diff(spark, sf):
    """Nodes against a copy with every 97th part dropped, every 101st moved, every 89th changed."""
    a = nodes(spark, sf).select("l_orderkey", "ordinal", "l_partkey", "l_quantity", "l_returnflag")
    b = a.filter("l_partkey % 97 <> 0").withColumns({"ordinal": F.when(F.col("l_partkey") % 101 == 0, F.col("ordinal") + 100).otherwise(F.col("ordinal")), "l_quantity": F.when(F.col("l_partkey") % 89 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")), "l_returnflag": F.when(F.col("l_partkey") % 83 == 0, F.lit(None)).otherwise(F.col("l_returnflag"))})
    return D.tree_diff(a, b, ["l_orderkey", "ordinal"], ["l_quantity", "l_returnflag"])


TREE_DIFF = f"""
with a as {NODES},
b as (select l_orderkey, case when l_partkey % 101 = 0 then ordinal + 100 else ordinal end as ordinal, case when l_partkey % 89 = 0 then l_quantity + 1 else l_quantity end as q,
 case when l_partkey % 83 = 0 then null else l_returnflag end as f from a where l_partkey % 97 <> 0)
select l_orderkey, ordinal, 'missing' as change_type, '' as changed_fields from a where (l_orderkey, ordinal) not in (select (l_orderkey, ordinal) from b)
union all select l_orderkey, ordinal, 'unexpected', '' from b where (l_orderkey, ordinal) not in (select (l_orderkey, ordinal) from a)
union all select a.l_orderkey, a.ordinal, 'changed', concat_ws(',', case when l_quantity is distinct from q then 'l_quantity' end, case when l_returnflag is distinct from f then 'l_returnflag' end)
from a join b on a.l_orderkey = b.l_orderkey and a.ordinal = b.ordinal where l_quantity is distinct from q or l_returnflag is distinct from f"""


def positional_diff(spark, sf):
    """Customers' F orders against their other orders by position; the tails are unmatched."""
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    side = lambda finished: o.filter((F.col("o_orderstatus") == "F") == finished).withColumn("position", F.row_number().over(w)).select("o_custkey", "position", "o_orderpriority")
    return D.tree_diff(side(True), side(False), ["o_custkey", "position"], ["o_orderpriority"])


POSITIONAL_DIFF = """
with o as (select *, row_number() over (partition by o_custkey, o_orderstatus = 'F' order by o_orderdate, o_orderkey)::int as position from orders),
f as (select * from o where o_orderstatus = 'F'), g as (select * from o where o_orderstatus <> 'F')
select coalesce(f.o_custkey, g.o_custkey) as o_custkey, coalesce(f.position, g.position) as position,
 case when g.o_orderkey is null then 'missing' when f.o_orderkey is null then 'unexpected' else 'changed' end as change_type,
 case when g.o_orderkey is null or f.o_orderkey is null then '' else 'o_orderpriority' end as changed_fields
from f full join g on f.o_custkey = g.o_custkey and f.position = g.position where f.o_orderpriority is distinct from g.o_orderpriority"""


def missing_unexpected(spark, sf):
    """Orders without nodes, and nodes of orders that the second list lacks (every 50th is dropped)."""
    o = load(spark, sf, "orders").filter("o_orderkey % 50 <> 7").select(F.col("o_orderkey").alias("key"))
    return D.unmatched(o, load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


MISSING = """
with o as (select o_orderkey as key from orders where o_orderkey % 50 <> 7), l as (select distinct l_orderkey as key from lineitem)
select key, 'missing' as side from o where key not in (select key from l) union all select key, 'unexpected' from l where key not in (select key from o)"""


def subset_check(spark, sf):
    """Users with all of three event types."""
    return D.subset(load(spark, sf, "events"), ["user_id"], "event_type", ("click", "purchase", "signup"))


SUBSET = """
with h as (select user_id, list_sort(list(distinct event_type)) as have from events group by 1)
select user_id, array_to_string(list_filter(['click', 'purchase', 'signup'], lambda x: not list_contains(have, x)), ',') as lacking,
 list_has_all(have, ['click', 'purchase', 'signup']) as complete, have = ['click', 'purchase', 'signup'] as equal from h"""


def label_excerpt(spark, sf):
    """Labels of documents: the language as type, the text, else the source."""
    d = load(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")))
    return d.select("doc_id", D.label(F.col("lang"), F.regexp_replace("text", "\n", " "), F.col("source"), F.col("doc_id").cast("string")).alias("label"))


LABEL_EXCERPT = """
with d as (select doc_id, lang, source, trim(replace(case when doc_id % 10 = 0 then '' else text end, chr(10), ' '), ' ') as t from documents)
select doc_id, lang || ' ' || case when t = '' then source when length(t) > 42 then rtrim(t[1:39]) || '…' else t end as label from d"""


def item_projection(spark, sf):
    """Assertion id (before the first dot), rest, weight of a severity and sorted distinct slides."""
    u = load(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("id"))
    slides = F.array_sort(F.array_distinct(F.array((F.col("page_id") % 5).cast("int"), (F.col("page_id") % 3).cast("int"), F.lit(1))))
    return u.select("page_id", F.substring_index("id", ".", 1).alias("assertion_id"), F.expr("substring(id, length(substring_index(id, '.', 1)) + 2)").alias("rest"), (3 - F.col("page_id") % 4).alias("weight"), F.array_join(slides, ",").alias("slides"))


ITEM_PROJECTION = """
with u as (select page_id, regexp_replace(url, '^[a-z]+://', '') as id from pages)
select page_id, split_part(id, '.', 1) as assertion_id, substr(id, length(split_part(id, '.', 1)) + 2) as rest, 3 - page_id % 4 as weight,
 array_to_string(list_sort(list_distinct([page_id % 5, page_id % 3, 1])), ',') as slides from u"""


def public_run_row(spark, sf):
    """Run (order) with campaign, organization and node figures; the report hash gets its prefix."""
    o, c, n, r = (load(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    l = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))  # noqa: E741
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("items", F.lit(0)).alias("items"), "quantity", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "c_name"), 256)).alias("report_sha256"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("completed_at"))


PUBLIC_RUN_ROW = """
with l as (select l_orderkey, count(*) as items, sum(l_quantity::bigint)::bigint as quantity from lineitem group by 1)
select o_orderkey, c_name, n_name, r_name, coalesce(items, 0) as items, quantity, 'sha256:' || sha256(concat_ws('|', o_orderkey::varchar, c_name)) as report_sha256,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as completed_at
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join l on o_orderkey = l_orderkey"""


def semantic_projection(spark, sf):
    """Report of an order as JSON: items sorted by ordinal, flags sorted by all fields, no diagnostics."""
    n = nodes(spark, sf).select("l_orderkey", F.struct("ordinal", F.col("l_returnflag").alias("flag")).alias("item"), F.when(F.col("l_quantity") > 48, F.struct(F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("disposition"))).alias("f"))
    g = n.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"), F.array_sort(F.collect_list("f")).alias("flags"))
    return g.select("l_orderkey", F.to_json(F.struct("items", "flags")).alias("report"))


SEMANTIC = f"""
with n as {NODES}
select l_orderkey, '{{"items":[' || string_agg('{{"ordinal":' || ordinal || ',"flag":"' || l_returnflag || '"}}', ',' order by ordinal) || '],"flags":['
 || coalesce(string_agg('{{"rule":"' || l_returnflag || '","disposition":"' || l_linestatus || '"}}', ',' order by l_returnflag, l_linestatus) filter (where l_quantity > 48), '') || ']}}' as report
from n group by l_orderkey"""

QUERIES = {
    "tree_diff": (tree_diff, TREE_DIFF),
    "positional_diff": (positional_diff, POSITIONAL_DIFF),
    "missing_unexpected": (missing_unexpected, MISSING),
    "subset_check": (subset_check, SUBSET),
    "label_excerpt": (label_excerpt, LABEL_EXCERPT),
    "item_projection": (item_projection, ITEM_PROJECTION),
    "public_run_row": (public_run_row, PUBLIC_RUN_ROW),
    "semantic_projection": (semantic_projection, SEMANTIC),
}
