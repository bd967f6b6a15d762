"""Constraint queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import content as X
from plumbline.operators import integrity as I
from plumbline.sources import load


def integrity_violations(spark, sf):
    """Broken constraints of the star schema: uniqueness, references, ranges, exact counts."""
    o, l, c, p = (load(spark, sf, t) for t in ("orders", "lineitem", "customer", "part"))  # noqa: E741
    return I.violations(
        I.unique(o, "unique order", "o_orderkey"),
        I.unique(p, "unique brand", "p_brand"),
        I.references(l, "line without order", "l_orderkey", o.filter("o_orderkey % 500 <> 3"), "o_orderkey"),
        I.references(o, "order without customer", "o_custkey", c, "c_custkey"),
        I.where(c, "balance", F.col("c_acctbal") < -900, F.col("c_custkey")),
        I.where(l, "tax", F.col("l_tax") >= F.col("l_discount") + 0.079, F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))),
        I.exact_count(p.filter("p_size <= 5"), "parts of a size", ["p_size"], 40),
    )


INTEGRITY = """
select 'unique order' as broken_rule, o_orderkey::varchar as subject from orders group by 2 having count(*) > 1
union all select 'unique brand', p_brand from part group by 2 having count(*) > 1
union all select distinct 'line without order', l_orderkey::varchar from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 500 <> 3)
union all select distinct 'order without customer', o_custkey::varchar from orders where o_custkey not in (select c_custkey from customer)
union all select 'balance', c_custkey::varchar from customer where c_acctbal < -900
union all select 'tax', l_orderkey || '|' || l_linenumber from lineitem where l_tax >= l_discount + 0.079::double
union all select 'parts of a size', p_size::varchar from part where p_size <= 5 group by 2 having count(*) <> 40"""


def projection_equality(spark, sf):
    """All nodes as a frozen projection: rows that one side lacks, with changes in every 997th."""
    l = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    other = l.withColumn("l_linenumber", F.when(F.col("l_orderkey") % 997 == 0, F.col("l_linenumber") + 10).otherwise(F.col("l_linenumber")))
    return I.same_rows(l, other, "projection")


PROJECTION = """
with l as (select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey % 997 = 0), b as (select * from l union all select l_orderkey, l_linenumber + 10, l_partkey from l)
select 'projection' as broken_rule, '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}' as subject from b"""

def corpus_constraints(spark, sf):
    """Constraints of a rule corpus: one threshold for all visual rules (order = rule), slides that are a
    prefix (lines of an order), all variants of a part, authors of a customer, and means of suppliers
    as recorded, where every tenth was recorded wrongly."""
    o, l = load(spark, sf, "orders"), load(spark, sf, "lineitem")  # noqa: E741
    rules = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "visual_ssim").otherwise("text_match").alias("method"), F.when(F.col("o_orderkey") % 1000 == 7, 0.99).when(F.col("o_orderkey") % 1000 != 8, 0.9999).alias("min_ssim"))
    means = l.groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 2).alias("mean")).select("l_suppkey", (F.col("mean") + F.when(F.col("l_suppkey") % 10 == 3, 0.5).otherwise(0.0)).alias("mean"))
    return I.violations(
        I.thresholds(rules, 0.9999),
        I.members(l, "slides of a tier", "l_orderkey", "l_linenumber"),
        I.members(l, "variants of a fixture", "l_partkey", "l_returnflag", ["A", "N", "R"]),
        I.pairwise(o, "authors", "o_custkey", "o_orderpriority", 3),
        I.recorded_means(l, "recorded mean", "l_suppkey", "l_quantity", means, 2),
    )


CORPUS = """
with m as (select l_suppkey, round(avg(l_quantity), 2) as a from lineitem group by 1)
select 'ssim threshold' as broken_rule, o_orderkey::varchar as subject from orders where o_orderstatus = 'F' and o_orderkey % 1000 in (7, 8)
union all select 'slides of a tier', l_orderkey::varchar from lineitem group by l_orderkey having list_sort(list(distinct l_linenumber)) <> range(1, count(*) + 1)
union all select 'variants of a fixture', l_partkey::varchar from lineitem group by l_partkey having count(distinct l_returnflag) <> 3
union all select 'authors', o_custkey::varchar from orders group by o_custkey having count(distinct o_orderpriority) <> 3
union all select 'recorded mean', l_suppkey::varchar from m where l_suppkey % 10 = 3"""

def declarations() -> dict[str, X.Declaration]:
    """Content models of orders by their status, over the return flags of their items."""
    a, n, r = X.child("A", 0, None), X.child("N", 0), X.child("R", 0, 2)
    return {
        "F": X.Declaration(X.sequence(a, n, r), {"big": False}),
        "O": X.Declaration(X.choice(X.child("A"), X.child("N"), X.child("R"), least=2, most=None), {"clerk": True}),
        "P": X.Declaration(X.sequence(X.choice(X.child("A"), X.child("R"), most=3), X.child("N", 1, None), X.child("R", 0))),
    }


def order_elements(spark, sf):
    """Every order as an element: its model is its status, its children its items' flags in their order."""
    o, l = load(spark, sf, "orders"), load(spark, sf, "lineitem")  # noqa: E741
    inside = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: x["l_returnflag"])
    has = F.concat(F.when(F.col("o_totalprice") > 300_000, F.array(F.lit("big"))).otherwise(F.array()), F.when(F.col("o_custkey") % 3 > 0, F.array(F.lit("clerk"))).otherwise(F.array()))
    model = F.when(F.col("o_orderkey") % 50 == 7, "Q").otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", model.alias("model"), has.cast("array<string>").alias("attributes")).join(l.groupBy("l_orderkey").agg(inside.alias("children")), "l_orderkey", "left")


def content_models(spark, sf):
    """What is wrong with every order under the content model of its status."""
    found = X.check(order_elements(spark, sf).drop("o_custkey", "o_orderpriority"), X.compiled(spark, declarations()))
    return found.withColumnRenamed("l_orderkey", "o_orderkey")


#: For each model what its children are as one string of flags, and what may still become that.
_WHOLE, _BEGUN = {"F": "A*N?R{0,2}", "O": "[ANR]{2,}", "P": "[AR]{1,3}N+R?"}, {"F": "A*N?R{0,2}", "O": "[ANR]*", "P": "[AR]{0,3}|[AR]{1,3}N+R?"}
_MODEL = "case when o_orderkey % 50 = 7 then 'Q' else o_orderstatus end"
CONTENT_SQL = f"""
c as (select l_orderkey, string_agg(l_returnflag, '' order by l_linenumber, l_partkey, l_returnflag) as s from lineitem group by 1),
e as (select o_orderkey, o_custkey, o_orderpriority, {_MODEL} as model, coalesce(s, '') as s, o_totalprice > 300000 as big, o_custkey % 3 > 0 as clerk from orders left join c on l_orderkey = o_orderkey),
k as (select e.*, n from e, lateral (select max(i) as n from range(0, length(s) + 1) r(i) where case model {' '.join(f"when '{m}' then regexp_full_match(left(s, i::int), '{p}')" for m, p in _BEGUN.items())} end)),
f as (select *, n < length(s) as bad, left(s, n::int) as ok, case model {' '.join(f"when '{m}' then regexp_full_match(s, '{p}')" for m, p in _WHOLE.items())} end as fine from k),
x as (select *, case model when 'O' then 'A N R' when 'F' then case when not regexp_matches(ok, '[NR]') then 'A N R' when regexp_matches(ok, 'RR$') then 'nothing' else 'R' end
  else case when ok = '' then 'A R' when regexp_matches(ok, 'NR$') then 'nothing' when regexp_matches(ok, 'N$') then 'N R' when length(ok) = 3 then 'N' else 'A N R' end end as next from f),
v as (select *, 'undeclared element' as problem, null::int as place, model as detail from x where model = 'Q'
 union all select *, 'unexpected child', n::int + 1, substr(s, n::int + 1, 1) || ', expected ' || next from x where model <> 'Q' and bad
 union all select *, 'missing child', length(s)::int + 1, 'expected ' || next from x where model <> 'Q' and not bad and not fine
 union all select *, 'undeclared attribute', null, 'big' from x where big and model in ('O', 'P') union all select *, 'undeclared attribute', null, 'clerk' from x where clerk and model in ('F', 'P')
 union all select *, 'missing attribute', null, 'clerk' from x where not clerk and model = 'O')"""
CONTENT = f"""with {CONTENT_SQL} select o_orderkey, problem, place, detail from v"""


def validation_verdicts(spark, sf):
    """Every customer as a package, every order as a part: which are mapped to a schema by (priority, status), what is
    wrong in those that are, and whether the customer's validation was performed and found nothing."""
    pairs = [(p, s, f"{s}.schema") for s in "FOPQ" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") if (p, s) not in (("5-LOW", "O"), ("1-URGENT", "P"))]
    e = order_elements(spark, sf)
    name = F.concat(F.when(F.col("l_orderkey") % 5 == 0, "docs/").otherwise("ppt/"), F.col("l_orderkey").cast("string"), F.lit(".xml"))
    e = e.withColumns({"package_id": F.col("o_custkey").cast("string"), "part_name": name})
    parts = X.mapped(e.select("package_id", "part_name", F.col("o_orderpriority").alias("content_type"), F.col("model").alias("root")), spark.createDataFrame(pairs, "content_type string, root string, schema string"))
    known = parts.filter(X.relevant(F.col("part_name")) & F.col("schema").isNotNull())
    todo = e.join(known.select("package_id", "part_name"), ["package_id", "part_name"], "left_semi")
    found = X.check(todo, X.compiled(spark, declarations())).select("package_id", "part_name", "problem", "detail")
    return X.verdicts(parts, found.unionByName(X.unmapped(parts.filter(X.relevant(F.col("part_name"))))))


VERDICTS = f"""with {CONTENT_SQL},
p as (select o_orderkey, o_custkey::varchar as package_id, o_orderkey % 5 <> 0 as rel, (o_orderpriority = '5-LOW' and model = 'O') or (o_orderpriority = '1-URGENT' and model = 'P') as lost from e),
w as (select o_orderkey, count(*) as n from v group by 1),
g as (select package_id, count(*) filter (where rel) as relevant, count(*) filter (where rel and not lost) as validated, coalesce(sum(case when not rel then 0 when lost then 1 else n end), 0)::bigint as violations
  from p left join w using (o_orderkey) group by 1)
select *, relevant > 0 and relevant = validated as performed, relevant > 0 and relevant = validated and violations = 0 as valid from g"""

QUERIES = {
    "content_models": (content_models, CONTENT),
    "validation_verdicts": (validation_verdicts, VERDICTS),"integrity_violations": (integrity_violations, INTEGRITY), "projection_equality": (projection_equality, PROJECTION), "corpus_constraints": (corpus_constraints, CORPUS)}
