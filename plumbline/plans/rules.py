"""Rule queries on the driver tables: order = deck or slide, lineitem = scene node."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import rules as R
from plumbline.operators.score import weight
from plumbline.sources import load

RULES = [
    {"id": "r1", "selector": "any", "min_count": 3},
    {"id": "r2", "selector": "returned", "exact_count": 0},
    {"id": "r3", "selector": "open", "required": True, "min_count": 2},
    {"id": "r4", "selector": "returned", "min_count": 2},
]


def rule_object_compare(spark, sf):
    """Count rules over the nodes of every order; orders without nodes are not found."""
    nodes = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    counts = R.selector_counts(nodes, ["l_orderkey"], {"any": F.lit(True), "returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"})
    decks = load(spark, sf, "orders").select("o_orderkey").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return R.object_compare(decks, RULES)


OBJECT_COMPARE = """
with c as (select l_orderkey, count(*) as n_any, count(*) filter (where l_returnflag = 'R') as n_ret, count(*) filter (where l_linestatus = 'O') as n_open from lineitem group by 1),
r(rule_id, sel, required, exact, least) as (values ('r1', 'any', false, null, 3), ('r2', 'ret', false, 0, 0), ('r3', 'open', true, null, 2), ('r4', 'ret', false, null, 2)),
j as (select o_orderkey, r.*, case sel when 'any' then n_any when 'ret' then n_ret else n_open end as n from orders left join c on o_orderkey = l_orderkey cross join r),
d as (select *, case when n is null then 'slide not found' when required and n = 0 then 'required but missing'
  when n <> exact then 'expected ' || exact || ', found ' || n when n < least then 'at least ' || least || ', found ' || n else 'ok' end as detail from j)
select o_orderkey, rule_id, coalesce(n, 0) as observed, detail = 'ok' as passed, detail from d"""


def rule_text_match(spark, sf):
    """Runs (turns) joined by one blank in order; contains, then not_contains."""
    runs = load(spark, sf, "conversations")
    text = runs.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return R.text_match(text, "text", contains="the", not_contains="ing").select("conv_id", F.length("text").alias("n_chars"), "passed", "detail")


TEXT_MATCH = """
with t as (select conv_id, string_agg(text, ' ' order by turn) as text from conversations group by conv_id)
select conv_id, length(text)::int as n_chars, contains(text, 'the') and not contains(text, 'ing') as passed,
  case when not contains(text, 'the') then 'missing text' when contains(text, 'ing') then 'forbidden text' else 'ok' end as detail from t"""


def rule_hash_match(spark, sf):
    """Asset = first document of each language; a deck (source) passes if any of its media has the hash; null texts are empty ones."""
    media = load(spark, sf, "documents").select("source", "lang", "doc_id", F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    wanted = media.groupBy("lang").agg(F.min_by("sha", "doc_id").alias("want"))
    decks = media.groupBy("source").agg(F.count(F.lit(1)).alias("n_media"))
    met = media.join(wanted.select("want"), F.col("sha") == F.col("want"), "left_semi").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("sha")), ",").alias("found"))
    return decks.join(met, "source", "left").select("source", "n_media", F.col("found").isNotNull().alias("passed"), F.coalesce("found", F.lit("")).alias("found"))


HASH_MATCH = """
with m as (select source, lang, doc_id, 'sha256:' || sha256(coalesce(text, '')) as sha from documents),
w as (select arg_min(sha, doc_id) as want from m group by lang),
f as (select source, string_agg(distinct sha, ',' order by sha) as found from m where sha in (select want from w) group by source)
select source, count(*) as n_media, any_value(found) is not null as passed, coalesce(any_value(found), '') as found from m left join f using (source) group by source"""


def rule_field_check(spark, sf):
    """A field of the wanted type, else any field, else none."""
    f = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("typed"), F.bool_or(F.col("l_linestatus") == "O").alias("other"))
    passed, detail = R.first_failure((~F.col("typed") & ~F.col("other"), "no field"))
    return f.select("l_orderkey", passed.alias("passed"), F.when(F.col("typed"), "typed field").when(F.col("other"), "other field").otherwise(detail).alias("detail"))


FIELD_CHECK = """
with f as (select l_orderkey, bool_or(l_returnflag = 'R') as t, bool_or(l_linestatus = 'O') as o from lineitem group by 1)
select l_orderkey, t or o as passed, case when t then 'typed field' when o then 'other field' else 'no field' end as detail from f"""


def rule_layout_check(spark, sf):
    """At least two placeholders (flag N) and a layout reference that isn't empty."""
    n = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("placeholders"))
    o = load(spark, sf, "orders").select("o_orderkey", F.nullif(F.element_at(F.split("o_orderpriority", "-"), 1), F.lit("5")).alias("layout"))
    j = o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("placeholders", F.coalesce("placeholders", F.lit(0)))
    passed, detail = R.first_failure((F.col("layout").isNull(), "no layout"), (F.col("placeholders") < 2, "too few placeholders"))
    return j.select("o_orderkey", "placeholders", passed.alias("passed"), detail.alias("detail"))


LAYOUT_CHECK = """
with n as (select l_orderkey, count(*) filter (where l_returnflag = 'N') as p from lineitem group by 1)
select o_orderkey, coalesce(p, 0) as placeholders, nullif(split_part(o_orderpriority, '-', 1), '5') is not null and coalesce(p, 0) >= 2 as passed,
 case when nullif(split_part(o_orderpriority, '-', 1), '5') is null then 'no layout' when coalesce(p, 0) < 2 then 'too few placeholders' else 'ok' end as detail
from orders left join n on o_orderkey = l_orderkey"""


def rule_allow_list(spark, sf):
    """Languages of every source against an allow-list."""
    return R.allow_list(load(spark, sf, "documents"), ["source"], "lang", ("en", "de", "fr")).withColumn("n_violations", F.when(F.col("violations") == "", 0).otherwise(F.size(F.split("violations", ","))))


ALLOW_LIST = """
with v as (select source, lang, lang <> '' and lang not like '+%' and lower(lang) not in ('en', 'de', 'fr') as bad from documents)
select source, coalesce(string_agg(distinct lang, ',' order by lang) filter (where bad), '') as violations, not coalesce(bool_or(bad), false) as passed,
 count(distinct lang) filter (where bad)::int as n_violations from v group by source"""


def nodes(spark, sf):
    """lineitem with its ordinal among the nodes of its order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return load(spark, sf, "lineitem").withColumn("ordinal", F.row_number().over(w))


NODES = "(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::int as ordinal from lineitem)"


def rule_area_ratio(spark, sf):
    """Quantity times price as the area of a picture on a page of 5 000 000."""
    return R.area_ratio(nodes(spark, sf), ["l_orderkey"], ["ordinal"], F.col("l_quantity") * F.col("l_extendedprice"), 5e6)


AREA_RATIO = f"""
with h as (select *, l_quantity * l_extendedprice / 5e6::double as ratio from {NODES} where l_quantity * l_extendedprice / 5e6::double > 0.4),
f as (select l_orderkey, min(ordinal) as first_ordinal, arg_min(ratio, ordinal) as ratio from h group by 1)
select o.l_orderkey, f.l_orderkey is null as passed, first_ordinal, floor(ratio * 100)::bigint as percent from (select distinct l_orderkey from lineitem) o left join f using (l_orderkey)"""


def rule_similarity_floor(spark, sf):
    """Cosine of every vector with its label's centroid against a floor."""
    e = load(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    c = e.groupBy("label", "dim").agg(F.avg("x").alias("c"))
    s = e.join(c, ["label", "dim"]).groupBy("label", "vec_id").agg((F.sum(F.col("x") * F.col("c")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("c") * F.col("c")))).alias("s"))
    return R.similarity_floor(s, ["label"], "s", 0.1)


SIMILARITY_FLOOR = """
with e as (select vec_id, label, generate_subscripts(embedding, 1) as dim, unnest(embedding)::double as x from embeddings),
c as (select label, dim, avg(x) as c from e group by all),
s as (select label, vec_id, sum(x * c) / sqrt(sum(x * x) * sum(c * c)) as s from e join c using (label, dim) group by all)
select label, count(*) filter (where s >= 0.1) as n_ok, count(*) as n, round(min(s), 6) as min_score, round(avg(s), 6) as mean_score, bool_and(s >= 0.1) as passed from s group by label"""


def tier_scores(spark, sf):
    """Tiers are prefixes of the line numbers (1, 3, 7); only the deck's own tier is scored."""
    n = load(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", weight(F.element_at(F.array(*map(F.lit, ("critical", "major", "minor", "informational"))), (F.col("l_partkey") % 4 + 1).cast("int"))).alias("w"), (F.col("l_returnflag") != "R").alias("p"))
    tier = (F.col("l_suppkey") % 3 + 1).cast("int")
    deep = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(7)), tier)
    g = n.filter((F.col("l_linenumber") <= deep) & (F.col("w") > 0)).groupBy("l_suppkey", tier.alias("tier")).agg(F.round(F.sum(F.when(F.col("p"), F.col("w")).otherwise(0)) / F.sum("w"), 4).alias("s"))
    return g.select("l_suppkey", "tier", *(F.when(F.col("tier") == k, F.col("s")).alias(f"tier_{k}") for k in (1, 2, 3)))


TIER_SCORES = """
with n as (select l_suppkey, (l_suppkey % 3 + 1)::int as tier, l_linenumber, 3 - l_partkey % 4 as w, l_returnflag <> 'R' as p from lineitem),
g as (select l_suppkey, tier, round(sum(case when p then w else 0 end) / sum(w), 4) as s from n where w > 0 and l_linenumber <= [1, 3, 7][tier] group by all)
select l_suppkey, tier, case when tier = 1 then s end as tier_1, case when tier = 2 then s end as tier_2, case when tier = 3 then s end as tier_3 from g"""


def zero_propagation(spark, sf):
    """A returned node of quantity above 45 zeroes its order; first nodes count as deck items."""
    r = nodes(spark, sf).select("l_orderkey", "ordinal", (F.col("l_returnflag") != "R").alias("passed"), (F.col("l_quantity") > 45).alias("zeroes"), (F.col("ordinal") == 1).alias("is_deck"))
    return R.zeroed(r, ["l_orderkey"]).select("l_orderkey", "ordinal", "passed", "outcome")


ZERO_PROPAGATION = f"""
with r as (select l_orderkey, ordinal, l_returnflag <> 'R' as p, l_quantity > 45 as z from {NODES}),
x as (select *, bool_or(not p and z) over (partition by l_orderkey) and ordinal > 1 and p as taken from r)
select l_orderkey, ordinal, p and not taken as passed, case when taken then 'zeroed_by_anti_cheat' when p then 'passed' else 'failed' end as outcome from x"""


def affected_slides(spark, sf):
    """Failing rules (large returns) and the slides they affect: a named selector (all lines with
    the same status), a configured list (1, 2), or the current one, by mode."""
    n = nodes(spark, sf)
    fail = n.filter("l_returnflag = 'R' and l_quantity > 48").select("l_orderkey", "ordinal", "l_linestatus", F.element_at(F.array(F.lit("selector"), F.lit("configured"), F.lit("current")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("mode"))
    named = n.groupBy("l_orderkey", "l_linestatus").agg(F.array_sort(F.collect_set("ordinal")).alias("named"))
    size = n.groupBy("l_orderkey").agg(F.max("ordinal").alias("size"))
    j = fail.join(named, ["l_orderkey", "l_linestatus"]).join(size, "l_orderkey")
    slides = F.when(F.col("mode") == "selector", F.col("named")).when(F.col("mode") == "configured", F.array(F.lit(1), F.lit(2))).otherwise(F.array("ordinal"))
    return j.select("l_orderkey", "ordinal", "mode", F.array_join(F.array_intersect(slides, F.sequence(F.lit(1), "size")), ",").alias("slides"))


AFFECTED = f"""
with n as {NODES}, f as (select *, ['selector', 'configured', 'current'][l_partkey % 3 + 1] as mode from n where l_returnflag = 'R' and l_quantity > 48),
z as (select l_orderkey, max(ordinal) as size from n group by 1)
select f.l_orderkey, f.ordinal, mode, case mode when 'current' then f.ordinal::varchar when 'configured' then case when size >= 2 then '1,2' else '1' end
 else (select string_agg(n.ordinal::varchar, ',' order by n.ordinal) from n where n.l_orderkey = f.l_orderkey and n.l_linestatus = f.l_linestatus) end as slides
from f join z using (l_orderkey)"""


def eligibility(spark, sf):
    """Reasons that disqualify a run, and whether it is eligible."""
    o = load(spark, sf, "orders")
    why = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_totalprice") < 50000, "below_floor"), F.when(F.col("o_orderpriority").startswith("5"), "local_run")))
    return o.select("o_orderkey", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("eligible"))


ELIGIBILITY = """
select o_orderkey, concat_ws(',', case when o_orderstatus = 'P' then 'pending' end, case when o_totalprice < 50000 then 'below_floor' end, case when starts_with(o_orderpriority, '5') then 'local_run' end) as reasons,
 not (o_orderstatus = 'P' or o_totalprice < 50000 or starts_with(o_orderpriority, '5')) as eligible from orders"""


def binding_mismatch(spark, sf):
    """Recorded fields of an order against those recomputed from its nodes."""
    got = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("status"), F.count(F.lit(1)).alias("n"), F.max(F.to_date("l_shipdate")).alias("last"))
    o = load(spark, sf, "orders")
    j = o.join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    late = F.col("last") < F.to_date("o_orderdate")
    names = R.mismatched([("status", F.col("o_orderstatus"), F.col("status")), ("dates", late, F.lit(False)), ("count", F.col("n") % 2, F.lit(0).cast("long"))])
    return j.select("o_orderkey", names.alias("fields"), (names == "").alias("bound"))


BINDING = """
with g as (select l_orderkey, max(l_linestatus) as status, count(*) as n, max(l_shipdate::date) as last from lineitem group by 1),
f as (select o_orderkey, concat_ws(',', case when n % 2 is distinct from 0 then 'count' end, case when (last < o_orderdate::date) is distinct from false then 'dates' end,
  case when o_orderstatus is distinct from status then 'status' end) as fields from orders left join g on o_orderkey = l_orderkey)
select o_orderkey, fields, fields = '' as bound from f"""

QUERIES = {
    "rule_object_compare": (rule_object_compare, OBJECT_COMPARE),
    "rule_text_match": (rule_text_match, TEXT_MATCH),
    "rule_hash_match": (rule_hash_match, HASH_MATCH),
    "rule_field_check": (rule_field_check, FIELD_CHECK),
    "rule_layout_check": (rule_layout_check, LAYOUT_CHECK),
    "rule_allow_list": (rule_allow_list, ALLOW_LIST),
    "rule_area_ratio": (rule_area_ratio, AREA_RATIO),
    "rule_similarity_floor": (rule_similarity_floor, SIMILARITY_FLOOR),
    "tier_scores": (tier_scores, TIER_SCORES),
    "zero_propagation": (zero_propagation, ZERO_PROPAGATION),
    "affected_slides": (affected_slides, AFFECTED),
    "eligibility": (eligibility, ELIGIBILITY),
    "binding_mismatch": (binding_mismatch, BINDING),
}
