"""Whole checklists over the driver tables, run by the operators that a user's decks go through.

Stand-ins: order = deck, line number = slide, lineitem = node (flag R a picture, A a table, N a
shape; open ones are placeholders), discount = how far a rendering is from its reference.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import api
from plumbline.operators import checklist as C
from plumbline.operators.selectors import descriptor_hash
from plumbline.sources import load

TIER = 1
ASSETS = {"first": "1-URGENT", "second": "2-HIGH"}


def rule(id, slide=None, tier=1, severity="major", **more):
    v = {"id": id, "scope": "deck" if slide is None else "slide", "slide": slide, "tier": tier, "severity": severity} | more
    return tuple(v.get(c) for c in C.RULE)


def named(selector):
    return {"affected_mode": "named_selector", "selector_id": selector, "selector_sha256": descriptor_hash({"selector_id": selector, "version": 1})}


def rules():
    import hashlib

    sha = {k: "sha256:" + hashlib.sha256(v.encode()).hexdigest() for k, v in ASSETS.items()}
    return [
        rule("pictures", 1, severity="critical", method="object_compare", selector="picture", exact_count=0),
        rule("shapes", 1, method="object_compare", selector="shape", required=True, min_count=2),
        rule("words", 2, severity="minor", method="text_match", contains="N", not_contains="1"),
        rule("exact", 2, severity="minor", method="text_match", exact="p7N"),
        rule("asset", 3, method="hash_match", sha256=sha["first"]),
        rule("number", 3, severity="minor", method="field_check", field_type="slidenum"),
        rule("any field", 3, severity="informational", method="field_check"),
        rule("titles", 4, method="layout_check", selector="placeholder", placeholder_type="title"),
        rule("layout", 4, method="layout_check", selector="master_ref"),
        rule("bogus", 4, severity="minor", method="layout_check", selector="bogus"),
        rule("fonts", 5, method="anti_cheat", selector="font_policy", automatic_fail_if=["font"], propagation="zero_slide"),
        rule("raster", 1, severity="critical", method="anti_cheat", selector="no_full_slide_raster", automatic_fail_if=["raster", "flat"], propagation="zero_slide", affected_mode="configured", affected_slides=[2, 1, 6]),
        rule("raster 2", 2, method="anti_cheat", selector="no_full_slide_raster", automatic_fail_if=["raster"], propagation="zero_affected_slides", affected_slides=[3]),
        rule("look", 3, method="visual_ssim", min_ssim=0.99995),
        rule("late", 6, method="visual_ssim"),
        rule("higher tier", 1, 2, method="object_compare", selector="table", min_count=1),
        rule("odd", 1, severity="minor", method="nonsense"),
        rule("slides", severity="critical", method="object_compare", selector="slide_count", exact_count=4),
        rule("masters", method="layout_check", selector="master_count"),
        rule("layouts", severity="minor", method="layout_check", selector="layout_count", min_count=2),
        rule("notes", severity="critical", method="anti_cheat", selector="no_notes", automatic_fail_if=["notes"], **named("notes-comments")),
        rule("deck fonts", method="anti_cheat", selector="font_policy", automatic_fail_if=["font"], propagation="zero_affected_slides", **named("non-bundled-font")),
        rule("assets", method="hash_match", asset_hashes=sha),
        rule("looks", method="visual_ssim", min_ssim=0.99993),
    ]


def tables(spark, sf):
    l, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")  # noqa: E741
    keys = [F.col("l_orderkey").alias("deck_id"), F.col("l_linenumber").alias("slide")]
    kind = F.when(F.col("l_returnflag") == "R", "picture").when(F.col("l_returnflag") == "A", "table").otherwise("shape")
    holder = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_suppkey") % 2 == 0, "title").otherwise("body"))
    fields = F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit("slidenum"))).when(F.col("l_partkey") % 3 == 1, F.array(F.lit("datetime"))).otherwise(F.array().cast("array<string>"))
    font = F.when(F.col("l_partkey") % 11 == 0, "Comic").when(F.col("l_partkey") % 11 == 1, "+mn-lt").otherwise("Carlito")
    runs = F.array(F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.col("l_returnflag")).alias("text"), font.alias("font")))
    nodes = l.select(*keys, kind.alias("kind"), holder.alias("placeholder_type"), fields.alias("field_types"), runs.alias("runs"), F.floor(F.col("l_quantity") * 100000).alias("cx"), F.floor(F.col("l_extendedprice") * 100).alias("cy"), F.array("l_partkey", "l_suppkey").alias("path"))
    layouts = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Master"), F.lit("Layout"), F.lit("Layout"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("Master"), F.lit("Layout"))).otherwise(F.array(F.lit("Layout")))
    return {
        "nodes": nodes,
        "slides": l.groupBy(*keys).agg(F.when(F.min("l_suppkey") % 5 == 0, "").otherwise("layout").alias("layout_ref")),
        "media": o.filter("o_custkey % 7 <> 0").select(F.col("o_orderkey").alias("deck_id"), F.concat(F.lit("sha256:"), F.sha2("o_orderpriority", 256)).alias("sha256")),
        "names": o.select(F.col("o_orderkey").alias("deck_id"), F.explode(layouts).alias("level")).withColumn("name", F.col("level")),
        "notes": l.select(*keys, (F.col("l_tax") >= 0.08).alias("notes"), F.lit(False).alias("comments")),
        "visual": l.filter("l_suppkey % 10 <> 0").select(*keys, (1 - F.col("l_discount") / 1000).alias("ssim"), F.col("l_partkey").alias("ordinal")),
        "decks": o.select(F.col("o_orderkey").alias("deck_id")),
    }


def graded(spark, sf):
    t = tables(spark, sf)
    return api.grade(t, spark.createDataFrame(rules(), ", ".join(f"{c} {kind}" for c, kind in C.RULE.items())), t["visual"], TIER)


def grade_items(spark, sf):
    """Every item of the checklist for every deck, slides zeroed as failures demand."""
    return graded(spark, sf).results.select("deck_id", "id", "slide", "passed", "outcome", "detail", "weight")


def grade_scores(spark, sf):
    """Weighted fidelity of every deck."""
    return graded(spark, sf).scores


def grade_flags(spark, sf):
    """Anti-cheat rules that failures stand for, and the slides they affect."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: s.cast("string")), ",").alias(c)
    return graded(spark, sf).flags.select("deck_id", "id", "slide", "rule_id", "disposition", joined("affected"), joined("tier_affected"), "detail")


FACTS = f"""
n as (select l_orderkey as d, l_linenumber as s, *, 'p' || l_partkey || l_returnflag as t,
  floor(l_quantity * 100000)::double * floor(l_extendedprice * 100)::double / {C.PAGE}::double as ratio from lineitem),
sf as materialized (select d, s, count(*) filter (where l_returnflag = 'R') as pics, count(*) as shapes, string_agg(t, ' ' order by l_partkey, l_suppkey, t) as text, bool_or(l_partkey % 11 = 0) as comic,
  bool_or(l_returnflag = 'R' and ratio > 0.4) as raster, count(*) filter (where l_linestatus = 'O' and l_suppkey % 2 = 0) as titles, bool_or(l_partkey % 3 = 0) as numbered,
  bool_or(l_partkey % 3 < 2) as fielded, min(l_suppkey) % 5 = 0 as bare, bool_or(l_tax >= 0.08) as noted from n group by all),
v as materialized (select l_orderkey as d, l_linenumber as s, 1 - l_discount / 1000 as ssim from lineitem where l_suppkey % 10 <> 0
  qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, 1 - l_discount / 1000 desc) = 1),
dg as materialized (select d, count(*) as slides, bool_or(comic) as comic, bool_or(noted) as noted, list(s order by s) filter (where noted) as noted_slides, list(s order by s) filter (where comic) as comic_slides from sf group by d),
vg as materialized (select d, min(ssim) as least_ssim from v group by d),
df as materialized (select o_orderkey as d, o_orderstatus as status, case when o_custkey % 7 <> 0 then o_orderpriority end as media, coalesce(slides, 0) as slides,
  coalesce(comic, false) as comic, coalesce(noted, false) as noted, noted_slides, comic_slides, least_ssim from orders left join dg on dg.d = o_orderkey left join vg on vg.d = o_orderkey),
r(id, s, w) as (values ('pictures', 1, 3), ('shapes', 1, 2), ('words', 2, 1), ('exact', 2, 1), ('asset', 3, 2), ('number', 3, 1), ('any field', 3, 0), ('titles', 4, 2), ('layout', 4, 2), ('bogus', 4, 1),
  ('fonts', 5, 2), ('raster', 1, 3), ('raster 2', 2, 2), ('look', 3, 2), ('odd', 1, 1),
  ('slides', null, 3), ('masters', null, 2), ('layouts', null, 1), ('notes', null, 3), ('deck fonts', null, 2), ('assets', null, 2), ('looks', null, 2)),
j as materialized (select df.d, r.id, noted_slides, comic_slides, r.s, r.w, case when r.s is not null and sf.d is null then 'slide not found' else case id
  when 'pictures' then case when pics <> 0 then 'exact count differs' end
  when 'shapes' then case when shapes < 2 then 'too few' end
  when 'words' then case when not contains(text, 'N') then 'missing text' when contains(text, '1') then 'forbidden text' end
  when 'exact' then case when text <> 'p7N' then 'text differs' end
  when 'asset' then case when pics = 0 then 'no picture' when media is distinct from '1-URGENT' then 'hash not found' end
  when 'number' then case when not numbered then 'field not found' end
  when 'any field' then case when not fielded then 'no field' end
  when 'titles' then case when titles = 0 then 'too few placeholders' end
  when 'layout' then case when bare then 'no layout' end
  when 'bogus' then 'unknown selector'
  when 'fonts' then case when sf.comic then 'fonts Comic' end
  when 'raster' then case when raster then 'full-slide raster' end
  when 'raster 2' then case when raster then 'full-slide raster' end
  when 'look' then case when ssim is null then 'no visual result' when ssim < 0.99995 then 'below threshold' end
  when 'odd' then 'unknown method'
  when 'slides' then case when slides <> 4 then 'slide count differs' end
  when 'masters' then case when status = 'P' then 'too few masters' end
  when 'layouts' then case when status <> 'F' then 'too few layouts' end
  when 'notes' then case when df.noted then 'notes or comments' end
  when 'deck fonts' then case when df.comic then 'fonts Comic' end
  when 'assets' then case when media = '1-URGENT' then 'missing second' when media = '2-HIGH' then 'missing first' else 'missing first,second' end
  when 'looks' then case when least_ssim is null then 'no visual result' when least_ssim < 0.99993 then 'below threshold' end end end as fault
  from df cross join r left join sf on sf.d = df.d and sf.s = r.s left join v on v.d = df.d and v.s = r.s),
f as materialized (select d, id, s, fault, case id when 'notes' then coalesce(noted_slides, []) when 'deck fonts' then comic_slides
  when 'raster' then [1, 2, 6] when 'raster 2' then [3] else [5] end as affected from j where fault is not null and id in ('notes', 'deck fonts', 'raster', 'raster 2', 'fonts')),
z as materialized (select distinct d, unnest(affected) as s from f where id <> 'raster 2'),
i as (select j.d as deck_id, j.id, j.s as slide, w as weight, fault is null and z.d is null as passed, case when fault is not null then 'failed' when z.d is not null then 'zeroed_by_anti_cheat' else 'passed' end as outcome,
  case when fault is not null then fault when z.d is not null then 'zeroed on slide ' || j.s else 'ok' end as detail from j left join z on z.d = j.d and z.s = j.s)"""
ITEMS = f"with {FACTS} select deck_id, id, slide, passed, outcome, detail, weight from i"
SCORES = f"""with {FACTS} select deck_id, round(sum(case when passed then weight else 0 end) / sum(weight), 4) as fidelity,
 count(*) filter (where passed and weight > 0) as passed_items, count(*) filter (where weight > 0) as total_items from i group by 1"""
FLAGS = f"""with {FACTS}, k(id, rule_id, disposition) as (values ('notes', 'notes', 'warning'), ('deck fonts', 'font', 'zero_affected_slides'), ('raster', 'raster', 'zero_slide'), ('raster', 'flat', 'zero_slide'),
 ('raster 2', 'raster', 'zero_affected_slides'), ('fonts', 'font', 'zero_slide'))
select d as deck_id, id, s as slide, rule_id, disposition, array_to_string(affected, ',') as affected, array_to_string(list_filter(affected, lambda x: x <= 5), ',') as tier_affected, fault as detail from f join k using (id)"""

KINDS = ("picture", "table", "chart", "connector", "group", "shape", "field")


def fault_rules():
    """A rule for each fault, by the fault's name."""
    import hashlib

    sha = "sha256:" + hashlib.sha256(b"1-URGENT").hexdigest()
    looks = {"method": "visual_ssim", "min_ssim": 0.9999}
    return [
        *(rule(f"decrement-{k}-count", 1, method="object_compare", selector=k, min_count=1) for k in KINDS),
        rule("replace-required-text", 1, method="text_match", contains="p"),
        rule("remove-required-placeholder", 1, method="layout_check", selector="placeholder"),
        rule("substitute-non-bundled-font", 1, method="anti_cheat", selector="font_policy"),
        rule("clear-layout-reference", 1, method="layout_check", selector="master_ref"),
        rule("lower-one-slide-ssim", 1, **looks),
        rule("lower-ssim-below-threshold", **looks),
        rule("replace-approved-asset-hash", method="hash_match", asset_hashes={"a": sha}),
        rule("replace-one-approved-asset-hash", method="hash_match", asset_hashes={"a": sha}),
        rule("change-exact-slide-count", method="object_compare", selector="slide_count", exact_count=4),
        rule("decrement-master-count", method="layout_check", selector="master_count"),
        rule("decrement-layout-count", method="layout_check", selector="layout_count"),
        rule("add-speaker-notes-relationship", method="anti_cheat", selector="no_notes"),
    ]


def mutation_matrix(spark, sf):
    """Every fault in every deck: how many decks pass its rule, and how many of these fail it with the
    fault in them. All variants of a deck are made and judged where its rows are."""
    t = tables(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("path")[0] % len(KINDS) + 1).cast("int"))
    t["nodes"] = t["nodes"].withColumn("kind", kind).withColumn("field_types", F.when(F.col("kind") == "field", F.array(F.lit("slidenum"))).otherwise(F.array().cast("array<string>")))
    rules = spark.createDataFrame(fault_rules(), ", ".join(f"{c} {kind}" for c, kind in C.RULE.items()))
    each = C.mutated(rules, C.deck_items(**t))
    return each.groupBy(F.col("id").alias("fault")).agg(F.count(F.lit(1)).alias("decks"), F.count_if("good").alias("positives"), F.count_if(F.col("good") & ~F.col("bad")).alias("killed"))


MUTATIONS = f"""
with {FACTS},
c as (select d, {", ".join(f"count(*) filter (where l_partkey % {len(KINDS)} = {k}) as c_{x}" for k, x in enumerate(KINDS))}, count(*) as total, count(*) filter (where l_linestatus = 'O') as holders from n where s = 1 group by 1),
e as (select df.*, c.* exclude (d), sf.d is not null as first, sf.comic as comic_1, sf.bare, v.ssim from df left join c on c.d = df.d left join sf on sf.d = df.d and sf.s = 1 left join v on v.d = df.d and v.s = 1),
m(fault, good, killed) as ({" union all ".join(f"select 'decrement-{x}-count', coalesce(c_{x}, 0) >= 1, c_{x} = 1 from e" for x in KINDS if x != "shape")}
 union all select 'decrement-shape-count', coalesce(total, 0) >= 1, total = 1 and c_shape = 1 from e
 union all select 'replace-required-text', first, true from e union all select 'remove-required-placeholder', coalesce(holders, 0) >= 1, true from e
 union all select 'substitute-non-bundled-font', first and not comic_1, true from e union all select 'clear-layout-reference', first and not bare, true from e
 union all select 'lower-one-slide-ssim', first and coalesce(ssim, 0) >= 0.9999, true from e union all select 'lower-ssim-below-threshold', coalesce(least_ssim, 0) >= 0.9999, true from e
 union all select 'replace-approved-asset-hash', coalesce(media, '') = '1-URGENT', true from e union all select 'replace-one-approved-asset-hash', coalesce(media, '') = '1-URGENT', false from e
 union all select 'change-exact-slide-count', slides = 4, first from e union all select 'decrement-master-count', status <> 'P', true from e union all select 'decrement-layout-count', true, true from e
 union all select 'add-speaker-notes-relationship', not noted, slides > 0 from e)
select fault, count(*) as decks, count(*) filter (where good) as positives, count(*) filter (where good and killed) as killed from m group by 1"""

QUERIES = {"grade_items": (grade_items, ITEMS), "grade_scores": (grade_scores, SCORES), "grade_flags": (grade_flags, FLAGS), "mutation_matrix": (mutation_matrix, MUTATIONS)}
