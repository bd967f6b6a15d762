"""Evidence, constraint and identity queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import evidence as E
from plumbline.plans.rules import NODES, nodes
from plumbline.sources import load


def pair_matrix(spark, sf):
    """All pairs of vectors of a label; least cosine for each first vector, label, and in all."""
    rows = E.cosine_minima(load(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return E.pair_minima(rows, [["label", "run_a"], ["label"], []], "minimum", pairs="pairs")


PAIR_MATRIX = """
with e as (select vec_id, label, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
p as (select a.label, a.vec_id as run_a, list_dot_product(a.v, b.v) / (a.n * b.n) as score from e a join e b on a.label = b.label and a.vec_id < b.vec_id)
select label, run_a, round(min(score), 6) as minimum, count(*) as pairs, grouping(label, run_a) as level from p group by grouping sets ((label, run_a), (label), ())"""


def matrix_completeness(spark, sf):
    """Whether every label has n (n - 1) / 2 pairs in a matrix that lacks those of a sum divisible by 400.

    What is lacking is counted by residues: a runs meet those of 400 - a, and runs of 0 and 200 each other.
    """
    r = load(spark, sf, "embeddings").groupBy("label", F.expr("vec_id % 400").alias("r")).agg(F.count(F.lit(1)).alias("c"))
    other = r.select("label", F.expr("(400 - r) % 400").alias("r"), F.col("c").alias("d"))
    lost = F.when(F.col("r") % 200 == 0, F.expr("c * (c - 1) div 2")).when(F.col("r") < 200, F.expr("c * coalesce(d, 0)")).otherwise(0)
    g = r.join(other, ["label", "r"], "left").groupBy("label").agg(F.sum("c").alias("runs"), F.sum(lost).alias("lost"))
    return g.select("label", "runs", F.expr("runs * (runs - 1) div 2 - lost").alias("pairs"), (F.col("lost") == 0).alias("complete"))


COMPLETENESS = """
with p as (select a.label, count(*) as pairs from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where (a.vec_id + b.vec_id) % 400 <> 0 group by 1)
select label, count(*) as runs, coalesce(any_value(pairs), 0) as pairs, coalesce(any_value(pairs), 0) = count(*) * (count(*) - 1) // 2 as complete from embeddings left join p using (label) group by label"""


def hash_chain(spark, sf):
    """Turns as a chain of releases; those with turn % 5 = 3 are lost."""
    c = load(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("previous", F.lag(F.sha2("text", 256)).over(w)).filter("turn % 5 <> 3")
    return E.chain_breaks(c, ["conv_id"], "turn", F.sha2("text", 256), "previous").select("conv_id", "turn", "gap", "broken")


HASH_CHAIN = """
with a as (select *, lag(sha256(text)) over (partition by conv_id order by turn) as previous from conversations),
b as (select *, lag(sha256(text)) over w as h, lag(turn) over w as t from a where turn % 5 <> 3 window w as (partition by conv_id order by turn))
select conv_id, turn, coalesce(turn <> t + 1, false) as gap, previous is distinct from h as broken from b"""


def approvals(spark, sf):
    """At least two approvals by different roles that agree on whether the text ends in a full stop."""
    c = load(spark, sf, "conversations").withColumn("v", F.col("text").endswith("."))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("reviewers"), (F.min("v") == F.max("v")).alias("agree")).withColumn("approved", (F.col("reviewers") >= 2) & F.col("agree"))


APPROVALS = """
select conv_id, count(*) as n, count(distinct role) as reviewers, min(text like '%.') = max(text like '%.') as agree, count(distinct role) >= 2 and min(text like '%.') = max(text like '%.') as approved
from conversations group by conv_id"""


def unique_violations(spark, sf):
    """Natural keys of nodes that aren't unique."""
    return E.duplicates(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


UNIQUE = "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1"


def severity_mix(spark, sf):
    """Counts of each severity against the exact mix."""
    p = load(spark, sf, "part").select(F.element_at(F.array(*map(F.lit, ("critical", "major", "minor", "informational"))), (F.col("p_size") % 4 + 1).cast("int")).alias("severity"), "p_brand")
    g = p.groupBy("p_brand").pivot("severity", ["critical", "major", "minor", "informational"]).count().fillna(0)
    return g.withColumn("balanced", F.greatest("critical", "major", "minor", "informational") <= 2 * F.least("critical", "major", "minor", "informational"))


SEVERITY_MIX = """
with g as (select p_brand, count(*) filter (where p_size % 4 = 0) as critical, count(*) filter (where p_size % 4 = 1) as major, count(*) filter (where p_size % 4 = 2) as minor, count(*) filter (where p_size % 4 = 3) as informational from part group by 1)
select *, greatest(critical, major, minor, informational) <= 2 * least(critical, major, minor, informational) as balanced from g"""


def manifest_hashes(spark, sf):
    """Documents against a manifest that is wrong for every 31st and lacks every 37th."""
    d = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("actual"))
    m = d.filter("doc_id % 37 <> 5").select("doc_id", F.when(F.col("doc_id") % 31 == 3, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise(F.col("actual")).alias("wanted"))
    j = d.join(m, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("wanted").isNull(), "unlisted").when(F.col("wanted") != F.col("actual"), "mismatch").otherwise("ok").alias("state"))


MANIFEST = "select doc_id, case when doc_id % 37 = 5 then 'unlisted' when doc_id % 31 = 3 then 'mismatch' else 'ok' end as state from documents"


def excerpt_check(spark, sf):
    """Excerpts (lines 1 to 2) of every text against what was recorded; turns divisible by 7 differ."""
    c = load(spark, sf, "conversations")
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "t")).filter("line between 1 and 2")
    e = lines.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("e"))
    want = F.concat(F.expr("array_join(slice(split(text, '\n'), 2, 2), '\n')"), F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "x").otherwise(""))
    j = c.join(e, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", F.sha2(F.coalesce("e", F.lit("")), 256).alias("sha"), (F.coalesce("e", F.lit("")) == want).alias("matches"))


EXCERPT = """
with e as (select conv_id, turn, array_to_string(string_split(text, chr(10))[2:3], chr(10)) as e from conversations)
select conv_id, turn, sha256(e) as sha, (conv_id + turn) % 7 <> 0 as matches from e"""


def content_type_resolve(spark, sf):
    """Content type of pages: an override for some, else by extension, else an error."""
    parts = load(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]+", "").alias("part_name"))
    over = parts.filter("page_id % 9 = 0").select("part_name").distinct().withColumn("content_type", F.lit("text/override"))
    base = spark.createDataFrame([("html", "text/html"), ("xml", "application/xml")], "extension string, content_type string")
    out = E.content_type(parts, over, base)
    return out.select("page_id", "content_type", F.col("content_type").isNull().alias("unresolved"))


CONTENT_TYPE = """
with p as (select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+', '') as part from pages),
t as (select page_id, case when part in (select part from p where page_id % 9 = 0) then 'text/override' when lower(regexp_extract(part, '\\.([^./]+)$', 1)) = 'html' then 'text/html'
 when lower(regexp_extract(part, '\\.([^./]+)$', 1)) = 'xml' then 'application/xml' end as content_type from p)
select page_id, content_type, content_type is null as unresolved from t"""

EDGES = "(select p_partkey // 4 as source, p_partkey as target from part where p_partkey > 0 and p_partkey % 13 <> 5)"


def reachable_parts(spark, sf):
    """Orphans of the part tree (parent = key / 4) after edges to every key with key % 13 = 5 are cut."""
    p = load(spark, sf, "part").select("p_partkey")
    e = p.filter("p_partkey > 0 and p_partkey % 13 <> 5").select(F.expr("p_partkey div 4").alias("source"), F.col("p_partkey").alias("target"))
    found = E.reachable(spark, e, p.filter("p_partkey = 0").select(F.col("p_partkey").alias("node")))
    return p.join(found, F.col("p_partkey") == F.col("node"), "left_anti").select("p_partkey")


REACHABLE = f"""
with recursive e as {EDGES}, r(node) as (select 0::bigint union select target from e join r on source = node)
select p_partkey from part where p_partkey not in (select node from r)"""


def tree_paths(spark, sf):
    """Path, depth and descendants in the part tree (parent = key / 4, key 0 is the root)."""
    p = load(spark, sf, "part").select("p_partkey")
    up = F.filter(F.array(*(F.shiftrightunsigned(F.col("p_partkey").cast("long"), 2 * k) for k in range(32))), lambda x: x > 0)
    t = p.withColumn("up", up)
    below = t.select(F.explode(F.array_union(F.col("up"), F.array(F.lit(0).cast("long")))).alias("a"), "p_partkey").filter("a <> p_partkey").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    z = Window.partitionBy(F.expr("p_partkey div 4"), F.col("p_partkey") == 0).orderBy("p_partkey")
    t = t.withColumn("z_index", F.row_number().over(z) - 1)
    return t.join(below, F.col("p_partkey") == F.col("a"), "left").select("p_partkey", F.array_join(F.concat(F.array(F.lit("0")), F.transform(F.reverse("up"), lambda x: x.cast("string"))), ".").alias("path"), F.size("up").alias("depth"), "z_index", F.coalesce("n", F.lit(0)).alias("descendants"))


TREE_PATHS = """
with recursive r as (select p_partkey, '0' as path, 0 as depth from part where p_partkey = 0
 union all select p.p_partkey, r.path || '.' || p.p_partkey, r.depth + 1 from part p join r on p.p_partkey // 4 = r.p_partkey and p.p_partkey > 0)
select p_partkey, path, depth, (row_number() over (partition by p_partkey // 4, p_partkey = 0 order by p_partkey) - 1)::int as z_index,
 (select count(*) from r x where starts_with(x.path, r.path || '.')) as descendants from r"""


def dup_detection(spark, sf):
    """Byte duplicate, duplicate after normalization (letters and digits only), or clear; null texts are empty ones."""
    d = load(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", F.sha2("text", 256).alias("raw"), F.sha2(F.regexp_replace(F.lower(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" !"))).otherwise(F.col("text"))), "[ .,!?\n]+", ""), 256).alias("norm"), F.col("doc_id") % 11 == 0)
    r = d.groupBy("raw").agg(F.count(F.lit(1)).alias("n_raw"))
    n = d.groupBy("norm").agg(F.count(F.lit(1)).alias("n_norm"))
    return d.join(r, "raw").join(n, "norm").select("doc_id", F.when(F.col("n_raw") > 1, "byte_duplicate").when(F.col("n_norm") > 1, "normalized_duplicate").otherwise("clear").alias("decision"))


DUP = """
with t as (select doc_id, coalesce(text, '') as text from documents),
d as (select doc_id, sha256(text) as raw, sha256(regexp_replace(lower(case when doc_id % 11 = 0 then text || ' !' else text end), '[ .,!?\n]+', '', 'g')) as norm from t)
select doc_id, case when count(*) over (partition by raw) > 1 then 'byte_duplicate' when count(*) over (partition by norm) > 1 then 'normalized_duplicate' else 'clear' end as decision from d"""


def ordered_digest(spark, sf):
    """Digest of the nodes of an order as a package: part name by ordinal, content by flags."""
    n = nodes(spark, sf).select("l_orderkey", F.concat(F.lit("part"), F.lpad(F.col("ordinal").cast("string"), 4, "0")).alias("name"), F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("content"))
    return E.ordered_digest(n, ["l_orderkey"], "name", F.col("content"), "package-v1\n")


ORDERED_DIGEST = f"""
with n as (select l_orderkey, 'part' || lpad(ordinal::varchar, 4, '0') as name, l_returnflag || l_linestatus || l_partkey as content from {NODES})
select l_orderkey, 'sha256:' || sha256('package-v1' || chr(10) || string_agg(strlen(name) || ':' || name || strlen(content) || ':' || content, '' order by name)) as digest, count(*) as parts from n group by 1"""


def cohort_id(spark, sf):
    """Hash of the canonical JSON (sorted keys, strings only) of a descriptor."""
    o = load(spark, sf, "orders")
    doc = F.to_json(F.struct(F.col("o_orderpriority").alias("benchmark"), F.col("o_custkey").cast("string").alias("model"), F.col("o_orderstatus").alias("status"), F.lit("3").alias("tier")))
    return o.select("o_orderkey", F.concat(F.lit("sha256:"), F.sha2(doc, 256)).alias("cohort"))


COHORT = """select o_orderkey, 'sha256:' || sha256('{"benchmark":"' || o_orderpriority || '","model":"' || o_custkey || '","status":"' || o_orderstatus || '","tier":"3"}') as cohort from orders"""


QUERIES = {
    "pair_matrix": (pair_matrix, PAIR_MATRIX),
    "matrix_completeness": (matrix_completeness, COMPLETENESS),
    "hash_chain": (hash_chain, HASH_CHAIN),
    "approvals": (approvals, APPROVALS),
    "unique_violations": (unique_violations, UNIQUE),
    "severity_mix": (severity_mix, SEVERITY_MIX),
    "manifest_hashes": (manifest_hashes, MANIFEST),
    "excerpt_check": (excerpt_check, EXCERPT),
    "content_type_resolve": (content_type_resolve, CONTENT_TYPE),
    "reachable_parts": (reachable_parts, REACHABLE),
    "tree_paths": (tree_paths, TREE_PATHS),
    "dup_detection": (dup_detection, DUP),
    "ordered_digest": (ordered_digest, ORDERED_DIGEST),
    "cohort_id": (cohort_id, COHORT),
}
