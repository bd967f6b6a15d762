"""Text and raster queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import arrow as A
from plumbline.functions import text as T
from plumbline.sources import load, units


def parity_tokens(spark, sf):
    """Whether every turn of a conversation and the turn two later have the same hard tokens, and whether their texts differ."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text", F.array_join(F.array_sort(F.regexp_extract_all("text", F.lit("[0-9]+|[A-Z][a-z]?"), F.lit(0))), " ").alias("tokens"))
    later = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("other"), F.col("tokens").alias("other_tokens"), F.lit(True).alias("there"))
    both = c.join(later, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", F.when(F.col("there"), F.col("tokens").eqNullSafe(F.col("other_tokens"))).alias("same_tokens"), F.when(F.col("there"), ~F.col("text").eqNullSafe(F.col("other"))).alias("texts_differ"))


PARITY = """
with c as (select conv_id, turn, text, array_to_string(list_sort(regexp_extract_all(text, '[0-9]+|[A-Z][a-z]?')), ' ') as tokens from conversations)
select a.conv_id, a.turn, case when b.conv_id is not null then a.tokens is not distinct from b.tokens end as same_tokens, case when b.conv_id is not null then a.text is distinct from b.text end as texts_differ
from c a left join c b on a.conv_id = b.conv_id and b.turn = a.turn + 2"""


def code_blocks(spark, sf):
    """Blocks between quotes-like fences (here ". ") of a text and of its copy without line breaks."""
    d = load(spark, sf, "documents")
    blocks = lambda t: F.regexp_extract_all(t, F.lit("(?s)\\. .*?\\. "), F.lit(0))
    a, b = blocks(F.col("text")), blocks(F.regexp_replace("text", "\n", " "))
    return d.select("doc_id", F.size(a).alias("blocks"), (a == b).alias("same"))


CODE_BLOCKS = """
with b as (select doc_id, regexp_extract_all(text, '(?s)\\. .*?\\. ') as a, regexp_extract_all(replace(text, chr(10), ' '), '(?s)\\. .*?\\. ') as b from documents)
select doc_id, len(a)::int as blocks, a = b as same from b"""


def clause_classify(spark, sf):
    """Mode of every document by its first token class."""
    d = load(spark, sf, "documents")
    mode = T.classify(F.col("text"), [("secret", ("AKIA", "password")), ("legal", ("rights reserved", "license")), ("strict", (" der ", " le ")), ("number", ("1", "2"))], "plain")
    return d.select("doc_id", mode.alias("mode"), T.any_of(F.lower("text"), ("the ", "und ")).alias("common"))


CLAUSE = """
select doc_id, case when contains(text, 'AKIA') or contains(text, 'password') then 'secret' when contains(text, 'rights reserved') or contains(text, 'license') then 'legal'
 when contains(text, ' der ') or contains(text, ' le ') then 'strict' when contains(text, '1') or contains(text, '2') then 'number' else 'plain' end as mode,
 contains(lower(text), 'the ') or contains(lower(text), 'und ') as common from documents"""


def strip_markup(spark, sf):
    """Length and hash of the text of every page, hash of its whole markup escaped."""
    t = T.strip_tags(F.col("html"))
    return load(spark, sf, "pages").select("page_id", F.length(t).alias("n_chars"), F.sha2(t, 256).alias("sha"), F.sha2(T.html_escape(F.col("html")), 256).alias("escaped_sha"))


STRIP = """
with t as (select page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as t from pages)
select page_id, length(t)::int as n_chars, sha256(t) as sha,
 sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) as escaped_sha from t"""


def unitize_lines(spark, sf):
    """Lines of documents as requirements: class, number within the document, id."""
    l = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).filter("trim(t) <> ''")  # noqa: E741
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    kind = F.when(F.col("t").contains(" | "), "table").when(F.col("t").rlike("^[-*#] ?"), "list").when(F.length("t") < 40, "short").otherwise("paragraph")
    return l.select("doc_id", (F.col("line") + 1).alias("line"), kind.alias("kind"), n.alias("n")).withColumn("id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".prompt-r"), F.expr("lpad(cast(n as string), greatest(3, length(cast(n as string))), '0')")))


UNITIZE = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1)::int as line from documents),
n as (select *, (row_number() over (partition by doc_id order by line))::int as n from l where trim(t, ' ') <> '')
select doc_id, line, case when contains(t, ' | ') then 'table' when regexp_matches(t, '^[-*#] ?') then 'list' when length(t) < 40 then 'short' else 'paragraph' end as kind, n, 'd' || doc_id || '.prompt-r' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') as id
from n"""


#: Forms of the lines of a prompt made from an order, by l_partkey % 16; {k} is the part.
FORMS = ("# Part {k}", "**Label {k}:**", "| a | {k} |", "|---|:--:|", "- item {k} MUST", "1. **Inline {k}:** native `x`", "   - nested {k}", "```", "", "prose {k} font", "more **bold** {k}",
         "| open {k}", "**Why this slide is hard: {k}", "The natural-language requirements below {k}", "**Tier: {k}**", "* star {k}")


def prompt_units(spark, sf):
    """Every order as a Markdown prompt, a line for each of its items: its units as the library's unitizer reads them."""
    part = F.col("l_partkey").cast("string")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("l_partkey") % len(FORMS) + 1).cast("int"))
    lines = load(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.replace(form, F.lit("{k}"), part).alias("line")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    found = units.requirements(units.units(lines.groupBy("l_orderkey").agg(text.alias("text")), "text", ["l_orderkey"]), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")))
    return found.select("l_orderkey", "requirement_id", "line_start", "line_end", "kind", "statement", "mode", "severity", "source_of_truth", "excerpt_sha256")


_CASES = " ".join(f"when {k} then '" + f.replace("{k}", "' || l_partkey || '") + "'" for k, f in enumerate(FORMS))
_HAS = lambda words, s: " or ".join(f"contains({s}, '{w}')" for w in words)
PROMPT_UNITS = f"""
with l as (select l_orderkey as o, l_partkey as k, l_partkey % 16 as f, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as pos, case l_partkey % 16 {_CASES} end as line from lineitem
  qualify not (f = 8 and pos = count(*) over (partition by l_orderkey))),
a as (select *, sum(case when f = 7 then 1 else 0 end) over (partition by o order by pos) % 2 = 1 as odd from l),
b as (select *, case when odd and f <> 7 then 'inside' when f = 7 then case when odd then 'fence' else 'close' end when f in (0, 8, 14) then 'none' when f = 1 then 'label' when f = 2 then 'row' when f = 3 then 'divider'
  when f in (4, 5, 6, 15) then 'item' when f in (12, 13) then 'loose' when f = 11 then 'bar' else 'prose' end as kind from a),
c as (select *, coalesce(last_value(case when kind <> 'loose' then kind in ('prose', 'bar') end ignore nulls) over (partition by o order by pos rows between unbounded preceding and current row), false) as para, lead(kind) over (partition by o order by pos) as nx from b),
d as (select *, bool_or(kind = 'loose' and f = 12 and not para) over (partition by o order by pos rows between unbounded preceding and current row) as done, coalesce(lag(para) over (partition by o order by pos), false) as on_, kind = 'row' and coalesce(nx = 'divider', false) as head from c),
e as (select *, last_value(case when kind = 'label' then 'Label ' || k when head then 'a / ' || k when f = 5 and kind = 'item' then 'Inline ' || k end ignore nulls) over (partition by o order by pos rows between unbounded preceding and 1 preceding) as ctx,
  kind in ('fence', 'item') or (kind = 'row' and not head) or (para and (kind = 'bar' or not on_)) as start from d where not done),
g as (select *, sum(case when start then 1 else 0 end) over (partition by o order by pos) as u from e),
u as (select o, u, min(pos)::int as line_start, max(pos)::int as line_end, arg_min(f, pos) as f, arg_min(k, pos) as k, arg_min(kind, pos) as kind, bool_or(para) as para, arg_max(kind, pos) = 'close' as closed, arg_min(ctx, pos) as ctx,
  string_agg(line, chr(10) order by pos) as excerpt, string_agg(case when kind = 'inside' then line end, chr(10) order by pos) as body from g where start or para or kind in ('inside', 'close') group by o, u),
s as (select *, row_number() over (partition by o order by u)::int as n, coalesce(ctx || ': ', '') as pre from u),
t as (select *, case when kind = 'row' then pre || 'Use this exact table data row: | a | ' || k || ' |' when kind = 'item' and f = 4 then 'item ' || k || ' MUST' when kind = 'item' and f = 5 then 'Inline ' || k || ': native `x`' when kind = 'item' and f = 6 then pre || 'nested ' || k
  when kind = 'item' then 'star ' || k when kind = 'fence' and closed then 'Use this fenced prompt content as directed' || coalesce(' for ' || ctx, '') || ':' || chr(10) || regexp_replace(coalesce(body, ''), '^\n+|\n+$', '', 'g')
  when para then trim(replace(excerpt, '**', ''), ' ' || chr(10)) end as statement from s)
select o as l_orderkey, 'o' || o || '.prompt-r' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') as requirement_id, line_start, line_end,
  case when para then 'paragraph' when kind = 'fence' and not closed then 'unterminated fence' else kind end as kind, statement,
  case when {_HAS(units.EXACT, 'statement')} then 'exact' else 'structural_semantic' end as mode,
  case when {_HAS(units.CRITICAL, 'statement')} or contains(lower(statement), 'native') then 'critical' else 'major' end as severity,
  case when ({_HAS(units.STRUCTURAL, 'lower(statement)')}) and not ({_HAS(units.VISUAL, 'lower(statement)')}) then 'ooxml' else 'both' end as source_of_truth, sha256(excerpt) as excerpt_sha256 from t"""


def hard_tokens(spark, sf):
    """Hard tokens of documents."""
    t = T.hard_tokens(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


HARD = """
with t as (select doc_id, list_sort(regexp_extract_all(text, '#[0-9A-Fa-f]{6}|[A-Za-z0-9_-]+\\.(?:png|pptx)|[0-9]+(?:\\.[0-9]+)?(?:cm|pt|px|mm|%|°|×)|`[^`\\n]+`|"[^"\\n]+"|[\\x{0600}-\\x{06ff}]+|[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]+')) as t from documents)
select doc_id, len(t)::int as n, array_to_string(t, ' ') as tokens from t"""


def paraphrase(spark, sf):
    """Words replaced in order, but not within code spans (here between | and |)."""
    d = load(spark, sf, "documents").select("doc_id", F.regexp_replace("text", " \\| ", "`").alias("t"))
    return d.select("doc_id", F.sha2(T.protected_replace(F.col("t"), [("the", "a"), ("a", "one")]), 256).alias("sha"), F.size(F.regexp_extract_all("t", F.lit("`[^`]*`"), F.lit(0))).alias("spans"))


PARAPHRASE = """
with d as (select doc_id, replace(text, ' | ', '`') as t from documents),
p as (select doc_id, string_split_regex(t, '`[^`]*`') as b, regexp_extract_all(t, '`[^`]*`') as s from d)
select doc_id, sha256(array_to_string(list_transform(range(1, len(b) + 1), lambda i: replace(replace(b[i], 'the', 'a'), 'a', 'one') || coalesce(s[i], '')), '')) as sha, len(s)::int as spans from p"""


def pairs(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id")


def vector_exact(spark, sf):
    """Neighbouring rasters: equal, and the largest amplified difference."""
    diff = F.array_max(F.zip_with("embedding", "other", lambda a, b: F.least(F.abs(a.cast("double") - b.cast("double")) * 10, F.lit(255.0))))
    return pairs(spark, sf).select("vec_id", (F.col("embedding") == F.col("other")).alias("exact"), F.round(diff, 6).alias("largest"))


VECTOR_EXACT = """
with p as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id - 1)
select vec_id, a = b as exact, round(list_max(list_transform(range(1, len(a) + 1), lambda i: least(abs(a[i] - b[i]) * 10, 255))), 6) as largest from p"""


def ssim_global(spark, sf):
    """SSIM with one window over the whole raster."""
    x = pairs(spark, sf).select("vec_id", F.explode(F.zip_with("embedding", "other", lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))).alias("p")).select("vec_id", "p.a", "p.b")
    g = x.groupBy("vec_id").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("ab"))
    s = (2 * F.col("ma") * F.col("mb") + 0.0001) * (2 * F.col("ab") + 0.0009) / ((F.pow("ma", F.lit(2)) + F.pow("mb", F.lit(2)) + 0.0001) * (F.col("va") + F.col("vb") + 0.0009))
    return g.select("vec_id", F.round(s, 6).alias("ssim"))


SSIM_GLOBAL = """
with p as (select a.vec_id, unnest(a.embedding)::double as a, unnest(b.embedding)::double as b from embeddings a join embeddings b on b.vec_id = a.vec_id - 1),
g as (select vec_id, avg(a) as ma, avg(b) as mb, var_samp(a) as va, var_samp(b) as vb, covar_samp(a, b) as ab from p group by 1)
select vec_id, round((2 * ma * mb + 0.0001) * (2 * ab + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009)), 6) as ssim from g"""


def ssim_window(spark, sf):
    """SSIM with 7 x 7 windows over 8 x 8 rasters (Arrow batches)."""
    return pairs(spark, sf).select("vec_id", F.round(A.ssim_of(8, 1.0)("embedding", "other"), 6).alias("ssim"))


SSIM_WINDOW = """
with p as (select a.vec_id, generate_subscripts(a.embedding, 1) - 1 as i, unnest(a.embedding)::double as x, unnest(b.embedding)::double as y from embeddings a join embeddings b on b.vec_id = a.vec_id - 1),
w as (select vec_id, dx, dy, avg(x) as ma, avg(y) as mb, var_samp(x) as va, var_samp(y) as vb, covar_samp(x, y) as ab from p, (values (0, 0), (0, 1), (1, 0), (1, 1)) as t(dx, dy)
 where i % 8 between dx and dx + 6 and i // 8 between dy and dy + 6 group by all)
select vec_id, round(avg((2 * ma * mb + 0.0001) * (2 * ab + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009))), 6) as ssim from w group by vec_id"""


def format_checks(spark, sf):
    """Hashes, timestamps and exact ratios as texts, with some that are malformed."""
    o = load(spark, sf, "orders")
    sha = F.concat(F.lit("sha256:"), F.when(F.col("o_orderkey") % 5 == 0, F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256))).otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256)))
    ts = F.concat(T.utc_text(F.col("o_orderdate")), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""))
    return o.select("o_orderkey", T.is_sha256(sha).alias("sha_ok"), T.is_utc(ts).alias("time_ok"), T.exact_ratio(F.col("o_custkey"), 8).alias("ratio"))


FORMATS = """
select o_orderkey, o_orderkey % 5 <> 0 as sha_ok, o_orderkey % 7 <> 0 as time_ok, regexp_replace(regexp_replace((o_custkey::decimal(30, 3) / 8)::decimal(38, 3)::varchar, '0+$', ''), '\\.$', '') as ratio from orders"""

QUERIES = {
    "parity_tokens": (parity_tokens, PARITY),
    "code_blocks": (code_blocks, CODE_BLOCKS),
    "clause_classify": (clause_classify, CLAUSE),
    "strip_markup": (strip_markup, STRIP),
    "unitize_lines": (unitize_lines, UNITIZE),
    "prompt_units": (prompt_units, PROMPT_UNITS),
    "hard_tokens": (hard_tokens, HARD),
    "paraphrase": (paraphrase, PARAPHRASE),
    "vector_exact": (vector_exact, VECTOR_EXACT),
    "ssim_global": (ssim_global, SSIM_GLOBAL),
    "ssim_window": (ssim_window, SSIM_WINDOW),
    "format_checks": (format_checks, FORMATS),
}
