"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

A source's documents in hashed order are cut into blocks of equal numbers of words (the last may be
shorter): 1 / SLOTS of all words each, or LEAST_BLOCKS to a target where that is less, one word at
least. A source needs as many slots as blocks reach its target, walking through them again and again;
the last slot is cut to the word. The sources' slots lie one after another on [0, 1). Slot k of the
schedule is the point frac((k + 1/2) * golden ratio) and belongs to the source whose interval it falls
in, so that a source's share is met within a few slots in every stretch. The slots of a source are
ranked; those beyond its number are left out, and the few that the points leave a source short of come
at the end. Only DataFrame operations run, and the same ones for every source.

Any number of sources may be there: what is summed over all of them in an order (targets, places
on [0, 1)) is summed within ranges of the order first, then over the ranges.

Rows: nulls in text count as 0 words, a null source is a source of its own (last), rows without a
doc_id are ordered by the hash of their text. Repeated rows are separate documents. An empty table
gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACED_WORD, checkpoint, size_checked

#: Slots in a schedule at most; a block holds 1 / SLOTS of all words, 1 word at least.
SLOTS = 1 << 18
#: Blocks in a source's target at least, while a block has a word.
LEAST_BLOCKS = 16
#: Blocks that are broadcast at most: those of the schedule, and of a good many small sources.
MOST_BLOCKS = 2 * SLOTS
#: Rows of a source that one task puts in order, on average.
ROWS_PER_BUCKET = 50_000
GOLDEN = 0.6180339887498949
CYCLE = (1, 2, 3)
MOST_TIMES = 3
BINS = 4096
CHUNK_BITS = 12


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, _src (source, nulls last), size (words), _at (place in the hashed order)."""
    known = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("_src"), word_count("text").alias("size"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return known.withColumn("_at", F.md5(F.concat_ws(":", name, F.col("size").cast("string")))).drop("text")


def ordered(df: DataFrame, order: list[str], **sums) -> DataFrame:
    """Adds _k (place in the order, from 1) and, by name, the sum of a column over the rows before.

    Rows are dealt by ranges of the order and summed within each; only a row for each range is summed
    in one task.
    """
    dealt = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_all_{x}") for x, c in sums.items()))
    up_to = Window.orderBy("_range")
    ahead = ranges.select("_range", (F.sum("_n").over(up_to) - F.col("_n")).alias("_ahead"), *((F.sum(f"_all_{x}").over(up_to) - F.col(f"_all_{x}")).alias(f"_ahead_{x}") for x in sums))
    within = Window.partitionBy("_range").orderBy(*order)
    out = dealt.withColumns({"_k": F.row_number().over(within)} | {x: F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(c) for x, c in sums.items()})
    out = out.join(F.broadcast(ahead), "_range")  # as many rows as ranges
    return out.select(*df.columns, (F.col("_k") + F.col("_ahead")).alias("_k"), *((F.col(x) + F.col(f"_ahead_{x}")).alias(x) for x in sums))


def targets(totals: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_TIMES) -> DataFrame:
    """Adds weight and target to (_src, source_size), one row per source.

    Water filling in closed form: in order of most * size / weight, sources are full until the
    level that the rest shares by weight is not above.
    """
    w = F.element_at(F.array(*map(F.lit, cycle)), ((F.col("_k") - 1) % len(cycle) + 1).cast("int"))
    ranked = ordered(totals, ["_src"]).withColumn("weight", w).drop("_k")
    ranked = ranked.withColumns({"_ratio": most * F.col("source_size") / F.col("weight"), "_most": most * F.col("source_size")})
    found = checkpoint(ordered(ranked, ["_ratio", "_src"], _full="_most", _lighter="weight"))
    words, weights = found.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words:
        return found.withColumn("target", F.lit(0.0)).select("_src", "source_size", "weight", "target")
    share = (F.lit(words) - F.col("_full")) / (F.lit(weights) - F.col("_lighter"))
    level = found.filter(F.col("_ratio") >= share).agg(F.min_by(share, "_k")).first()[0]
    return found.withColumn("target", F.least(F.col("_most").cast("double"), F.col("weight") * F.lit(level))).select("_src", "source_size", "weight", "target")


def before(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of a source's values before each row, by a whole number `order`.

    In two levels: within chunks of the order, after the sums of earlier chunks. A source's rows
    needn't go through one task.
    """
    df = df.withColumn("_chunk", F.shiftright(order, CHUNK_BITS))
    earlier = Window.partitionBy("_src").orderBy("_chunk")
    chunks = df.groupBy("_src", "_chunk").agg(F.sum(value).alias("_all"))
    chunks = chunks.select("_src", "_chunk", (F.sum("_all").over(earlier) - F.col("_all")).alias("_earlier"))
    own = F.sum(value).over(Window.partitionBy("_src", "_chunk").orderBy(order)) - F.col(value)
    return df.withColumn(out, own).join(chunks, ["_src", "_chunk"]).withColumn(out, F.col(out) + F.col("_earlier")).drop("_chunk", "_earlier")


def planned(sources: DataFrame, block: int) -> DataFrame:
    """Adds goal (words), block (words in one of the source's), blocks, part (words of the last, begun pass) and slots."""
    goal = F.round("target").cast("long")
    own = F.greatest(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.ceil(goal / LEAST_BLOCKS)))
    sources = sources.withColumn("goal", goal).withColumn("block", own)
    part = F.expr("goal % greatest(source_size, 1)")
    sources = sources.withColumns({"blocks": F.expr("(source_size + block - 1) div block"), "part": part})
    return sources.withColumn("slots", F.expr("(goal div greatest(source_size, 1)) * blocks + (part + block - 1) div block"))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, _src, rank): rank counts a source's slots from 0 up to its number of slots."""
    goals = ordered(sources.select("_src", "slots").filter("slots > 0"), ["_src"], _before="slots")
    total = goals.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    share = lambda c: c / F.lit(max(1, total))
    cut = goals.select("_src", share(F.col("_before")).alias("_lo"), share(F.col("_before") + F.col("slots")).alias("_hi"))
    cut = cut.select("_src", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * BINS), F.least(F.floor(F.col("_hi") * BINS), F.lit(BINS - 1)))).alias("_bin"))
    point = (F.col("id") + 0.5) * GOLDEN
    points = sources.sparkSession.range(total).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("_u")).withColumn("_bin", F.floor(F.col("_u") * BINS))
    met = points.join(cut, (points["_bin"] == cut["_bin"]) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("slot", "_src")
    ranks = checkpoint(before(met.withColumn("_one", F.lit(1).cast("long")), "slot", "_one", "rank").select("slot", "_src", "rank"))
    given = ranks.groupBy("_src").agg(F.count(F.lit(1)).alias("_given"))
    short = sources.select("_src", "slots").join(given, "_src", "left").withColumn("_given", F.coalesce("_given", F.lit(0))).filter("_given < slots")
    late = short.select("_src", F.explode(F.sequence("_given", F.col("slots") - 1)).alias("rank")).select((F.lit(total) + F.col("rank")).alias("slot"), "_src", "rank")
    return ranks.join(sources.select("_src", "slots"), "_src").filter("rank < slots").select("slot", "_src", "rank").unionByName(late)


def taken_blocks(sources: DataFrame) -> DataFrame:
    """_src, _block, _times (slots that take it), _cut (where the last slot ends, in its block) and _sum (words taken of the blocks before)."""
    slots = schedule(sources).join(sources.select("_src", "blocks"), "_src")
    counts = slots.groupBy("_src", (F.col("rank") % F.col("blocks")).alias("_block")).agg(F.count(F.lit(1)).alias("_times"))
    every = sources.filter("source_size > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = every.join(counts, ["_src", "_block"], "left").fillna(0, ["_times"])
    start = F.col("_block") * F.col("block")
    end = F.least(start + F.col("block"), F.col("source_size"))
    every = every.withColumn("_cut", F.when((F.col("part") > start) & (F.col("part") < end), F.col("part")))
    words = F.col("_times") * (end - start) - F.coalesce(end - F.col("_cut"), F.lit(0))
    return before(every.withColumn("_words", words), "_block", "_words", "_sum").select("_src", "_block", "_times", "_cut", "_sum")


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_TIMES, slots: int = SLOTS) -> DataFrame:
    """doc_id, source key, size, source_size, target and taken of every document."""
    slim = checkpoint(sized(docs))
    rows, words = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = 0
    while rows > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    slim = slim.withColumn("_bucket", F.substring("_at", 1, digits))

    # Prefix sums in two levels: the buckets of a source, then the rows of a bucket.
    buckets = checkpoint(slim.groupBy("_src", "_bucket").agg(F.sum("size").alias("_words")))
    totals = targets(buckets.groupBy("_src").agg(F.sum("_words").alias("source_size")), cycle, most)
    sources = checkpoint(planned(totals, max(1, -(-words // slots))))
    up_to = Window.partitionBy("_src").orderBy("_bucket")
    buckets = buckets.select("_src", "_bucket", (F.sum("_words").over(up_to) - F.col("_words")).alias("_ahead")).join(sources.select("_src", "source_size", "target", "block"), "_src")
    blocks = checkpoint(taken_blocks(sources))
    n = blocks.count()

    within = Window.partitionBy("_src", "_bucket").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.withColumn("_end", F.sum("size").over(within)).join(buckets, ["_src", "_bucket"])
    placed = placed.withColumn("_end", F.col("_end") + F.col("_ahead")).withColumn("_start", F.col("_end") - F.col("size"))
    nowhere = -1 - F.pmod(F.xxhash64("doc_id"), F.lit(1000))  # documents without words, spread over tasks
    for side, at in (("a", "_start"), ("b", "_end - 1")):
        placed = placed.withColumn(f"_block_{side}", F.when(F.col("size") > 0, F.expr(f"({at}) div block")).otherwise(nowhere))
        of = blocks.select("_src", *(F.col(c).alias(f"{c}_{side}") for c in ("_block", "_times", "_cut", "_sum")))
        placed = placed.join(size_checked(of, n, MOST_BLOCKS), ["_src", f"_block_{side}"], "left")

    def reach(side: str, at):
        """Words taken of a source up to a place in a block."""
        over = F.coalesce(F.greatest(at - F.col(f"_cut_{side}"), F.lit(0)), F.lit(0))
        return F.col(f"_sum_{side}") + F.col(f"_times_{side}") * (at - F.col(f"_block_{side}") * F.col("block")) - over

    taken = F.coalesce(reach("b", F.col("_end")) - reach("a", F.col("_start")), F.lit(0))
    return placed.select("doc_id", "_src", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Mixes all documents with source weights 1, 2, 3, repeating."""
    from plumbline.llm.common import documents

    return mix(documents(spark, sf_dir)).drop("_src")


SQL = f"""
with d as (select doc_id, case when source is null then '~' else '=' || source end as src,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, text from documents),
h as (select *, md5(concat_ws(':', coalesce(doc_id::varchar, md5(coalesce(text, ''))), size::varchar)) as place from d),
s0 as (select src, sum(size)::bigint as source_size from d group by src),
s1 as (select *, [1, 2, 3][(row_number() over (order by src) - 1) % 3 + 1] as weight from s0),
s2 as (select *, 3 * source_size / weight as ratio from s1),
s3 as (select *, row_number() over (order by ratio, src) as k, (sum(source_size) over ()
    - coalesce(sum(3 * source_size) over (order by ratio, src rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by ratio, src rows between current row and unbounded following))::double as level from s2),
s4 as (select src, source_size, least(3.0::double * source_size, weight * (select arg_min(level, k) from s3 where ratio >= level)) as target from s3),
m as (select src, source_size, target, round(target)::bigint // greatest(source_size, 1) as passes, round(target)::bigint % greatest(source_size, 1) as part from s4),
q as (select doc_id, src, size, sum(size) over (partition by src order by place, doc_id nulls first, size rows between unbounded preceding and current row)::bigint as e from h)
select doc_id, size, source_size, target, (passes * size + least(e, part) - least(e - size, part))::bigint as taken
from q join m using (src)"""
