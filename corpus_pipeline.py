"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what stays, with
the columns of documents; the last adds the shard. run() writes each result to the shared folder
and reads it again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, jaccard, language, mixing, sharding
from plumbline.llm.common import checkpoint, shared_folder, size_checked, unused
from plumbline.sources import load

#: Word shingles and similarity (percent) of near duplicates.
WIDTH, PERCENT = 5, 80
#: Documents whose language is less certain than this go.
MIN_LANGUAGE_SCORE = 0.3


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with columns of these names renamed, and what selects all columns under their own names."""
    new = dict(zip(names, unused(docs, *names), strict=True))
    return docs.withColumnsRenamed(new), [F.col(new.get(c, c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null ones too) and those of no clear language; the model learns from
    docs' own lang. Repeated rows are judged by themselves."""
    model = language.fit(docs.select("doc_id", "text", "lang"))
    docs, back = aside(docs, "lang_pred", "lang_score")
    found = language.identify(docs, model)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id stays.

    Rows without words stay. Rows with a repeated or no doc_id are compared by their own texts; of
    a component without any id, or of rows that repeat id and words, one stays.
    """
    return jaccard.keep_one(docs, WIDTH, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs. Texts without words have none;
    repeated rows are judged by themselves."""
    docs, back = aside(docs, "n_words", "hit_spans", "hit_items")
    found = decontam.scan(docs, load(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_spans") == 0).select(*back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded: 0 to 3 times.

    Documents without words (null texts too) are not taken. Rows that repeat id, source and size are
    each taken as often as these rows are on average. Null sources are one source, as null ids are one id.
    """
    keys = ["doc_id", "_src", "size"]
    taken = mixing.mix(docs).groupBy(*keys).agg(F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    times = F.when(F.col("size") > 0, F.round(F.col("_taken") / F.col("_rows") / F.col("size"))).otherwise(0).cast("int")
    # Most documents are taken once; those that aren't are looked up.
    taken = checkpoint(taken.withColumn("times", times).filter("times <> 1").select(*keys, "times"))
    few = size_checked(taken, taken.count())
    # The row is carried in one column, so that no name in it can clash.
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))
    sized = docs.select(F.struct(*docs.columns).alias("row"), source.alias("src"), mixing.word_count("text").alias("words"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("src") == F.col("_src")) & (F.col("words") == F.col("size"))
    met = sized.join(few, same, "left")
    return met.select("row", F.explode(F.array_repeat(F.lit(0), F.coalesce("times", F.lit(1))))).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the shard of each: null texts have no bytes, rows of one id that exceed a shard go to pages."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: The language models and the similarity join have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents. Each is written to a folder of its own, which goes when the next
    one is there; that of the last stays, and is what is returned."""
    docs, folder = load(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    last = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if last:
            files.delete(path(last), True)
        last = f"{folder}/{k}-{name}"
    return docs
