"""The corpus pipeline: language, near duplicates, shared strings, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of docs. Rows that repeat a doc_id stay or go together; rows without
one are judged each. Null and empty texts have no language and go in the first stage; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafcalc.llm import decontaminate, jaccard_join, language_id, mixing, suffix_dedup
from sheafcalc.llm.common import rested, small, stored, table

#: A text is rejected that is no language's, or whose main language has a smaller share of its letters.
LEAST_SHARE = 0.3
#: Near duplicates on word shingles: words, and the similarity as a fraction.
SHINGLE, SIMILAR = 5, (80, 100)
#: Ids that an anti-join may broadcast.
BROADCAST_IDS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go, and so do those that are a patchwork without a main one."""
    model = language_id.train(docs, F.lit(True))
    marked = docs.withColumn("__language", language_id.labels_of(model, F.col("text"), spark))
    return marked.filter((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= LEAST_SHARE)).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """docs with an id for each row that has none, above all others, and the largest id that was there; None where no row
    lacks one. The new ids are stored, so that they stay what they are when a task runs again."""
    lone = docs.filter("doc_id IS NULL")
    if not lone.limit(1).count():
        return docs, None
    top = docs.agg(F.max("doc_id").cast("long")).first()[0] or 0
    lone = stored(lone.withColumn("doc_id", F.lit(top + 1) + F.monotonically_increasing_id()))
    return docs.filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(lone), top


def without(docs: DataFrame, gone: DataFrame, top: int | None, like: DataFrame) -> DataFrame:
    """Rows of numbered docs whose id is not among those that go, with the columns they came with."""
    left = docs.join(small(gone, gone.count(), BROADCAST_IDS), "doc_id", "left_anti")
    if top is not None:
        left = left.withColumn("doc_id", F.when(F.col("doc_id") <= top, F.col("doc_id")).cast(like.schema["doc_id"].dataType))
    return left.select(*like.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays; one without an id goes before all others."""
    rested(spark)
    like, (docs, top) = docs, numbered(docs)
    groups = jaccard_join.link_classes(docs.select("doc_id", "text"), SHINGLE, *SIMILAR)
    return without(docs, stored(groups.filter("component_id <> doc_id").select("doc_id").distinct()), top, like)


def shared_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes go that a document of smaller id has in a string of 50; so do documents that keep no word then."""
    rested(spark)
    others = [c for c in docs.columns if c != "text"]
    kept = suffix_dedup.kept_texts(docs, rest=others)
    kept = kept.filter(~((F.col("n_removed") > 0) & ~F.col("kept").rlike(r"[^\x20\x09-\x0D]")))
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return kept.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a window of a benchmark item."""
    like, (docs, top) = docs, numbered(docs)
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, stored(found.filter("contaminated").select("doc_id").distinct()), top, like)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mixture takes of a document, with its epoch from 1."""
    keys = ["doc_id", "lang", "source"]
    taken = mixing.mix(docs).groupBy(*keys).agg(F.max("n_copies").alias("__copies"))
    taken = taken.filter("__copies > 0").select(*[F.col(k).alias(f"__{k}") for k in keys], "__copies")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("__lang")) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("__source"))
    rows = docs.join(taken, same).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return rows.select(*[c for c in docs.columns if c != "epoch"], "epoch")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("shared_strings", shared_strings),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
]

#: Language, near duplicates and shared strings are beyond SQL; tests hold run() against brute force (texts without a letter for language).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
