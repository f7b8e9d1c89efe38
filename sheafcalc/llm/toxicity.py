"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities of a lexicon, nearness of lexicon words to words of the second person, capitals,
punctuation and obfuscation. The lexicon is a short fixed list and words that labelled toxic texts use far
more often. Lexicon, trees and calibration are learned from a bounded sample of labelled rows; the
calibration uses rows that the trees have not seen.

Null and empty texts have zero features and get the score that these give. Rows that repeat an id are
scored each. Null labels are not learned from; without labels of both classes every score is the share of
toxic labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafcalc.llm.common import sampled, stored

#: Bounds of learning: labelled rows, lexicon words learned, texts that must use one.
SAMPLE_ROWS, LEXICON_WORDS, LEAST_TEXTS = 16_000, 600, 5
#: Lengths of word beginnings that the lexicon may hold, marked ^.
BEGINNINGS = (3, 4, 5, 6)
TREES, DEPTH, STEP = 25, 4, 0.2
#: Words to each side in which a word of the second person counts as near.
NEAR = 4
#: Insults, words of the second person in four languages, and signs that stand for letters.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash garbage clown jerk fool filth vermin imbecile cretin hate kill".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
SIGNS = str.maketrans("013457@$!|€", "oieastasiie")
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*_~#&%/\\|$^+=`"
SEPARATORS = re.compile(r"[\W_]+")
RUNS = re.compile(r"[!?]{2,}")
STRETCHED = re.compile(r"(\w)\1{2,}")
NAMES = ("lexicon_share", "beginning_share", "beginning_count", "beginning_weight", "lexicon_count", "lexicon_kinds", "weight_share", "weight_most", "insult_share", "second_share", "near_share", "near_count", "capital_share", "capital_words", "exclaim_share", "question_share", "mark_share", "mark_runs", "odd_share", "hidden_share", "hidden_count", "stretched_share", "digit_share", "log_words")


def plain(word: str) -> str:
    """A word with signs turned to letters, separators dropped and stretched letters cut."""
    return STRETCHED.sub(r"\1", SEPARATORS.sub("", word.translate(SIGNS)))


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    raw = text.split()
    words = [w.strip(PUNCTUATION) for w in text.lower().split()]
    n = max(1, len(words))
    hits = {i: w for i, w in enumerate(words) if w in lexicon}
    odd = [i for i, w in enumerate(words) if not w.isalpha() and any(c.isalpha() for c in w)]
    hidden = 0
    for i in odd:
        if i not in hits and (p := plain(raw[i].lower())) in lexicon:
            hits[i], hidden = p, hidden + 1
    begun = [lexicon[p] for w in words for k in BEGINNINGS if (p := "^" + w[:k]) in lexicon and len(w) > k]
    weights = [lexicon[w] for w in hits.values()]
    second = [i for i, w in enumerate(words) if w in SECOND]
    around = {j for i in second for j in range(i - NEAR, i + NEAR + 1)} if hits else set()
    near = sum(i in around for i in hits)
    letters = max(1, sum(map(len, words)))
    marks = sum(map(text.count, PUNCTUATION))
    return [
        len(hits) / n, len(begun) / n, float(len(begun)), sum(begun) / n, float(len(hits)), float(len(set(hits.values()))), sum(weights) / n, max(weights, default=0.0), sum(w in INSULTS for w in hits.values()) / n,
        len(second) / n, near / n, float(near), sum(map(str.isupper, text)) / letters, sum(w.isupper() and len(w) > 1 for w in raw) / n,
        text.count("!") / n, text.count("?") / n, marks / n, len(RUNS.findall(text)) / n, len(odd) / n, hidden / n, float(hidden),
        len(STRETCHED.findall(text)) / n, sum(map(text.count, "0123456789")) / n, math.log1p(len(words)),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: str) -> DataFrame:
    """The kept columns (given with their types) and the features of column text."""
    names = [x.split()[0] for x in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = pa.array([features(t.as_py(), lexicon) for t in part.column("text")], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), got], [*names, "features"])

    return docs.select(*names, "text").mapInArrow(run, f"{keep}, features array<double>")


def sample_of(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, label_col: str, rows: int) -> DataFrame:
    """id, text, label and part (a number from 0 to 3) of at most about `rows` labelled texts that may be learned from."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(id_col).agg(F.max(label_col).cast("double").alias("label"))
    share = min(1.0, rows / max(1, marks.count()))
    chosen = marks.filter(sampled(id_col, share)) if share < 1 else marks
    own = docs.select(F.col(id_col).alias("id"), F.col("text"))
    return own.join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id").withColumn("part", F.crc32(F.concat(F.lit("part"), F.col("id").cast("string")).cast("binary")) % 4)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log odds of words that toxic texts use clearly more often, and the fixed insults."""
    # Distinct words of a text count, and their distinct beginnings.
    found = F.array_distinct(F.expr("regexp_extract_all(lower(coalesce(text, '')), '[\\\\p{L}]{2,}', 0)"))
    begun = F.array_distinct(F.expr(" || ".join(f"transform(filter(w, x -> length(x) > {k}), x -> '^' || left(x, {k}))" for k in BEGINNINGS)))
    words = sample.select("label", found.alias("w")).select("label", F.explode(F.concat("w", begun)).alias("word"))
    totals = sample.agg(F.sum("label").alias("bad"), F.count("*").alias("n")).first()
    bad, good = totals.bad or 0.0, (totals.n or 0) - (totals.bad or 0.0)
    counts = words.groupBy("word").agg(F.sum("label").alias("b"), F.sum(1 - F.col("label")).alias("g")).filter(F.col("b") >= LEAST_TEXTS)
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
    both = (F.col("b") + F.col("g")) / (bad + good)
    z = (F.col("b") / max(bad, 1.0) - F.col("g") / max(good, 1.0)) / F.sqrt(both * (1.0000001 - both) * (1 / max(bad, 1.0) + 1 / max(good, 1.0)))
    found = counts.withColumn("odds", odds).withColumn("z", z).filter("z > 4 and odds > 1.5").orderBy(F.desc("z"), "word").limit(LEXICON_WORDS).collect()
    return {w: 1.0 for w in INSULTS} | {r.word: float(r.odds) for r in found}


def score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, score and predicted for each row of docs. learn: a condition on the id column of rows that may be learned from."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    sample = stored(sample_of(own, labels, learn, id_col, label_col, rows).repartition(6))
    classes = {r.label for r in sample.groupBy("label").count().collect()}
    everything = own.withColumnRenamed(id_col, "id")
    if len(classes) < 2:
        share = max(classes, default=0.0)
        scored = everything.select("id", F.lit(float(share)).alias("score"))
    else:
        lexicon = learn_lexicon(sample.filter("part < 2").dropDuplicates(["text"]))
        rows_in = stored(with_features(sample, lexicon, "label double, part bigint")).withColumn("x", array_to_vector("features"))
        grown = rows_in.filter("part <> 3")
        trees = GBTClassifier(featuresCol="x", labelCol="label", predictionCol="class", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=4, seed=17, cacheNodeIds=False).fit(grown)
        chance = lambda df: trees.transform(df).withColumn("p", vector_to_array("probability")[1])
        held = chance(rows_in.filter("part = 3")).select("p", "label")
        if held.limit(1).count():
            fitted = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(held)
            calibrated = lambda df: fitted.transform(df)
        else:
            calibrated = lambda df: df.withColumn("score", F.col("p"))
        scored = calibrated(chance(with_features(everything, lexicon, f"id {kind}").withColumn("x", array_to_vector("features")))).select("id", "score")
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select(F.col("id").alias(id_col), bounded.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
