"""Benchmark decontamination with a distributed positional inverted index.

Terms of the test items are counted over all training texts. For each window of an item its two rarest
terms are chosen; the index stores the postings (term, document, position) of those terms for every
training text. Offset-adjusted postings (document position minus item position) are intersected from the
rarest terms, and what is left is compared with the whole window, so matches are exact phrases.
Proximity matches ask the two rarest terms of a window to stand within a slop of their distance.

Null and empty texts have no words. Rows that repeat an id are judged each by their own text; items that
repeat an id count once. Empty tables give no matches. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafcalc.llm.common import small, stored

#: Words of a window, and rows of item terms up to which a side is broadcast.
WINDOW, BROADCAST_ROWS = 10, 400_000
#: The words of folded texts, and the same words in texts as they are. They say what is in a word: Java takes about ten times as
#: long to say of each character that it is in none of three ranges.
FOLDED = r"[0-9a-z\\x80-\\x{10FFFF}]+"
ANY_CASE = r"[0-9A-Za-z\\x80-\\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(col: str) -> str:
    return f"regexp_extract_all(translate({col}, '{UPPER}', '{LOWER}'), '{FOLDED}', 0)"


def words(col: str) -> Column:
    """Words with A-Z folded, and nothing else."""
    return F.expr(words_of(col))


def terms(col: str) -> Column:
    """Words in the coarser folding of the index: lower() is fast, and equal words stay equal under it."""
    return F.expr(f"regexp_extract_all(lower({col}), '{FOLDED}', 0)")


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, row (of items that repeat an id), words and length of the items with words."""
    own = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    own = own.select("item", F.xxhash64("item", "text").alias("row"), words("text").alias("item_words"), terms("text").alias("item_terms"))
    return own.filter(F.size("item_words") > 0)


def anchors(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """row, term, at (position in the item), window start and rank 1 or 2: the two rarest places of each window."""
    placed = items.select("row", F.size("item_terms").alias("length"), F.posexplode("item_terms").alias("at", "term"))
    vocabulary = placed.select("term").distinct()
    n_terms = vocabulary.count()
    tokens = docs.select(F.explode(terms("text")).alias("term"))
    counts = tokens.join(small(vocabulary, n_terms, BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n"))
    known = placed.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("at") - window + 1)
    last = F.greatest(F.lit(0), F.least(F.col("at"), F.col("length") - window))
    by_window = known.withColumn("start", F.explode(F.sequence(first, last)))
    order = Window.partitionBy("row", "start").orderBy("n", "at")
    ranked = by_window.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    # A window with a term that no text has cannot occur.
    possible = ranked.withColumn("least", F.min("n").over(Window.partitionBy("row", "start"))).filter("least > 0")
    return possible.select("row", "start", "term", "at", "rank", "length")


def postings(docs: DataFrame, chosen: DataFrame, n_terms: int) -> DataFrame:
    """The positional index of the chosen terms: doc, term, position, over all training texts."""
    return docs.select("doc", F.posexplode(terms("text")).alias("position", "term")).join(small(chosen, n_terms, BROADCAST_ROWS), "term")


def alignments(index: DataFrame, plan: DataFrame, n_plan: int) -> DataFrame:
    """doc, row, shift: offset-adjusted postings of a window's rarest terms that agree; both terms must, where it has two."""
    placed = plan.select("row", "start", "term", "at", F.max("rank").over(Window.partitionBy("row", "start")).alias("need"))
    # A term may anchor several windows of an item at one place; the windows are told apart after the shift is known.
    places = placed.groupBy("term", "row", "at").agg(F.collect_set(F.struct("start", "need")).alias("windows"))
    found = index.join(small(places, n_plan, BROADCAST_ROWS), "term").select("doc", "row", (F.col("position") - F.col("at")).alias("shift"), "at", "windows")
    # First the two lists are intersected by shift, then by window.
    hits = found.groupBy("doc", "row", "shift").agg(F.collect_set(F.struct("at", "windows")).alias("ats"))
    every = "flatten(transform(ats, x -> x.windows))"
    two = f"exists({every}, v -> size(filter(ats, x -> array_contains(x.windows, v))) >= v.need)"
    return hits.filter(F.expr(two)).select("doc", "row", "shift")


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc (a key of the text), item, and the positions of the document's words that windows of the item cover."""
    own = keyed(docs, id_col, text_col)
    tests = stored(item_words(items, item_col, item_text_col))
    n_rows = tests.count()
    plan = stored(anchors(own, tests, window))
    n_plan = plan.count()
    chosen = plan.select("term").distinct()
    aligned = stored(alignments(postings(own, chosen, n_plan), plan, n_plan).join(small(tests.select("row", "item", "item_words"), n_rows, 20_000), "row"))
    # All alignments of a text meet at the text, which is one row; there are never more than it has words times items.
    by_doc = aligned.groupBy("doc").agg(F.collect_list(F.struct("item", "item_words", "shift")).alias("found"))
    both = own.join(small(by_doc, aligned.count(), 20_000), "doc").select("doc", "text", "found")
    starts = f"filter(sequence(0, greatest(0, size(x.item_words) - {window})), s -> x.shift + s >= 0 AND slice(w, x.shift + s + 1, least({window}, size(x.item_words))) = slice(x.item_words, s + 1, {window}))"
    covered = f"array_distinct(flatten(transform({starts}, s -> sequence(x.shift + s, x.shift + s + least({window}, size(x.item_words)) - 1))))"
    # The words are an argument of a function: as a column they would be put into the innermost one and be sought anew for each window.
    matches = f"filter(transform(found, x -> named_struct('item', x.item, 'covered', {covered})), x -> size(x.covered) > 0)"
    return both.select("doc", F.expr(f"transform(array({words_of('text')}), w -> {matches})[0]").alias("matches"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and doc: a digest of id and text, so that rows that repeat an id stay apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("doc"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    own = keyed(docs, id_col, text_col)
    found = phrase_matches(docs, items, id_col, text_col, item_col, item_text_col, window)
    found = found.groupBy("doc").agg(F.first("matches").alias("matches")).filter(F.size("matches") > 0)
    names = "array_sort(array_distinct(transform(matches, x -> x.item)))"
    hits = stored(found.select("doc", F.expr("size(array_distinct(flatten(transform(matches, x -> x.covered))))").alias("n_hit"), F.expr(f"size({names})").alias("n_items"), F.expr(f"sha2(array_join({names}, ','), 256)").alias("sha")))
    n_words = F.expr(f"regexp_count(text, '{ANY_CASE}')").cast("long")
    out = own.select("id", "doc", n_words.alias("n_words")).join(hits, "doc", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc, item, start: windows all of whose terms stand in a text in order, within their number plus slop. The two
    rarest terms give the candidates."""
    own = keyed(docs, id_col, text_col)
    tests = stored(item_words(items, item_col, item_text_col))
    plan = stored(anchors(own, tests, window))
    n_plan = plan.count()
    index = postings(own, plan.select("term").distinct(), n_plan)
    pairs = plan.groupBy("row", "start").agg(F.min_by("term", "at").alias("t1"), F.min("at").alias("a1"), F.max_by("term", "at").alias("t2"), F.max("at").alias("a2"))
    step = F.greatest(F.lit(1), F.col("a2") - F.col("a1") + slop)
    pairs = small(pairs.withColumn("step", step), n_plan, BROADCAST_ROWS)
    # Positions are compared within blocks of the largest distance allowed, and the block after.
    one = index.join(pairs.withColumnRenamed("t1", "term"), "term").select("doc", "row", "start", "a1", "a2", F.col("position").alias("p1"), "step", F.explode(F.array(F.floor(F.col("position") / F.col("step")), F.floor(F.col("position") / F.col("step")) + 1)).alias("block"))
    two = index.join(pairs.withColumnRenamed("t2", "term"), "term").select("doc", "row", "start", F.col("position").alias("p2"), F.floor(F.col("position") / F.col("step")).alias("block"))
    near = one.join(two, ["doc", "row", "start", "block"]).filter((F.col("p2") - F.col("p1")).between(F.when(F.col("a1") == F.col("a2"), 0).otherwise(1), F.col("a2") - F.col("a1") + slop))
    near = near.select("doc", "row", "start").distinct().join(small(tests.select("row", "item", "item_terms"), n_plan, BROADCAST_ROWS), "row")
    near = near.select("doc", "item", "start", F.slice("item_terms", F.col("start") + 1, F.lit(window)).alias("t")).join(own.select("doc", terms("text").alias("w")), "doc")
    # From each place of the first term the others are taken at their next places; p counts the terms passed.
    step = f"array_position(slice(w, greatest(p, 0) + 1, size(t) + {slop}), x)"
    end = f"aggregate(t, s, (p, x) -> if(p < 0 OR {step} = 0, -1, p + cast({step} AS int)))"
    whole = f"exists(filter(sequence(0, size(w) - 1), s -> w[s] = t[0]), s -> {end} BETWEEN s + size(t) AND s + size(t) + {slop})"
    return near.filter(F.expr(whole)).select("doc", "item", "start").distinct()
