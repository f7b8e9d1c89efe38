"""Quality rules: text statistics, and a decision list learned from labelled statistics.

Sequential covering grows one conjunction of thresholds at a time for the rejected class on two thirds of
a bounded labelled sample, prunes it on the last third, removes what it covers, and stops when a pruned
rule is not precise enough. The list becomes one ordered CASE expression. Every step is a small
aggregate in Spark; only counts for each feature and bin come to the driver.

Null and empty texts have no words and fail the base rule. Rows that repeat an id are judged each by
their own text. Labels that are null are not learned from; without labels the list is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafcalc.llm.common import id_crc, sampled, stored

WORD = r"[^\\x20\\x09-\\x0D]+"
WINDOW = 5
#: Bounds of learning: labelled rows, rules, conditions of a rule, thresholds of a feature.
SAMPLE_ROWS, MAX_RULES, MAX_TERMS, BINS = 12_000, 10, 4, 24
#: A rule is kept if it rejects so exactly on rows that it was not grown on, and covers so many.
PRECISION, SUPPORT = 0.8, 8


def let(value: str, name: str, body: str) -> str:
    """SQL that computes value once for each row and names it in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of whole texts: one row for each row of docs."""
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    own = own.withColumn("w", F.expr(f"regexp_extract_all(t, '{WORD}', 0)"))
    hashes = ", ".join(f"hw[i + {k}]" for k in range(WINDOW))
    windows = let("transform(w, x -> xxhash64(x))", "hw", f"transform(sequence(0, size(hw) - {WINDOW}), i -> xxhash64({hashes}))")
    own = own.withColumn("h", F.expr(f"if(size(w) < {WINDOW}, cast(array() as array<bigint>), {windows})"))
    # Most texts repeat no window: then sorting the hashes is all it takes. Else positions are sorted with them.
    repeats = let("sort_array(h)", "s", "exists(sequence(1, size(s) - 1), i -> s[i] = s[i - 1])")
    same = "coalesce(get(s, j - 1).h = x.h, false) or coalesce(get(s, j + 1).h = x.h, false)"
    at = let("sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", "s", f"sort_array(transform(filter(s, (x, j) -> {same}), x -> x.i))")
    covered = f"aggregate({at}, named_struct('n', 0, 'last', -{WINDOW}), (a, i) -> named_struct('n', a.n + least({WINDOW}, i - a.last), 'last', i)).n"
    lines = "filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    return own.select(
        id_col,
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(w, '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr(let(lines, "l", "cast(size(l) - size(array_distinct(l)) as bigint)")).alias("n_dup_lines"),
        F.expr(f"cast(case when size(h) < 2 then 0 when {repeats} then {covered} else 0 end as bigint)").alias("n_repeat_words"),
        F.expr("size(array_distinct(w))").alias("n_distinct"),
        F.expr("regexp_count(t, '[A-Z]')").alias("n_upper"),
        F.expr("regexp_count(t, '[0-9]')").alias("n_digits"),
    )


#: The features that rules look at, from the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


@dataclass
class Rule:
    terms: list[tuple[str, str, float]] = field(default_factory=list)

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.terms)

    def stored_sql(self) -> str:
        return " AND ".join(f"{f} {op} {t!r}D" for f, op, t in self.terms) or "true"


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Features of at most about `rows` labelled rows, chosen by hashes of their ids; bad is the rejected class."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    total = marks.count()
    share = min(1.0, rows / max(1, total))
    chosen = marks.filter(sampled(id_col, share)) if share < 1 else marks
    stats = text_stats(docs.join(F.broadcast(chosen), id_col, "left_semi"), id_col).join(F.broadcast(chosen), id_col)
    own = stats.select(*[F.expr(x).cast("double").alias(k) for k, x in FEATURES.items()], (F.col("label") == 0).alias("bad"), (id_crc(id_col, 3) == 0).alias("held"))
    return stored(own.repartition(6))


def learn_rules(sample: DataFrame) -> list[Rule]:
    """The ordered rules that reject."""
    cuts = sample.agg(*[F.percentile_approx(k, [i / BINS for i in range(1, BINS)], 10_000).alias(k) for k in FEATURES]).first()
    cuts = {k: sorted(set(cuts[k] or [])) for k in FEATURES}
    rules: list[Rule] = []
    rest = "true"
    for _ in range(MAX_RULES):
        rule = Rule()
        while len(rule.terms) < MAX_TERMS:
            here = sample.filter(f"NOT held AND {rest} AND {rule.stored_sql()}")
            bins = [F.struct(F.lit(k).alias("f"), F.expr(f"size(filter(array({', '.join(f'{t!r}D' for t in cuts[k])}), t -> t <= {k}))" if cuts[k] else "0").alias("bin")) for k in FEATURES]
            got = here.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best = best_term(got, cuts)
            if best is None:
                break
            rule.terms.append(best)
        if not rule.terms:
            break
        held = sample.filter(f"held AND {rest}")
        ends = range(1, len(rule.terms) + 1)
        found = held.agg(*[F.count_if(F.expr(f"bad AND {Rule(rule.terms[:k]).stored_sql()}")).alias(f"p{k}") for k in ends], *[F.count_if(F.expr(f"NOT bad AND {Rule(rule.terms[:k]).stored_sql()}")).alias(f"n{k}") for k in ends]).first()
        worth = {k: ((found[f"p{k}"] - found[f"n{k}"]) / max(1, found[f"p{k}"] + found[f"n{k}"]), found[f"p{k}"], -k) for k in ends}
        k = max(ends, key=worth.get)
        p, n = found[f"p{k}"], found[f"n{k}"]
        if p + n < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(Rule(rule.terms[:k]))
        rest += f" AND NOT ({rules[-1].stored_sql()})"
    return rules


def best_term(counts: list, cuts: dict[str, list[float]]) -> tuple[str, str, float] | None:
    """The threshold with the largest information gain for the rejected class, if any gains."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r.f, {})[r.bin] = (r.p, r.n)
    total_p, total_n = (sum(x[i] for x in next(iter(by.values()), {}).values()) for i in (0, 1))
    if not total_p or not total_n:
        return None
    base, best, gain = math.log2(total_p / (total_p + total_n)), None, 1e-6
    for f, bins in sorted(by.items()):
        below_p = below_n = 0
        for i, cut in enumerate(cuts[f]):
            p, n = bins.get(i, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for op, p, n in (("<", below_p, below_n), (">=", total_p - below_p, total_n - below_n)):
                if p and p + n >= SUPPORT and (g := p * (math.log2(p / (p + n)) - base)) > gain:
                    best, gain = (f, op, cut), g
    return best


def decision(rules: list[Rule]) -> Column:
    """Whether a row is kept: the first rule that holds rejects it, and a row without one stays."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN false" for r in rules) + " ELSE true END")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, base_failed and kept for each row of docs."""
    named = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    rules = learn_rules(labelled_sample(named, labels, id_col, label_col, sample_rows))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = text_stats(named, id_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & decision(rules))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
