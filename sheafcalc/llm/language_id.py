"""Language identification: script ranges narrow the candidates of each word, letter n-grams score it, and
Viterbi with a switching penalty labels spans of mixed-language text.

The model is learned from a bounded sample of labelled texts: counts of letter trigrams for each language
(the most frequent ones), and which scripts each language uses. A text gets the language of most of its
letters; its score is their share.

A text that is null or has no letter is `und` with score 0. Rows that repeat an id are labelled each.
Without learned languages every text is `und`; an empty table gives an empty one. Words in a script that no
learned language uses say nothing and lower the score: a text of such words alone has score 0. A very long text
is a piece of its own in a task.
"""

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafcalc.llm.common import give_back, lean, pieces, small

#: Bounds of learning: texts, languages, trigrams of a language, characters of a text that are counted in one go.
SAMPLE_ROWS, LANGUAGES, GRAMS = 6_000, 200, 20_000
#: Cost of changing the language between two words (nats), and the share of a language's letters that makes a script its own.
SWITCH, SCRIPT_SHARE = 6.0, 0.005
CHUNK, KEPT = 4 << 20, 200_000
WORD = re.compile(r"[^\W\d_]+")
#: First code points of ranges of letters, and their scripts; a range ends where the next begins.
SCRIPTS = ((0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "other"), (0x20000, "Han"))
STARTS, KINDS = [a for a, _ in SCRIPTS], [b for _, b in SCRIPTS]


def script(word: str) -> str:
    at = bisect_right(STARTS, ord(word[0]))
    return KINDS[at - 1] if at else "other"


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def gram_codes(points: np.ndarray) -> np.ndarray:
    """Three neighbouring code points, of 21 bits each, as one number."""
    x = points.astype(np.int64)
    return (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point, as of a word that begins with it."""
    return np.array(["other", *KINDS])[np.searchsorted(STARTS, points, "right")]


@dataclass
class Model:
    """Languages, log chances of trigrams (a row each, the last for unknown ones) and candidates of each script."""

    langs: list[str]
    index: dict[str, int]
    logs: np.ndarray
    scripts: dict[str, np.ndarray]

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams as numbers in ascending order, and the row of each."""
        if not hasattr(self, "_coded"):
            codes = gram_codes(np.frombuffer("".join(self.index).encode("utf-32-le", "surrogatepass"), np.uint32))[::3]
            order = np.argsort(codes)
            self._coded = codes[order], np.fromiter(self.index.values(), np.int64, len(self.index))[order]
        return self._coded

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log chance of each word under each language; languages that do not use its script get none of it."""
        if not words:
            return np.zeros((0, len(self.langs)))
        lens = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(lens + 2) - lens - 2
        # A word of n letters stands between blanks and has n grams: all but those that begin in its last letter's place or after it.
        inside = np.ones(len(points), bool)
        inside[starts + lens] = inside[starts + lens + 1] = False
        codes, places = self.coded()
        asked, at = np.unique(gram_codes(points)[inside[:-2]], return_inverse=True)
        found = np.minimum(np.searchsorted(codes, asked), max(len(codes) - 1, 0))
        rows = np.where(codes[found] == asked, places[found], len(self.logs) - 1)[at] if len(codes) else np.full(len(at), len(self.logs) - 1)
        out = np.add.reduceat(self.logs[rows], np.cumsum(lens) - lens, axis=0)
        kinds = scripts_of(points[starts + 1])
        for kind in set(kinds.tolist()):
            may = self.scripts.get(kind)
            here = kinds == kind
            if may is None:
                out[here] = 0.0
            else:
                out[np.ix_(here, ~may)] = out[here].min(axis=1, keepdims=True) - 4 * SWITCH
        return out


def sampled_by(id_col: str, share: Column) -> Column:
    """Whether an id falls into a sample whose share is a column."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 11)
    return hashed <= share * float(1 << 53)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """A model of at most about `rows` labelled texts that may be learned from, chosen by hashes of their ids: half of them
    evenly, half by language."""
    own = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & learn).select(F.col(id_col), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # Each language has its part of the bound, so that a rare one is learned from all of its texts.
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs, total = sizes.agg(F.count("*"), F.sum("n")).first()
    if (total or 0) > rows:
        share = F.greatest(F.lit(rows / total), F.lit(rows / n_langs) / F.col("n")) / 2
        own = own.join(small(sizes, n_langs, 100_000), "lang").filter((F.col("n") <= rows / n_langs / 2) | sampled_by(id_col, share))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(WORD.findall(text.lower())).items():
                    counts.setdefault((lang, "gram"), Counter()).update(dict.fromkeys(grams(w), n))
                    counts.setdefault((lang, "script"), Counter())[script(w)] += n * len(w)
        flat = [(lang, kind, k, n) for (lang, kind), c in counts.items() for k, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "kind", "key", "n"])

    counts = own.select("lang", "text").mapInArrow(run, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))).filter(F.col("rank") <= GRAMS)
    got = ranked.select("lang", "kind", "key", "n").collect()
    letters = Counter()
    for r in got:
        if r.kind == "script":
            letters[r.lang] += r.n
    langs = sorted(x for x, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LANGUAGES])
    place = {x: i for i, x in enumerate(langs)}
    index: dict[str, int] = {}
    for r in got:
        if r.kind == "gram" and r.lang in place:
            index.setdefault(r.key, len(index))
    table = np.zeros((len(index) + 1, len(langs)))
    scripts: dict[str, np.ndarray] = {}
    for r in got:
        if r.lang in place:
            if r.kind == "gram":
                table[index[r.key], place[r.lang]] = r.n
            elif r.n >= SCRIPT_SHARE * letters[r.lang]:
                scripts.setdefault(r.key, np.zeros(len(langs), bool))[place[r.lang]] = True
    total = table.sum(axis=0)
    return Model(langs, index, np.log((table + 0.5) / (total + 0.5 * len(table))), scripts)


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; at: offsets of texts among the words. Texts run in step, longest first; words are put in
    order of their step, so that those of a step are neighbours."""
    lens = np.diff(at)
    order = np.argsort(-lens, kind="stable")
    rank = np.empty(len(lens), np.int64)
    rank[order] = np.arange(len(lens))
    lens = lens[order]
    steps = int(lens[0]) if len(lens) else 0
    live = np.searchsorted(-lens, -np.arange(steps), "left")  # texts with more than t words
    first = np.cumsum(live) - live
    owner = np.repeat(np.arange(len(rank)), np.diff(at))
    place = first[np.arange(len(scores)) - at[owner]] + rank[owner]
    step = np.empty_like(scores)
    step[place] = scores
    came = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int32)
    v = np.zeros((len(order), scores.shape[1]))
    spans = list(zip(first.tolist(), (first + live).tolist(), live.tolist(), strict=True))
    for a, e, k in spans:
        u = v[:k]
        best[a:e] = u.argmax(axis=1)
        from_top = u.max(axis=1, keepdims=True) - switch
        np.less(u, from_top, out=came[a:e])
        np.maximum(u, from_top, out=u)
        u += step[a:e]
    out = np.zeros(len(scores), np.int32)
    here = v.argmax(axis=1)
    rows = np.arange(len(order))
    for a, e, k in reversed(spans):
        now = here[:k]
        out[a:e] = now
        np.copyto(now, best[a:e], where=came[a:e][rows[:k], now])
    return out[place]


class Labeller:
    """Labels texts with a model; keeps the scores of words it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known, self.table, self.foreign, self.letters = {}, np.zeros((0, len(self.model.langs))), np.zeros(0, bool), np.zeros(0)

    def word_rows(self, found: list[list[str]]) -> None:
        words = set().union(*found)
        if len(self.known) + len(words) > KEPT:
            self.forget()
        new = list(words - self.known.keys())
        self.known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        if self.model.langs and new:
            self.table = np.concatenate([self.table, self.model.word_scores(new)])
            kinds = scripts_of(np.fromiter((ord(w[0]) for w in new), np.int64, len(new)))
            self.foreign = np.concatenate([self.foreign, ~np.isin(kinds, list(self.model.scripts))])
            self.letters = np.concatenate([self.letters, np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new), np.float64, len(new))])

    def label(self, texts: list[str | None], with_spans: bool = False) -> tuple[list[str], list[float], list]:
        texts, langs_known = [t or "" for t in texts], self.model.langs
        places = [[(x.start(), x.end()) for x in WORD.finditer(t)] for t in texts] if with_spans else None
        # lower() may change the number of letters, so with spans each word is lowered by itself.
        found = [[t[i:j].lower() for i, j in p] for t, p in zip(texts, places, strict=True)] if with_spans else [WORD.findall(t.lower()) for t in texts]
        self.word_rows(found)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=at[1:])
        out_lang, out_score, out_spans = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        if not at[-1] or not langs_known:
            return out_lang, out_score, out_spans
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(at[-1]))
        langs = viterbi(self.table[ids], at)
        letters = self.letters[ids]
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        # Letters of a script that no learned language uses are no language's, but count in the whole.
        total = np.bincount(owner, letters, len(texts))
        sums = np.bincount(owner * len(langs_known) + langs, np.where(self.foreign[ids], 0, letters), len(texts) * len(langs_known)).reshape(len(texts), -1)
        for i in np.flatnonzero(total > 0):
            k = int(sums[i].argmax())
            out_lang[i], out_score[i] = langs_known[k], float(sums[i, k] / total[i])
            if with_spans:
                own = langs[at[i] : at[i + 1]]
                cut = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
                out_spans[i] = [{"start": places[i][x][0], "end": places[i][y - 1][1], "lang": langs_known[own[x]]} for x, y in zip(cut, cut[1:], strict=False)]
        return out_lang, out_score, out_spans


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """id, lang_pred and score of each row of docs, and with spans the runs of one language: start, end, lang."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for whole in batches:
            for b in pieces(whole, "text", CHUNK):
                langs, scores, found = labeller.label(b.column("text").to_pylist(), with_spans)
                columns = [b.column("id"), pa.array(langs), pa.array(scores)] + [pa.array(found, _SPANS)] * with_spans
                yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "spans"][: len(columns)])

    schema = f"id {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def labels_of(model: Model, text: Column, spark: SparkSession) -> Column:
    """lang_pred and score as a struct column beside the other columns of a table."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value)
        for texts in batches:
            langs, scores, i = [], [], 0
            size = np.cumsum([len(t or "") for t in texts])
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + CHUNK, "right")))
                x, y, _ = labeller.label(list(texts.iloc[i:j]))
                langs, scores, i = langs + x, scores + y, j
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        del labeller
        give_back()

    return F.pandas_udf(run, "lang_pred string, score double")(text)
