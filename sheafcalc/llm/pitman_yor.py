"""Language-model scoring with a hierarchical Pitman-Yor model of words.

Each context of a word is a restaurant: the word before it (or the begin of the text), whose parent is the last
byte of that word, whose parent is the root, whose base is uniform over the vocabulary and one unseen word.
Tables are seated by Gibbs sampling: a sweep takes all customers of a dish away and seats them anew, one by one
(from 32 on in blocks of a sixteenth of those seated), given the parents' chances of the last sweep. Chances are
averaged over the sweeps after the first and a text's score is the sum of their log10.

All counts are over all training texts. A task cuts its texts into blocks and keeps their tokens as places in the
block's list of words, so texts are read once and never shuffled. What follows is asked and answered by buckets:

* the bucket of a word counts it and gives it a number, the same for all blocks, that tells the word's last byte and bucket;
* a block sends each distinct pair of word and word before, with its training count, to the bucket of the word, which holds the
  restaurants of its words. A hot word sends one row a block;
* customers and tables of a context lie in the buckets of many words. Before each sweep a bucket sends its part of them to the
  bucket of the context's own word and gets the sums back, so totals of words never go through the driver: it holds those of
  the 257 contexts of the middle level and the root;
* chances come back to the blocks in the order of the questions.

Null and empty texts have only their end token. Rows that repeat an id are scored each. Without training
texts every token has the base chance.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafcalc.llm.common import FOLD, SPACED, U64, buffers, discard, lean, pieces, range_hashes, release, spans, stored

#: Bytes of text of a block and of the texts whose words share a bucket; sweeps, the first of which are not averaged.
BLOCK_BYTES, BUCKET_BYTES, SWEEPS, BURN_IN = 12 << 20, 24 << 20, 3, 1
BEGIN, END = U64(0x3C6EF372FE94F82B), U64(0x9D39247E33776D41)
#: Contexts: 0 begins a text, 1 + last byte follows a word not learned, 1 + 256 * (1 + number) + last byte a learned one, where
#: the number modulo the count of buckets is its bucket. The parent of 0 is 256.
PARENTS, LEARNED = 257, 257
STRENGTH = 1.0


def parent(context: np.ndarray) -> np.ndarray:
    return np.where(context == 0, 256, (context - 1) & 255)


def home(context: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the word that is the context; the begin of texts has the first."""
    return np.where(context == 0, 0, ((context - 1) // 256 - 1) % buckets)


def tokens(b: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest and last byte of each token of the texts, which are a begin, the words and an end, and the number of tokens of each text."""
    words, lasts, counts = [np.zeros(0, U64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for part in pieces(b, column):
        data, at = buffers(part.column(column))
        data = FOLD[data]
        s, e, owner = spans(data, at, SPACED)
        n = part.num_rows
        count = np.bincount(owner, minlength=n) + 2
        ends = np.cumsum(count) - 1
        place = np.arange(len(s)) + 2 * owner + 1
        token, last = np.empty(len(s) + 2 * n, U64), np.zeros(len(s) + 2 * n, np.uint8)
        token[place], token[ends - count + 1], token[ends] = range_hashes(data, s, e), BEGIN, END
        last[place] = data[e - 1] if len(e) else 0
        words.append(token)
        lasts.append(last)
        counts.append(count)
    return np.concatenate(words), np.concatenate(lasts), np.concatenate(counts)


def bucket_of(word: np.ndarray, buckets: int) -> np.ndarray:
    return (word >> U64(40)).astype(np.int64) % buckets


def listed(parts: list[pa.RecordBatch], buckets: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """A block: its tokens as places in its list of words (frequent ones first), and what it asks of each bucket: its words in order
    of their digests with last byte and training count (of the begin: training texts)."""
    got = [tokens(b) for b in parts]
    word, last, count = (np.concatenate([g[i] for g in got]) for i in range(3))
    learn = np.array([x for b in parts for x in b.column("learn").to_pylist()], bool)
    w, first, place, often = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
    n = np.bincount(place, np.repeat(learn, count), len(w)).astype(np.int64)
    k = bucket_of(w, buckets)
    dealt, frequent = np.argsort(k, kind="stable"), np.argsort(-often, kind="stable")
    at = np.empty(len(w), np.uint32)
    at[frequent] = np.arange(len(w))
    rank = np.empty(len(w), np.uint32)
    rank[dealt] = np.arange(len(w))
    cut = np.searchsorted(k[dealt], np.arange(buckets + 1))
    lasts = last[first]
    asks = [(i, shut(w[d], lasts[d], n[d])) for i, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x for d in [dealt[x:y]]]
    return shut(at[place], rank[frequent], lasts[frequent], k[frequent].astype(np.uint32), count.astype(np.uint32), learn.astype(np.uint8)), asks


def numbered(questions: list[bytes], k: int, buckets: int) -> tuple[list[bytes], list[int]]:
    """Number of each word asked for; training tokens, vocabulary, and words that occur once and twice."""
    got = [opened(q) for q in questions]
    word, last, n = (np.concatenate([g[i] for g in got]) for i in range(3))
    w, first, place = np.unique(word, return_index=True, return_inverse=True)
    n, last = np.bincount(place, n, len(w)).astype(np.int64), last[first].astype(np.int64)
    known = np.flatnonzero((n > 0) & (w != BEGIN))
    order = known[np.lexsort((w[known], -n[known], last[known]))]  # numbers run by last byte, frequent words first
    starts = np.searchsorted(last[order], np.arange(256))
    number = 1 + last
    number[order] = 1 + 256 * (1 + (np.arange(len(order)) - starts[last[order]]) * buckets + k) + last[order]
    number[w == BEGIN] = 0
    count = n[known]
    ends = np.cumsum([len(g[0]) for g in got])
    return [shut(number[i]) for i in np.split(place, ends[:-1])], [int(count.sum()), len(known), int((count == 1).sum()), int((count == 2).sum())]


def distinct(stream: bytes, replies: dict[int, bytes], buckets: int) -> tuple[np.ndarray, ...]:
    """Of a block: word (0: not learned), context and training count of its distinct pairs in order of bucket and word, offsets of
    the buckets, pair and text of each token but the begins, and the number of texts."""
    token, rank, last, k, count, learn = opened(stream)
    number = np.concatenate([opened(replies[i])[0] for i in sorted(replies)])[rank]
    word = np.where(number < LEARNED, 0, number)
    w, c = ranks(word, k), ranks(number)
    size = len(number)
    text = np.repeat(np.arange(len(count)), count)
    scored = np.ones(len(token), bool)
    scored[np.cumsum(count, dtype=np.int64) - count] = False  # the begin of a text is a context only
    at = np.flatnonzero(scored)
    text = text[at]
    key, pair = np.unique(w[token[at]] * size + c[token[at - 1]], return_inverse=True)
    of_word, of_context = np.empty(size, np.int64), np.empty(size, np.int64)
    of_word[w], of_context[c] = np.arange(size), np.arange(size)
    i, j = of_word[key // size], of_context[key % size]
    n = np.bincount(pair, learn[text], len(key)).astype(np.int64)
    return word[i], number[j], n, np.searchsorted(k[i], np.arange(buckets + 1)), pair, text, len(count)


def ranks(x: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Places of values among the distinct ones, in order of `first` and value."""
    order = np.lexsort((x,) if first is None else (x, first))
    new = x[order][1:] != x[order][:-1]
    if first is not None:
        new |= first[order][1:] != first[order][:-1]
    out = np.zeros(len(x), np.int64)
    out[order[1:]] = np.cumsum(new)
    return out


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array with bytes of one place together."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def shut(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(a.dtype.str, planes(a)) for a in arrays], protocol=5))


def opened(blob: bytes) -> list[np.ndarray]:
    return [unplanes(raw, np.dtype(kind)) for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


def question(w: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs: each word once with its number of contexts, the contexts, the training counts."""
    edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    return shut(w[edge], np.diff(np.concatenate([edge, [len(w)]])).astype(np.uint32), c.astype(np.uint64), n.astype(np.uint32))


def asked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    w, runs, c, n = opened(blob)
    return w, runs.astype(np.int64), c.astype(np.int64), n.astype(np.int64)


class Bucket:
    """The restaurants of one bucket of words: dishes of all three levels and the tables of each sweep. seats: the contexts whose
    totals are needed, those of the dishes at least."""

    def __init__(self, words: np.ndarray, runs: np.ndarray, contexts: np.ndarray, counts: np.ndarray, samples: list[list[np.ndarray]], seats: np.ndarray | None = None):
        self.words, self.runs, self.contexts, self.counts, self.samples = words, runs, contexts, counts, samples
        self.seats = np.unique(contexts) if seats is None else seats
        self.at = np.searchsorted(self.seats, contexts)
        self.word = np.repeat(np.arange(len(words)), runs)
        key = self.word * PARENTS + parent(contexts)
        self.mid, self.up = np.unique(key, return_inverse=True)
        self.mid_word, self.mid_context = self.mid // PARENTS, self.mid % PARENTS
        self.settled: tuple | None = None

    @classmethod
    def gathered(cls, questions: list[bytes]) -> Bucket:
        got = [asked(q) for q in questions]
        w = np.concatenate([np.repeat(x[0], x[1]) for x in got])
        c, n = np.concatenate([x[2] for x in got]), np.concatenate([x[3] for x in got])
        seats = np.unique(c[(c == 0) | (c >= LEARNED)])
        w, c, n = w[n > 0], c[n > 0], n[n > 0]
        order = np.lexsort((c, w))
        w, c, n = w[order], c[order], n[order]
        edge = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])])) if len(w) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, edge) if len(edge) else n
        w, c = w[edge], c[edge]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else edge
        out = cls(w[first], np.diff(np.concatenate([first, [len(w)]])), c, n, [], seats)
        out.samples = [out.one_table()]
        return out

    def bytes(self) -> bytes:
        """The bucket before the first sweep."""
        return shut(self.words, self.runs.astype(np.uint32), self.at.astype(np.uint32), self.counts, self.seats)

    @classmethod
    def of(cls, blob: bytes) -> Bucket:
        words, runs, at, counts, seats = opened(blob)
        out = cls(words, runs, seats[at], counts, [], seats)
        out.samples = [out.one_table()]
        return out

    def one_table(self) -> list[np.ndarray]:
        return [np.ones(len(self.contexts), np.int64), np.ones(len(self.mid), np.int64), np.ones(len(self.words), np.int64)]

    def customers(self, sample: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers of each level: a table below is a customer above."""
        mid = np.bincount(self.up, sample[0], len(self.mid)).astype(np.int64)
        return self.counts, mid, np.bincount(self.mid_word, sample[1], len(self.words)).astype(np.int64)

    def totals(self) -> dict[str, np.ndarray]:
        """Customers and tables of contexts in the last sweep, as far as they lie in this bucket; c2 and t2 run along its seats."""
        t = self.samples[-1]
        c = self.customers(t)
        full = lambda ids, x, size: np.bincount(ids, x, size)
        n = len(self.seats)
        return {"c2": full(self.at, c[0], n), "t2": full(self.at, t[0], n), "c1": full(self.mid_context, c[1], PARENTS), "t1": full(self.mid_context, t[1], PARENTS), "c0": np.array([c[2].sum()], float), "t0": np.array([t[2].sum()], float)}

    def sends(self, buckets: int) -> list[dict]:
        """What it has of the totals of contexts, for the buckets of their words."""
        x, k = self.totals(), home(self.seats, buckets)
        at = np.argsort(k, kind="stable")
        cut = np.searchsorted(k[at], np.arange(buckets + 1))
        c, t = x["c2"].astype(np.int64), x["t2"].astype(np.int64)
        return [{"home": i, "part": shut(self.seats[j], c[j], t[j])} for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a for j in [at[a:b]]]

    def received(self, replies: dict[int, bytes], buckets: int) -> dict[str, np.ndarray]:
        """c2 and t2 of its seats over all buckets."""
        at = np.argsort(home(self.seats, buckets), kind="stable")
        out = {"c2": np.zeros(len(at)), "t2": np.zeros(len(at))}
        if replies:
            got = [opened(replies[i]) for i in sorted(replies)]
            out["c2"][at], out["t2"][at] = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        return out

    def chances(self, sample: list[np.ndarray], all_: dict, discount: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Chance of each word at the root, and of each dish of the middle level."""
        _, c1, c0 = self.customers(sample)
        root = seated(c0, sample[2], all_["c0"][0], all_["t0"][0], discount[0], 1 / (all_["v"] + 1))
        return root, seated(c1, sample[1], all_["c1"][self.mid_context], all_["t1"][self.mid_context], discount[1], root[self.mid_word])

    def sweep(self, all_: dict, discount: list[float], rng: np.random.Generator) -> None:
        """Seat every dish anew, the lowest level first, given the parents' chances of the last sweep."""
        root, mid = self.chances(self.samples[-1], all_, discount)
        low = reseated(self.counts, (STRENGTH + discount[2] * all_["t2"][self.at]) * mid[self.up], discount[2], rng)
        c1 = np.bincount(self.up, low, len(self.mid)).astype(np.int64)
        middle = reseated(c1, (STRENGTH + discount[1] * all_["t1"][self.mid_context]) * root[self.mid_word], discount[1], rng)
        c0 = np.bincount(self.mid_word, middle, len(self.words)).astype(np.int64)
        top = reseated(c0, np.full(len(c0), (STRENGTH + discount[0] * all_["t0"][0]) / (all_["v"] + 1)), discount[0], rng)
        self.samples.append([low, middle, top])

    def settle(self, all_: list[dict], discount: list[float]) -> tuple:
        """Training counts of words, averaged chances of the dishes, and chances of the upper levels in each sample, the last root for all words not learned."""
        total, levels = np.zeros(len(self.counts)), []
        for sample, of in zip(self.samples, all_, strict=True):
            root, mid = self.chances(sample, of, discount)
            total += seated(self.counts, sample[0], of["c2"][self.at], of["t2"][self.at], discount[2], mid[self.up])
            levels.append((np.append(root, seated(0, 0, of["c0"][0], of["t0"][0], discount[0], 1 / (of["v"] + 1))), mid, of))
        count = np.append(np.bincount(self.word, self.counts, len(self.words)), 0).astype(np.int64)
        return count, total / len(levels), levels, self.word * (len(self.seats) + 1) + self.at

    def answer(self, blob: bytes, all_: list[dict], discount: list[float]) -> bytes:
        """Training count of each word asked for, and averaged log10 chance of each pair."""
        w, runs, c, _ = asked(blob)
        if self.settled is None:
            self.settled = self.settle(all_, discount)
        count, mean, levels, dishes = self.settled
        at, known = place(self.words, w)
        at = np.where(known, at, len(self.words))
        word = np.repeat(at, runs)
        seat, sits = place(self.seats, c)
        i, has = place(dishes, word * (len(self.seats) + 1) + np.where(sits, seat, len(self.seats)))
        out = np.empty(len(c))
        out[has] = mean[i[has]]
        if len(new := np.flatnonzero(~has)):
            word, seat, sits, p = word[new], seat[new], sits[new], parent(c[new])
            i, has = place(self.mid, word * PARENTS + p)
            total = np.zeros(len(new))
            for root, mid, of in levels:
                above = seated(0, 0, of["c1"][p], of["t1"][p], discount[1], root[word])
                above[has] = mid[i[has]]
                c2, t2 = np.zeros(len(new)), np.zeros(len(new))
                c2[sits], t2[sits] = of["c2"][seat[sits]], of["t2"][seat[sits]]
                total += seated(0, 0, c2, t2, discount[2], above)
            out[new] = total / len(levels)
        n = count[at]
        return shut(n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64), np.log10(out).astype(np.float32))


def place(keys: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in sorted keys and whether it is there."""
    i = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
    return i, keys[i] == k if len(keys) else np.zeros(len(k), bool)


def summed(parts: list[bytes]) -> list[bytes]:
    """Sums over the parts of customers and tables of each context, for each part in its order."""
    got = [opened(x) for x in parts]
    ids, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    c, t = (np.bincount(at, np.concatenate([g[i] for g in got]), len(ids)).astype(np.uint64) for i in (1, 2))
    return [shut(c[i], t[i]) for i in np.split(at, np.cumsum([len(g[0]) for g in got])[:-1])]


def seated(customers, tables, all_customers, all_tables, discount: float, above):
    """Predictive chance of a dish in a restaurant."""
    return (np.maximum(customers - discount * tables, 0) + (STRENGTH + discount * all_tables) * above) / (STRENGTH + all_customers)


def reseated(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers have sat down anew; new: weight of a new table."""
    order = np.argsort(-customers, kind="stable")
    n, weight = customers[order], new[order]
    tables = np.minimum(n, 1).astype(np.int64)
    i = 1
    while (k := int(np.searchsorted(-n, -i, "left"))) > 0:  # those with more than i customers
        step = 1 if i < 32 else i // 16
        more = np.minimum(step, n[:k] - i)
        chance = weight[:k] / (weight[:k] + i - discount * tables[:k])
        tables[:k] += (rng.random(k) < chance) if step == 1 else rng.binomial(more, np.clip(chance, 0, 1))
        i += step
    out = np.empty_like(tables)
    out[order] = tables
    return out


def contexts_of(df: DataFrame) -> dict[str, np.ndarray]:
    """Totals of the root and of the middle level over all buckets, summed in Spark: at most 258 rows come to the driver."""
    got = df.select(F.explode("totals").alias("x")).groupBy("x.level", "x.context").agg(F.sum("x.c").alias("c"), F.sum("x.t").alias("t")).collect()
    out = {k: np.zeros(n) for k, n in (("c1", PARENTS), ("t1", PARENTS), ("c0", 1), ("t0", 1))}
    for r in got:
        out[f"c{r.level}"][r.context], out[f"t{r.level}"][r.context] = r.c, r.t
    return out


TOTALS = "array<struct<level:int,context:int,c:double,t:double>>"
_TOTALS = pa.list_(pa.struct([("level", pa.int32()), ("context", pa.int32()), ("c", pa.float64()), ("t", pa.float64())]))
PARTS = "array<struct<home:int,part:binary>>"
_PARTS = pa.list_(pa.struct([("home", pa.int32()), ("part", pa.binary())]))
#: Kinds of rows of a bucket besides the replies of its turns.
STATE, QUESTION = -1, 1 << 30


def total_rows(b: Bucket) -> list[dict]:
    x = b.totals()
    return [{"level": k, "context": int(i), "c": float(x[f"c{k}"][i]), "t": float(x[f"t{k}"][i])} for k in (0, 1) for i in np.flatnonzero(x[f"c{k}"])]


def blobs(t: pa.Table, key: str) -> dict[int, bytes]:
    return dict(zip(t.column(key).to_pylist(), t.column("blob").to_pylist(), strict=True))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 17, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of each row of docs. learn: which rows the model learns from."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), learn.alias("learn"))
    size = own.agg(F.sum(F.octet_length("text") + 8).alias("n")).first().n or 0
    buckets = int(max(6, -(-size // BUCKET_BYTES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            stream, asks = listed(parts, buckets)
            ids = pa.concat_arrays([b.column("id") for b in parts])
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * (len(asks) + 1), pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([block] * (len(asks) + 1), pa.int64()), pa.array([-1] + [k for k, _ in asks], pa.int32()), pa.array([stream] + [q for _, q in asks], pa.binary()), lists], ["block", "bucket", "blob", "ids"])

        parts, held = [], 0
        for batch in batches:
            for b in pieces(batch, "text", min(block_bytes, 1 << 20)):
                _, at = buffers(b.column("text"))
                if parts and held + at[-1] > block_bytes:
                    yield row(parts)
                    parts, held, block = [], 0, block + 1
                parts.append(b)
                held += int(at[-1]) + 8 * b.num_rows
        if parts:
            yield row(parts)

    dealt = stored(own.mapInArrow(lean(deal), f"block long, bucket int, blob binary, ids array<{kind}>"))

    def number(t: pa.Table) -> pa.Table:
        k = t.column("bucket")[0].as_py()
        replies, sums = numbered(t.column("blob").to_pylist(), k, buckets)
        rest = [[x] + [0] * (t.num_rows - 1) for x in sums]
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "blob": pa.array(replies, pa.binary())} | {name: pa.array(x, pa.int64()) for name, x in zip(("n", "v", "o2", "o3"), rest, strict=True)})

    numbers = stored(dealt.filter("bucket >= 0").select("block", "bucket", "blob").groupBy("bucket").applyInArrow(lean(number), "block long, bucket int, blob binary, n long, v long, o2 long, o3 long"))
    release(spark)
    streams, numbered_words = dealt.filter("bucket < 0"), numbers.select("block", "bucket", "blob")

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for stream in left.column("blob").to_pylist():
            w, c, n, cut, *_ = distinct(stream, blobs(right, "bucket"), buckets)
            out += [(k, question(w[x:y], c[x:y], n[x:y])) for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
        return pa.table({"bucket": pa.array([k for k, _ in out], pa.int32()), "block": pa.array(left.column("block").to_pylist()[:1] * len(out), pa.int64()), "blob": pa.array([q for _, q in out], pa.binary())})

    pairs = stored(streams.select("block", "blob").groupBy("block").cogroup(numbered_words.groupBy("block")).applyInArrow(lean(ask), "bucket int, block long, blob binary"))
    release(spark)

    def gather(t: pa.Table) -> pa.Table:
        b = Bucket.gathered(t.column("blob").to_pylist())
        ones = [int((b.counts == k).sum()) for k in (1, 2)]
        return pa.table({
            "bucket": t.column("bucket").slice(0, 1), "blob": pa.array([b.bytes()], pa.binary()), "parts": pa.array([b.sends(buckets)], _PARTS),
            "totals": pa.array([total_rows(b)], _TOTALS), "o0": pa.array(ones[:1], pa.int64()), "o1": pa.array(ones[1:], pa.int64()),
        })

    held = stored(pairs.groupBy("bucket").applyInArrow(lean(gather), f"bucket int, blob binary, parts {PARTS}, totals {TOTALS}, o0 long, o1 long"))
    release(spark)
    sums = numbers.agg(*[F.sum(x).alias(x) for x in ("n", "v", "o2", "o3")]).crossJoin(held.agg(F.sum("o0").alias("o0"), F.sum("o1").alias("o1"))).first()
    n_train, vocabulary = sums.n or 0, sums.v or 0
    part = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    low, top = part(sums.o0 or 0, sums.o1 or 0), part(sums.o2 or 0, sums.o3 or 0)
    discount = [top, (low + top) / 2, low]
    seen = [contexts_of(held) | {"v": vocabulary}]  # totals of the upper levels before each sweep, and after the last

    def total(t: pa.Table) -> pa.Table:
        return pa.table({"bucket": t.column("bucket"), "home": t.column("home"), "blob": pa.array(summed(t.column("part").to_pylist()), pa.binary())})

    def replied(df: DataFrame, turn: int) -> DataFrame:
        """Rows of the buckets with the totals of their contexts before a turn."""
        sent = df.select("bucket", F.explode("parts").alias("x")).select("bucket", "x.home", "x.part")
        got = stored(sent.groupBy("home").applyInArrow(lean(total), "bucket int, home int, blob binary"))
        done.append(got)
        return got.select("bucket", F.lit(turn).alias("kind"), F.col("home").cast("long").alias("block"), "blob")

    def seated_bucket(t: pa.Table, turns: int) -> tuple[Bucket, list[dict]]:
        """The bucket after so many sweeps, and all totals it has got. Seats follow from the seed and the totals, so no sweep's seats are stored."""
        rows: dict[int, dict[int, bytes]] = {}
        for turn, block, blob in zip(*[t.column(c).to_pylist() for c in ("kind", "block", "blob")], strict=True):
            if turn != QUESTION:
                rows.setdefault(turn, {})[block] = blob
        b, k = Bucket.of(rows[STATE][0]), t.column("bucket")[0].as_py()
        all_ = [seen[i] | b.received(rows.get(i, {}), buckets) for i in range(len(seen))]
        for turn in range(turns):
            b.sweep(all_[turn], discount, np.random.default_rng([seed, turn, k]))
            if turn <= burn_in:
                b.samples = b.samples[-1:]
        return b, all_

    def seat(turns: int):
        def after(t: pa.Table) -> pa.Table:
            b, _ = seated_bucket(t, turns)
            return pa.table({"bucket": t.column("bucket").slice(0, 1), "parts": pa.array([b.sends(buckets)], _PARTS), "totals": pa.array([total_rows(b)], _TOTALS)})

        return after

    done = [pairs, held]  # what the answers are made from
    rows = held.select("bucket", F.lit(STATE).alias("kind"), F.lit(0).cast("long").alias("block"), "blob").unionByName(replied(held, 0))
    for turn in range(sweeps):
        seats = stored(rows.groupBy("bucket").applyInArrow(lean(seat(turn + 1)), f"bucket int, parts {PARTS}, totals {TOTALS}"))
        seen.append(contexts_of(seats) | {"v": vocabulary})
        rows = rows.unionByName(replied(seats, turn + 1))
        discard(seats)
        release(spark)

    def reply(t: pa.Table) -> pa.Table:
        b, all_ = seated_bucket(t, sweeps)
        out = [(block, b.answer(q, all_[min(sweeps, burn_in + 1) :], discount)) for turn, block, q in zip(*[t.column(c).to_pylist() for c in ("kind", "block", "blob")], strict=True) if turn == QUESTION]
        return pa.table({"block": pa.array([x for x, _ in out], pa.int64()), "bucket": pa.array(t.column("bucket").to_pylist()[:1] * len(out), pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    asked_rows = rows.unionByName(pairs.select("bucket", F.lit(QUESTION).alias("kind"), "block", "blob"))
    answers = stored(asked_rows.groupBy("bucket").applyInArrow(lean(reply), "block long, bucket int, blob binary"))
    discard(*done)
    release(spark)
    replies = answers.withColumn("kind", F.lit(1)).unionByName(numbered_words.withColumn("kind", F.lit(0)))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"id": left.column("ids").combine_chunks().flatten().slice(0, 0), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})]
        kinds = np.array(right.column("kind").to_pylist())
        number, answer = (blobs(right.take(np.flatnonzero(kinds == i)), "bucket") for i in (0, 1))
        for stream, ids in zip(left.column("blob").to_pylist(), left.column("ids").combine_chunks(), strict=True):
            w, _, _, cut, pair, text, n = distinct(stream, number, buckets)
            count, logs = np.zeros(len(w)), np.zeros(len(w))
            for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                if y > x:
                    per_word, chance = opened(answer[k])
                    new = np.concatenate([[True], w[x + 1 : y] != w[x : y - 1]])
                    count[x:y], logs[x:y] = per_word[np.cumsum(new) - 1], chance
            base = np.log10((count[pair] + 1) / (n_train + vocabulary + 1))
            out.append(pa.table({"id": ids.values, "n_tokens": pa.array(np.bincount(text, minlength=n)), "n_known": pa.array(np.bincount(text, count[pair] > 0, n).astype(np.int64)), "base_score": pa.array(np.bincount(text, base, n)), "score": pa.array(np.bincount(text, logs[pair], n))}))
        return pa.concat_tables(out)

    out = streams.select("block", "blob", "ids").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lean(scored), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
