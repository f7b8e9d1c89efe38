"""N-gram Jaccard join with signature trees.

A text's set holds 64-bit digests of its word n-grams. Texts with equal sets form a class. Two sets that
link differ in so few n-grams that, cut into a little more ranges of digests than that, they agree in a
whole range; classes that agree in a range stand in a signature tree: every node has the OR of its members'
token bitmaps and their range of sizes, and a dual traversal drops pairs of nodes whose largest possible
overlap is below what a link needs. What is left, chained together, is a cluster. Within a cluster another
dual traversal skips what is already connected and compares the sets exactly.

Groups of classes that agree in a range move on to the pack of their least class, where equal groups of many ranges fall
together, so that a class sends its bitmap to few packs however many buckets there are; large groups stay with their bucket.
A pack sends a forest, each class beside the least one that its chain reaches there. A range that an eighth of a task's classes
have is chained in the task, and one class of it goes on.

A cluster beyond a block is joined block by block with its most central members in each (those that share most
with a sample of a block); only members that this leaves outside the cluster's main component are then taken to
every block, so no link between different components is lost and copies are never expanded into pairs.

Null and empty texts have empty sets and link with nothing; an empty table gives an empty one. With fewer
words than n the whole sequence is the only n-gram. A very long text is a piece of its own in a task. Rows
that repeat an id are one document of the component of each of their texts; a null id sorts after all others.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafcalc.llm.common import FOLD, SPACED, U64, buffers, discard, lean, mix, pieces, range_hashes, release, small, spans, stored
from sheafcalc.llm.components import components

#: Ratio of neighbouring size classes, classes of a block, children of a node, 64-bit words of a bitmap at least and at most, classes broadcast at most.
GROWTH, BLOCK, FAN, NARROWEST, BITMAP, BROADCAST_ROWS = 1.6, 2048, 8, 2, 128, 400_000
#: Leaders compared with all members before the traversal, node pairs looked at together, and words of the widest bitmaps.
LEADERS, PORTION, WIDEST = 4, 4_000, 256
#: Members of a group at most whose bitmaps are compared pair by pair: finding the centre of more takes fewer comparisons.
PAIRWISE = 128
#: n-grams of the sets of a block or pack at most, members of a block that the centre is estimated from, central members of a cluster.
BLOCK_GRAMS, SAMPLE, HUBS = 1 << 20, 64, 8
#: Bytes of text whose range digests share a bucket, buckets at most (16 M of them hold 256 TB), keys that a task gathers before it sends.
BUCKET_BYTES, BUCKETS, FLUSH_KEYS = 16 << 20, 1 << 24, 1_000_000
#: Classes of a group at most that moves to the pack of its least class.
LOCAL = 64
#: A range is hot in a task where so many of the gathered classes have it: an eighth, and 256 at least.
HOT_PART, HOT_LEAST = 8, 256
#: A class that holds more than this part of all rows is dealt over several tasks when rows fetch their component.
ROW_PART = 512
PRIME = U64(0x9E3779B97F4A7C15)


def ngram_sets(b: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the n-grams of each text, in order of text and digest without repeats; their text; offsets by text."""
    data, at = buffers(b.column("text"))
    data = FOLD[data]
    s, e, owner = spans(data, at, SPACED)
    words = range_hashes(data, s, e)
    count = np.bincount(owner, minlength=b.num_rows)
    grams = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        grams = grams * PRIME + words[k : k + len(grams)]
    whole = owner[: len(grams)] == owner[n - 1 :] if len(grams) else np.zeros(0, bool)
    h, doc = mix(grams[whole]), owner[: len(grams)][whole]
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        one = np.zeros(len(short), U64)
        for k in range(n - 1):
            here = count[short] > k
            one[here] = one[here] * PRIME + words[first[short[here]] + k]
        h = np.concatenate([h, mix(one ^ mix(count[short].astype(U64)))])
        doc = np.concatenate([doc, short])
    h, doc = by_text(h, doc)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, doc, np.searchsorted(doc, np.arange(b.num_rows + 1))


def by_text(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests in order of text and digest. One word holds the text and the upper bits of the digest, and is sorted much faster
    than two; where different digests of a text agree in those bits, both are."""
    bits = U64(max(1, int(doc.max(initial=0)).bit_length()))
    order = np.argsort((doc.astype(U64) << (U64(64) - bits)) | (h >> bits))
    x, y = h[order], doc[order]
    if ((x[1:] < x[:-1]) & (y[1:] == y[:-1])).any():
        order = np.lexsort((h, doc))
        x, y = h[order], doc[order]
    return x, y


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Wrapping sums of values between offsets."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def class_ids(h: np.ndarray, at: np.ndarray, split: np.ndarray | None = None, bits: int = 64) -> np.ndarray:
    """An id of each set from its members alone. Ids in `split`, which different sets share, give way to a second digest."""
    out = mix(sums(mix(h ^ U64(0x5851F42D4C957F2D)), at) + np.diff(at).astype(U64) * PRIME) >> U64(64 - bits)
    if split is not None and len(split):
        shared = np.isin(out.view(np.int64), split)
        out[shared] = second_ids(h, at)[shared]
    return out.view(np.int64)


def second_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A digest of each set that is independent of its id."""
    return mix(sums(mix(mix(h + U64(0x632BE59BD9B4E019))), at) ^ U64(0x2545F4914F6CDD1D))


class Ranges:
    """Size classes, and how many ranges of digests a class has, for a link at num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.differ = lambda b: 2 * b * (den - num) // (den + num)
        starts = [next(b for b in range(1, 10 * den) if self.differ(b) > 0)]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1] + 1, int(starts[-1] * GROWTH)))
        self.starts = np.array(starts)
        most = np.array([self.differ(b - 1) for b in starts[1:]])
        self.spare = 2 + most * 8 // 100
        self.counts = most + 1 + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1

    def keys(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range digests and the set of each. A set takes the ranges of its own size class and of those that larger
        sets it may link with have; a range without members counts only where a set has more such ranges than are spare."""
        n = np.diff(at)
        low, high = self.of(n), self.of(n * self.den // self.num)
        out = []
        for step in range(int((high - low).max(initial=0)) + 1):
            j = low + step
            sets = np.flatnonzero((j <= high) & (j >= 0) & (n > 0))
            if not len(sets):
                continue
            m = self.counts[j[sets]].astype(U64)
            size = n[sets]
            member = np.repeat(at[:-1][sets] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            own = np.repeat(np.arange(len(sets)), size)
            x = h[member]
            part = ((x >> U64(32)) * m[own]) >> U64(32)
            tag = own.astype(U64) * U64(1 << 32) + part
            edge = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
            got = sums(mix(x), np.concatenate([edge, [len(x)]]))
            salt = lambda s, p: mix(p * PRIME + j[sets][s].astype(U64) + U64(1))
            out.append((mix(got ^ salt(own[edge], part[edge])), sets[own[edge]]))
            empty = m.astype(np.int64) - np.bincount(own[edge], minlength=len(sets))
            for s in np.flatnonzero(empty > self.spare[j[sets]]):
                gone = np.setdiff1d(np.arange(int(m[s]), dtype=U64), part[own == s])
                out.append((mix(salt(np.full(len(gone), s), gone)), np.full(len(gone), sets[s])))
        if not out:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def contracted(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id), ordered by them, without the members of hot keys but their least; and the edges (member, least) of those."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids = key[new], ids[new]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    hot = np.repeat(size >= max(HOT_LEAST, len(np.unique(ids)) // HOT_PART), size)
    rest = hot.copy()
    rest[edge] = False
    chain = np.stack([ids, np.repeat(ids[edge], size)], 1)[rest]
    return key[~rest], ids[~rest], np.unique(chain, axis=0)


def packed(key: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of pairs: 40 bits of each key beside the bucket (equal ones make candidates, no more), and each id once with a count."""
    bucket = (key & U64(BUCKETS - 1)).astype(np.int64) % buckets
    order = np.lexsort((key, ids, bucket))
    key, ids, bucket = key[order] >> U64(24), ids[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, e in zip(edges, [*edges[1:], len(bucket)], strict=True):
        x, y = key[a:e], ids[a:e]
        edge = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
        runs = np.diff(np.concatenate([edge, [len(y)]])).astype(np.uint32)
        yield int(bucket[a]), struct.pack("<II", len(x), len(edge)) + (x >> U64(8)).astype(np.uint32).tobytes() + x.astype(np.uint8).tobytes() + y[edge].tobytes() + runs.tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = struct.unpack_from("<II", blob)
    take = lambda kind, count, at: np.frombuffer(blob, kind, count, at)
    key = (take(np.uint32, n, 8).astype(U64) << U64(8)) | take(np.uint8, n, 8 + 4 * n).astype(U64)
    at = 8 + 5 * n
    return key, np.repeat(take(np.int64, m, at), take(np.uint32, m, at + 8 * m))


def groups_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the groups that share a key, where a key has several ids, one group after another; and group offsets."""
    got = [unpacked(x) for x in blobs]
    if not got:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    key, ids = np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])
    del got
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
    key, ids = key[new], ids[new]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    ids = ids[np.repeat(size > 1, size)]
    return ids, np.concatenate([[0], np.cumsum(size[size > 1])])


def distinct_groups(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group of at most LOCAL ids once, and the larger ones: ids, one group after another in order of size, and the sizes."""
    at = np.cumsum(sizes) - sizes
    out, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes).tolist():
        rows = ids[at[sizes == n][:, None] + np.arange(n)]
        new = np.ones(len(rows), bool)
        if n <= LOCAL:  # few large groups are equal
            rows = rows[np.lexsort(rows.T[::-1])]
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        out.append(rows[new].ravel())
        counts.append(np.full(int(new.sum()), n))
    return np.concatenate(out), np.concatenate(counts)


def dealt(ids: np.ndarray, sizes: np.ndarray, own: int, packs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups in order of their pack: that of the least class, or `own` for large ones. ids, sizes, the packs, and the offsets
    of each pack's ids and sizes."""
    at = np.cumsum(sizes) - sizes
    pack = np.where(sizes <= LOCAL, (mix(ids[at].view(U64)) % U64(packs)).astype(np.int64), own)
    order = np.argsort(pack, kind="stable")
    pack, size = pack[order], sizes[order]
    ids = ids[np.repeat(at[order] - np.cumsum(size) + size, size) + np.arange(len(ids))]
    edge = np.flatnonzero(np.concatenate([[True], pack[1:] != pack[:-1]])) if len(pack) else np.zeros(0, np.int64)
    cut = np.concatenate([edge, [len(pack)]])
    return ids, size, pack[edge], np.concatenate([[0], np.cumsum(size)])[cut], cut


class Signatures:
    """Token bitmaps of sets, their weights and the sizes of the sets."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        self.bits, self.size = bits, size.astype(np.int64)
        self.weight = np.bitwise_count(bits).sum(axis=1).astype(np.int64)

    def of(self, at: np.ndarray) -> Signatures:
        return Signatures(self.bits[at], self.size[at])


def width(size: int) -> int:
    """64-bit words of the bitmap that a set of this size sends: four to eight bits a token, as far as the widest goes."""
    return min(BITMAP, max(NARROWEST, 1 << (size // 16).bit_length()))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least one that the edges a, b connect it with."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[a], least[b])
        old = least.copy()
        for x in (a, b, least[a], least[b]):
            np.minimum.at(least, x, m)
        least = least[least]
        if np.array_equal(old, least):
            return least


class Bitmaps:
    """Bitmaps of several widths; sets of one group are compared at the width of the narrowest, to which wider ones fold."""

    def __init__(self, raw: list[bytes], size: np.ndarray):
        self.size, self.words = size, np.array([len(x) // 8 for x in raw], np.int64)
        self.raw = {int(w): (k := np.flatnonzero(self.words == w), np.frombuffer(b"".join(raw[i] for i in k.tolist()), U64).reshape(-1, w)) for w in np.unique(self.words)}
        self.made: dict[int, Signatures] = {}

    def at(self, words: int) -> Signatures:
        if words not in self.made:
            bits = np.zeros((len(self.size), words), U64)
            for w, (k, x) in self.raw.items():
                if w >= words:
                    bits[k] = np.bitwise_or.reduce(x.reshape(len(k), w // words, words), axis=1)
            self.made[words] = Signatures(bits, self.size)
        return self.made[words]


def bitmap(tokens: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """A bitmap of so many 64-bit words (a power of two) with the bits of the tokens."""
    out = np.zeros(64 * words, np.uint8)
    out[(tokens & U64(64 * words - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(U64)


class Tree:
    """A signature tree over members `at`: levels of nodes, leaves first. A node has the OR of its members' bitmaps,
    their least weight and their range of sizes; neighbours in the tree have near sizes and near bitmaps."""

    def __init__(self, sig: Signatures, at: np.ndarray):
        order = np.lexsort((sig.bits[at, 0], np.round(np.log(np.maximum(sig.size[at], 1)) * 8)))
        self.members = at[order]
        level = (sig.bits[self.members], sig.weight[self.members], sig.size[self.members], sig.size[self.members])
        self.levels = [level]
        while len(level[0]) > 1:
            edge = np.arange(0, len(level[0]), FAN)
            level = (np.bitwise_or.reduceat(level[0], edge, axis=0), np.minimum.reduceat(level[1], edge), np.minimum.reduceat(level[2], edge), np.maximum.reduceat(level[3], edge))
            self.levels.append(level)


def possible(x: tuple, a: np.ndarray, y: tuple, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of nodes may hold a link: the largest possible overlap against what the smallest sizes need."""
    shared = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1).astype(np.int64)
    most = np.minimum(x[3][a] - np.maximum(0, x[1][a] - shared), y[3][b] - np.maximum(0, y[1][b] - shared))
    fits = (x[3][a] * den >= y[2][b] * num) & (y[3][b] * den >= x[2][a] * num)
    return fits & (most * (num + den) >= num * (x[2][a] + y[2][b]))


def candidates(s: Tree, t: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of two trees that may link, in portions, by dual traversal from the roots."""
    stack = [(len(s.levels) - 1, np.zeros(1, np.int64), len(t.levels) - 1, np.zeros(1, np.int64))]
    while stack:
        i, a, j, b = stack.pop()
        keep = possible(s.levels[i], a, t.levels[j], b, num, den)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if not i and not j:
            yield s.members[a], t.members[b]
            continue
        if i >= j:
            i, a, b = i - 1, (a[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(b, FAN)
            here = a < len(s.levels[i][0])
        else:
            j, a, b = j - 1, np.repeat(a, FAN), (b[:, None] * FAN + np.arange(FAN)).ravel()
            here = b < len(t.levels[j][0])
        a, b = a[here], b[here]
        for k in range(0, len(a), PORTION):
            stack.append((i, a[k : k + PORTION], j, b[k : k + PORTION]))


def centrality(sig: Signatures, among: np.ndarray) -> np.ndarray:
    """For each of some members the mean share of its bits that members of an even sample of them have too."""
    of = among[np.linspace(0, len(among) - 1, min(SAMPLE, len(among))).astype(np.int64)]
    out = np.zeros(len(among))
    for i in of.tolist():
        out += np.bitwise_count(sig.bits[among] & sig.bits[i]).sum(axis=1) / np.maximum(1, np.maximum(sig.weight[among], sig.weight[i]))
    return out / max(1, len(of))


def connected(sig: Signatures, num: int, den: int, linked: Callable[[int, int], bool] | None = None, hubs: list[int] = []) -> list[int]:  # noqa: B006
    """For each member the first member of its component of links (of possible links, where linked is not given).

    Small groups compare all pairs of bitmaps, which is no more than finding their centres takes. In others a few leaders, the hubs and then the most central of what is left, are compared with all members first; that connects groups of near copies at once. Members that
    are in no leader's component go through the dual traversal against all members. What is left are links between
    two leaders' components: each two are traversed until they connect."""
    n = len(sig.size)
    if linked is None and n <= PAIRWISE:
        i, j = np.triu_indices(n, 1)
        leaf = (sig.bits, sig.weight, sig.size, sig.size)
        keep = [np.zeros(0, bool)] + [possible(leaf, i[k : k + PORTION], leaf, j[k : k + PORTION], num, den) for k in range(0, len(i), PORTION)]
        keep = np.concatenate(keep) & (sig.size[i] > 0) & (sig.size[j] > 0)
        return forest(n, i[keep], j[keep]).tolist()
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y and (linked is None or linked(i, j)):
                root[max(x, y)] = min(x, y)

    leaf = (sig.bits, sig.weight, sig.size, sig.size)
    everyone = rest = np.flatnonzero(sig.size > 0)
    for turn in range(len(hubs) + LEADERS):
        if len(rest) < 2:
            break
        first = hubs[turn] if turn < len(hubs) else rest[int(centrality(sig, rest).argmax())]
        lead = np.full(len(everyone), first)
        for k in range(0, len(everyone), PORTION):
            keep = possible(leaf, lead[k : k + PORTION], leaf, everyone[k : k + PORTION], num, den)
            join(lead[k : k + PORTION][keep], everyone[k : k + PORTION][keep])
        one = find(int(lead[0]))
        rest = np.array([i for i in rest.tolist() if find(i) != one], np.int64)
    if len(rest):
        for a, b in candidates(Tree(sig, rest), Tree(sig, everyone), num, den):
            join(a, b)
    parts: dict[int, list[int]] = {}
    for i in np.setdiff1d(everyone, rest).tolist():
        parts.setdefault(find(i), []).append(i)
    trees = [Tree(sig, np.array(x, np.int64)) for x in parts.values()] if len(parts) > 1 else []
    for k, s in enumerate(trees):
        for t in trees[:k]:
            x, y = int(s.members[0]), int(t.members[0])
            if find(x) == find(y):
                continue
            for a, b in candidates(s, t, num, den):
                join(a, b)
                if find(x) == find(y):
                    break
    return [find(i) for i in range(n)]


def linked_parts(sets: list[np.ndarray], num: int, den: int, hubs: list[int] = []) -> list[int]:  # noqa: B006
    """For each set the first set of its component of links."""

    def linked(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        both = len(np.intersect1d(a, b, assume_unique=True))
        return den * both >= num * (len(a) + len(b) - both)

    # With the sets at hand bitmaps are wide: eight bits for each token of the largest set, so bounds are close.
    most = max((len(x) for x in sets), default=0)
    words = min(WIDEST, max(BITMAP, 1 << (max(1, most // 8) - 1).bit_length()))
    bits = np.stack([bitmap(x, words) for x in sets]) if sets else np.zeros((0, words), U64)
    return connected(Signatures(bits, np.array([len(x) for x in sets], np.int64)), num, den, linked, hubs)


def link_classes(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """id, n_shingles and component_id (least id of the component) of each row of docs; links at a similarity of num / den."""
    ranges = Ranges(num, den)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def rows_by(ids_of: Callable[..., np.ndarray]) -> DataFrame:
        @lean
        def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in pieces(whole, "text"):
                    h, _, at = ngram_sets(b, n)
                    size = np.diff(at)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size), pa.array(ids_of(h, at), mask=size == 0), pa.array(second_ids(h, at).view(np.int64))], ["id", "n_shingles", "class", "second"])

        return stored(own.mapInArrow(sized, f"id {kind}, n_shingles long, class long, second long"))

    split = np.zeros(0, np.int64)
    ids_of = lambda h, at: class_ids(h, at, split, id_bits)
    rows = rows_by(ids_of)
    by_class = lambda: rows.filter("n_shingles > 0").groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max("n_shingles").alias("grams"), (F.min("second") != F.max("second")).alias("shared"))
    named = stored(by_class())
    # Of 1e10 different sets about three pairs share an id; those take their second digest.
    if shared := [r[0] for r in named.filter("shared").select("class").collect()]:
        split = np.array(shared, np.int64)
        discard(rows, named)
        rows = rows_by(ids_of)
        named = stored(by_class())
    first = named.select("class", "id", "grams")
    clusters, texts = candidate_clusters(own, first, n, ranges, ids_of)
    links = verified(clusters, texts, num, den)
    linked = components(links).withColumnRenamed("node", "class")
    least = linked.join(first, "class").groupBy("root").agg(F.min("id").alias("component"))
    moved = stored(linked.join(least, "root").select("class", "component"))
    discard(links, linked, clusters)
    release(own.sparkSession)
    total = rows.count()
    copies = F.ceil(F.col("n") * ROW_PART / F.lit(max(total, 1))).cast("int")
    named = named.join(moved, "class", "left").select("class", F.coalesce("component", "id").alias("component"), copies.alias("copies"))
    # At most ROW_PART classes are hot; their rows spread over copies of the class. Empty sets have no class.
    hot = named.filter("copies > 1").select("class", F.col("copies").alias("spread"))
    rows = rows.join(F.broadcast(hot), "class", "left").withColumn("copy", F.pmod(F.xxhash64("id", F.spark_partition_id()), F.coalesce("spread", F.lit(1))))
    placed = rows.filter("n_shingles > 0").join(named.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - F.lit(1).cast("long")))), ["class", "copy"], "left")
    out = placed.select("id", "n_shingles", "component").unionByName(rows.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))


def candidate_clusters(own: DataFrame, first: DataFrame, n: int, ranges: Ranges, ids_of: Callable[..., np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """class, id, cluster of the classes that may link with another by their signatures, directly or in a chain; and
    class, members of those."""
    spark = own.sparkSession
    kind = own.schema["id"].dataType.simpleString()
    size = own.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    buckets = int(min(BUCKETS, max(6, -(-size // BUCKET_BYTES))))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            key, own, chain = contracted(np.concatenate(keys), np.concatenate(ids))
            got = [(k, False, x) for k, x in packed(key, own, buckets)]
            if len(chain):  # goes with any bucket, which passes it on
                got.append((int(U64(chain[0, 1].view(U64)) % U64(buckets)), True, chain.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], t) for j, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], ["bucket", "chain", "blob"])

        for whole in batches:
            for b in pieces(whole, "text"):
                h, _, at = ngram_sets(b, n)
                key, sets = ranges.keys(h, at)
                keys.append(key)
                ids.append(ids_of(h, at)[sets])
                held += len(key)
                if held > FLUSH_KEYS:
                    yield flush()
                    keys, ids, held = [], [], 0
        if held:
            yield flush()

    @lean
    def gather(t: pa.Table) -> pa.Table:
        chain = np.array(t.column("chain").to_pylist())
        blobs = [x.as_py() for x in t.column("blob")]
        ids, at = groups_of([b for b, c in zip(blobs, chain, strict=True) if not c])
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *[np.frombuffer(b, np.int64).reshape(-1, 2) for b, c in zip(blobs, chain, strict=True) if c]]), axis=0)
        bucket = t.column("bucket")[0].as_py()
        ids, sizes, pack, id_cut, cut = dealt(*distinct_groups(ids, np.diff(at)), bucket, buckets)
        out = [(int(k), ids[a:e], sizes[b:f], None, None) for k, a, e, b, f in zip(pack, id_cut, id_cut[1:], cut, cut[1:], strict=False)]
        if len(pairs):
            out.append((bucket, None, None, pairs[:, 0], pairs[:, 1]))
        return pa.table({name: pa.array([x[j] for x in out], k) for j, (name, k) in enumerate((("pack", pa.int32()), ("ids", longs), ("sizes", pa.list_(pa.int32())), ("u", longs), ("v", longs)))})

    @lean
    def merge(t: pa.Table) -> pa.Table:
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids, sizes = distinct_groups(flat("ids"), flat("sizes"))
        pairs = np.unique(np.stack([flat("u"), flat("v")], 1), axis=0)
        lists = [pa.array([x], k) for x, k in ((ids, longs), (sizes.astype(np.int32), pa.list_(pa.int32())), (pairs[:, 0], longs), (pairs[:, 1], longs))]
        return pa.table({"pack": t.column("pack").slice(0, 1)} | dict(zip(("ids", "sizes", "u", "v"), lists, strict=True)))

    longs = pa.list_(pa.int64())
    form = "pack int, ids array<long>, sizes array<int>, u array<long>, v array<long>"
    met = own.select("text").mapInArrow(run, "bucket int, chain boolean, blob binary").groupBy("bucket").applyInArrow(gather, form)
    groups = stored(met.groupBy("pack").applyInArrow(merge, form))
    release(spark)
    uses = groups.select(F.col("pack").alias("of_pack"), F.explode(F.array_distinct("ids")).alias("class"))
    wanted = stored(uses.select("class").distinct().join(first, "class"))
    n_wanted = wanted.count()

    @lean
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                h, _, at = ngram_sets(b, n)
                bits = [bitmap(h[i:e], width(int(e - i))).tobytes() for i, e in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids_of(h, at)), pa.array(np.diff(at)), pa.array(bits, pa.binary())], ["id", "class", "size", "bits"])

    @lean
    def prune(left: pa.Table, right: pa.Table) -> pa.Table:
        known, row = np.unique(right.column("class").to_numpy(), return_index=True)
        raw = right.column("bits").to_pylist()
        maps = Bitmaps([raw[i] for i in row.tolist()], right.column("size").to_numpy()[row])
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ids, size in zip(left.column("ids"), left.column("sizes"), strict=True):
            ids, size = ids.values.to_numpy(), size.values.to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            own = np.searchsorted(known, ids)
            if len(ids) and (own.max() >= len(known) or (known[own] != ids).any()):
                raise ValueError("a class of a pack has no set")
            # Groups of at most a leaf node are compared together, each pair of the pack once.
            a, b = [], []
            for count in range(2, FAN + 1):
                start = at[:-1][size == count]
                for i in range(count):
                    for j in range(i + 1, count):
                        a.append(own[start + i])
                        b.append(own[start + j])
            pairs = np.unique(np.concatenate([np.minimum(x, y) * len(known) + np.maximum(x, y) for x, y in zip(a, b, strict=True)]))
            x, y = np.divmod(pairs, max(1, len(known)))
            narrow = np.minimum(maps.words[x], maps.words[y])
            for w in np.unique(narrow).tolist():
                sig = maps.at(w)
                leaf = (sig.bits, sig.weight, sig.size, sig.size)
                here = np.flatnonzero(narrow == w)
                for k in range(0, len(here), PORTION):
                    p, q = x[here[k : k + PORTION]], y[here[k : k + PORTION]]
                    keep = possible(leaf, p, leaf, q, ranges.num, ranges.den)
                    us.append(p[keep])
                    vs.append(q[keep])
            seen = set()
            for k in np.flatnonzero(size > FAN):
                group = own[at[k] : at[k + 1]]
                if (tag := group.tobytes()) not in seen:
                    seen.add(tag)
                    roots = np.array(connected(maps.at(int(maps.words[group].min())).of(group), ranges.num, ranges.den))
                    other = np.flatnonzero(roots != np.arange(len(group)))
                    us.append(group[other])
                    vs.append(group[roots[other]])
        least = forest(len(known), np.concatenate(us), np.concatenate(vs))
        moved = np.flatnonzero(least != np.arange(len(known)))
        return pa.table({"u": pa.array(known[moved], pa.int64()), "v": pa.array(known[least[moved]], pa.int64())})

    asked = F.broadcast(wanted) if n_wanted <= BROADCAST_ROWS else wanted
    # The id narrows the join to one row of a class; rows that repeat an id may have other texts, and only the class asked for counts.
    bits = own.mapInArrow(signed, f"id {kind}, class long, size long, bits binary").alias("b").join(asked.alias("w"), F.expr("b.class = w.class AND b.id <=> w.id")).select("b.class", "size", "bits")
    edges = groups.filter(F.size("ids") > 0).groupBy("pack").cogroup(uses.join(bits, "class").groupBy("of_pack")).applyInArrow(prune, "u long, v long")
    chains = groups.select(F.explode(F.arrays_zip("u", "v")).alias("e")).select("e.u", "e.v")
    edges = stored(edges.unionByName(chains).distinct())
    discard(groups, wanted)
    release(spark)
    found = components(edges)
    clusters = stored(found.select(F.col("node").alias("class"), F.col("root").alias("cluster")).join(first, "class"))
    discard(edges, found)
    release(spark)
    return clusters, members_of(own, clusters, n, ids_of)


def members_of(own: DataFrame, classes: DataFrame, n: int, ids_of: Callable[..., np.ndarray]) -> DataFrame:
    """class and members (digests of its n-grams) of the classes, read again from one text of each (a repeated row repeats them)."""

    @lean
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                h, _, at = ngram_sets(b, n)
                yield pa.RecordBatch.from_arrays([b.column("class"), pa.array(ids_of(h, at)), pa.array([h[i:e].tobytes() for i, e in zip(at, at[1:], strict=False)], pa.binary())], ["class", "got", "members"])

    @lean
    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                h, _, at = ngram_sets(b, n)
                yield pa.RecordBatch.from_arrays([b.column("text"), pa.array(ids_of(h, at))], ["text", "class"])

    count, named = classes.agg(F.count("*"), F.count("id")).first()
    texts = own.join(small(classes.select("class", "id"), count, BROADCAST_ROWS), "id").select("text", "class")
    if named < count:
        # Classes without an id are found by the texts themselves, one of each class.
        nameless = own.filter("id IS NULL").select("text").mapInArrow(classed, "text string, class long")
        nameless = nameless.join(small(classes.filter("id IS NULL").select("class"), count - named, BROADCAST_ROWS), "class")
        texts = texts.unionByName(nameless.groupBy("class").agg(F.min("text").alias("text")))
    return texts.mapInArrow(members, "class long, got long, members binary").filter("class = got").drop("got")


def verified(clusters: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: links (or chains of links) between classes of one cluster, enough to connect every component."""
    spark = clusters.sparkSession
    sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = stored(clusters.select("class", "cluster").join(sizes, "cluster"))
    n_placed, n_grams = clusters.agg(F.count("*"), F.sum("grams")).first()
    packs = int(max(1, n_placed // 256, 4 * (n_grams or 0) // BLOCK_GRAMS))
    many = F.col("blocks") > 1
    # A cluster beyond one block is dealt over blocks by class; its hubs stand in each.
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    sets = sets.join(small(placed, n_placed, BROADCAST_ROWS), "class")
    some_large = placed.filter(many).limit(1).count() > 0
    hubs = stored(hubs_of(sets.filter(many).withColumn("block", block))) if some_large else placed.limit(0).select("class")
    is_hub = F.col("hub") & many
    of = F.when(~many, F.array(F.lit(0))).when(is_hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    sets = sets.join(F.broadcast(hubs.withColumn("hub", F.lit(True))) if not some_large or hubs.count() <= BROADCAST_ROWS else hubs.withColumn("hub", F.lit(True)), "class", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))

    @lean
    def join(t: pa.Table) -> pa.Table:
        u, v = [], []
        by: dict[int, list[int]] = {}
        ids, raw, hub = t.column("class").to_pylist(), t.column("members"), t.column("hub").to_pylist()
        seen = set()
        for i, c in enumerate(t.column("cluster").to_pylist()):
            if ids[i] not in seen:
                seen.add(ids[i])
                by.setdefault(c, []).append(i)
        for at in by.values():
            roots = linked_parts([np.frombuffer(raw[i].as_py(), U64) for i in at], num, den, [k for k, i in enumerate(at) if hub[i]])
            for i, r in enumerate(roots):
                if r != i:
                    u.append(ids[at[i]])
                    v.append(ids[at[r]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def joined(units: DataFrame, keys: list[Column]) -> DataFrame:
        dealt = units.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], "class", "cluster", "members", "hub")
        return stored(dealt.groupBy("k0", "k1", "k2").applyInArrow(join, "u long, v long"))

    alone = F.lit(-1)
    units = sets.withColumn("block", F.explode(of))
    links = joined(units, [F.when(many, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(packs))), F.when(many, F.col("block")).otherwise(alone), F.lit(0)])
    release(spark)
    if not some_large:
        discard(placed)
        return links
    large = sets.filter(many).withColumn("hub", F.lit(False))
    # Members outside the main component of a large cluster meet every block of it.
    roots = components(links).withColumnRenamed("node", "class")
    parts = placed.filter(many).join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    counts = parts.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    outside = stored(parts.join(main, "cluster").filter("root <> main").select("class", "cluster", "blocks"))
    if not outside.limit(1).count():
        discard(placed, hubs, outside, roots)
        return links
    # Chunks of the outsiders are as large as blocks of the cluster.
    chunks = outside.groupBy("cluster").agg(F.count("*").alias("n")).join(placed.groupBy("cluster").agg(F.count("*").alias("size"), F.max("blocks").alias("b")), "cluster")
    chunks = chunks.select("cluster", F.ceil(F.col("n") * F.col("b") / F.col("size")).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("class", F.lit(1)), F.col("chunks")).cast("int")
    n_outside = outside.count()
    stray = large.join(small(outside.select("class"), n_outside, BROADCAST_ROWS), "class").join(chunks, "cluster").select("class", "cluster", "members", "hub", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    there = large.join(chunks, "cluster").select("class", "cluster", "members", "hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), block.alias("block"))
    again = joined(stray.unionByName(there), [F.col("cluster"), F.col("block"), F.col("chunk")])
    both = stored(links.unionByName(again))
    discard(links, again, outside, placed, hubs, roots)
    return both


def hubs_of(sets: DataFrame) -> DataFrame:
    """class of the most central members of each large cluster, by the bitmaps of its blocks."""

    @lean
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [bitmap(np.frombuffer(x.as_py(), U64)).tobytes() for x in b.column("members")]
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("cluster"), b.column("block"), pa.array(bits, pa.binary())], ["class", "cluster", "block", "bits"])

    @lean
    def central(t: pa.Table) -> pa.Table:
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), U64).reshape(-1, BITMAP)
        score = centrality(Signatures(bits, np.ones(len(bits))), np.arange(len(bits)))
        best = np.argsort(-score, kind="stable")[:HUBS]
        return pa.table({"class": t.column("class").take(pa.array(best)), "cluster": t.column("cluster").take(pa.array(best)), "score": pa.array(score[best])})

    bits = sets.select("class", "cluster", "block", "members").mapInArrow(signed, "class long, cluster long, block int, bits binary")
    found = bits.groupBy("cluster", "block").applyInArrow(central, "class long, cluster long, score double").groupBy("class", "cluster").agg(F.max("score").alias("score"))
    by = Window.partitionBy("cluster").orderBy(F.desc("score"), "class")
    return found.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= HUBS).select("class")
