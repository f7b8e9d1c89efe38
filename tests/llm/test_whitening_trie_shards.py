"""Whitening, prefix trie and shards against brute force, on tables of nulls, empties, repeats, ties and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from sheafcalc.llm import prefix_trie, sharding, whitening

NAN, INF = float("nan"), float("inf")


# --- whitening -------------------------------------------------------------------------------------


def vectors(n, d, seed=5):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.linspace(0.2, 2, d) + 3).tolist()


@pytest.mark.parametrize("parts, leaf", [(1, 4096), (9, 7)])
def test_whitening_is_that_of_the_whole_covariance(spark, monkeypatch, parts, leaf):
    monkeypatch.setattr(whitening, "LEAF_ROWS", leaf)
    v = vectors(200, 6)
    rows = [(i, x, "n", 1) for i, x in enumerate(v)] + [(900, v[0], "n", 1), (0, v[1], "n", 1), (None, v[2], "n", 1), (901, None, "n", 1), (902, [1.0] * 5 + [NAN], "n", 1), (903, [1.0] * 5 + [-INF], "n", 1), (904, [1.0] * 5 + [None], "n", 1), (905, [], "n", 1), (906, [1.0, 2.0], "n", 1), (907, [-0.0] * 6, "n", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component int").repartition(parts)
    got = whitening.whitened(df).collect()
    kept = [(i, [math.floor(256 * c) + 0 for c in x]) for i, x, *_ in rows if x and len(x) == 6 and all(c is not None and math.isfinite(c) for c in x)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(0)
    e, w = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    e, w = e[::-1], w[:, ::-1]
    assert collections.Counter(r.vec_id for r in got) == collections.Counter({i: 4 * k for i, k in collections.Counter(i for i, _ in kept).items()})
    want = collections.Counter((i, sum(int(n * a - b) ** 2 for a, b in zip(x, s.tolist(), strict=True))) for i, x in kept for _ in range(4))
    assert collections.Counter((r.vec_id, r.deviation) for r in got) == want
    by = {i: (np.array(x) - s / n) @ w[:, :4] / np.sqrt(e[:4]) for i, x in kept if i not in (0, None)}
    signs = np.sign([[next(r.whitened for r in got if r.vec_id == 1 and r.component == k + 1) * by[1][k]] for k in range(4)]).ravel()
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9
        if r.vec_id in by:
            assert abs(r.whitened - signs[r.component - 1] * by[r.vec_id][r.component - 1]) < 1e-8


def test_whitening_of_few_flat_or_huge_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, []), (3, [NAN])], kind)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    two = sorted(whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [1.0, 4.0, 0.0])], kind)).collect(), key=lambda r: (r.vec_id, r.component))
    assert [r.component for r in two] == [1, 2, 3, 1, 2, 3] and {r.n for r in two} == {2} and {r.deviation for r in two} == {512**2}
    assert sorted(r.whitened for r in two if r.component == 1) == pytest.approx([-1, 1]) and all(r.whitened is None for r in two if r.component > 1)
    big = whitening.whitened(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [1.0, 5.0])], kind)).collect()
    assert len(big) == 6 and all(r.deviation is None for r in big if r.vec_id != 3)


def test_summaries_merge_without_loss():
    x = np.array([[math.floor(256 * c) for c in v] for v in vectors(90, 8)], np.int64)
    whole, parts = whitening.Summary.of(x), [whitening.Summary.of(x[i : i + 11]) for i in range(0, 90, 11)]
    total = parts[0]
    for p in parts[1:]:
        total = total.merged(p)
    assert total.n == whole.n and total.sums == whole.sums
    assert np.allclose(total.axes.T @ total.axes, whole.axes.T @ whole.axes, rtol=1e-12)


# --- prefix trie -----------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(ts)] for c, ts in own.items()}
    made = {c: own.get(c - math.fmod(c, 5), [])[: (h := zlib.crc32(str(c).encode()) % 9)] + ts[h:] for c, ts in own.items()}
    nodes = collections.defaultdict(set)
    for c, p in made.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].add(c)
    children = collections.defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    out = []

    def below(k):
        stack, found = [k], []
        while stack:
            found.append(stack.pop())
            stack += children[found[-1]]
        return found

    for k, m in nodes.items():
        sub = below(k)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == len(k)))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children[k]), sum(not children[u] for u in sub), sum((len(nodes[u]) - 1) * len(u[-1][1].encode()) for u in sub if u), hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(seed=3, many=60):
    r = random.Random(seed)
    words = ["", "hi", "hello there", "é", "how are you", None]
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(words)) for c in range(-12, many) for t in range(r.randrange(0, 7))]
    rows += [(c, t, "user", "same") for c in range(200, 320) for t in range(3)]  # many copies
    rows += [(c, t, "user", f"turn {t}") for c in (400, 401, 402) for t in range(400)]  # deep
    rows += [(5, None, "user", "first"), (5, None, "bot", "first"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (None, 0, "user", "lost"), (7, 3, "user", "x" * 1_500_000), (8, 3, "user", "y z " * 400_000), (12345678901, 0, "user", "hi")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_bytes, held", [(1 << 24, 1 << 24), (300, 1 << 24), (900, 0)])
def test_trie(spark, monkeypatch, range_bytes, held):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = talks()
    df = spark.createDataFrame([(*x, 1, "d") for x in rows], "conv_id long, turn long, role string, text string, depth int, key string").repartition(3)
    got = collections.Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df, range_bytes, held).collect())
    assert got == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    kind = "conv_id long, turn int, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], kind)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 0, "user", "a")], kind)).count() == 0


def test_turnless_conversation(spark):
    """Conversation c keeps nothing of its own where the one it begins with is not there and h covers all its turns."""
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    got = prefix_trie.trie(spark.createDataFrame([(c, 0, "user", "a")], "conv_id long, turn int, role string, text string")).collect()
    assert [tuple(r[x] for x in COLUMNS) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_loser_tree_merges_and_carries_prefixes():
    r = random.Random(1)
    rec = lambda k: bytes([k]) * prefix_trie.RECORD
    rows = [(b"".join(rec(r.randrange(3)) for _ in range(r.randrange(6))), i) for i in range(300)]
    for k in (1, 2, 3, 7, 40):
        runs = []
        for i in range(k):
            run, before = [], b""
            for path, c in sorted(rows[i::k]):
                run.append((path, c, prefix_trie.common(before, path)))
                before = path
            runs.append(iter(run))
        out = list(prefix_trie.LoserTree(runs))
        assert [x[:2] for x in out] == sorted(rows)
        assert [x[2] for x in out[1:]] == [prefix_trie.common(a[0], b[0]) for a, b in zip(out, out[1:], strict=False)]
    assert list(prefix_trie.LoserTree([])) == []


def test_conversation_crc_in_sql():
    """The SQL spells CRC-32 by hand; a table of single turns shows what it takes h to be."""
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations AS SELECT 5 * i AS conv_id, t AS turn, 'u' AS role, 'x' || t AS text FROM range(40) a(i), range(9) b(t)")
    got = con.sql(prefix_trie.oracle_sql()).fetchall()
    assert max(r[1] for r in got) == 9 and len(got) == 10


# --- shards ----------------------------------------------------------------------------------------


def sharded(df, **kw):
    return [r.asDict() for r in sharding.shards(df, **kw).collect()]


def holds(got, texts, shards=16):
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    counts = collections.Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(shards)) and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def spread(got):
    """Sizes of the parts into which each group of equal texts is split."""
    parts = collections.defaultdict(collections.Counter)
    for r in got:
        parts[r["text_crc32"], r["size"]][r["shard"]] += 1
    return parts


def test_groups_stay_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BIN_ROWS", 8)
    texts = [(i, f"lone {i}") for i in range(300)] + [(1000 + 10 * g + k, f"group {g}") for g in range(30) for k in range(2 + g % 6)] + [(None, "lone null"), (None, None), (5, ""), (6, ""), (7, "x" * 1_200_000), (8, "long text " * 150_000), (1, "lone 1")]
    df = spark.createDataFrame([(*x, 1, "s") for x in texts], "doc_id long, text string, shard int, row string").repartition(5)
    got = sharded(df)
    holds(got, texts)
    assert all(len(p) == 1 for p in spread(got).values())


def test_group_larger_than_a_shard_fills_shards(spark, monkeypatch):
    """A third of all rows are copies: they nearly fill five shards of sixteen, with a rest in one or two others."""
    monkeypatch.setattr(sharding, "HEAVY", 50)
    texts = [(i, "hot") for i in range(533)] + [(1000 + i, f"lone {i}") for i in range(967)] + [(5000 + i, f"pair {i // 2}") for i in range(100)]
    got = sharded(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    holds(got, texts)
    parts = spread(got)
    hot = max(parts.values(), key=lambda p: sum(p.values()))
    assert sum(hot.values()) == 533 and len(hot) <= 7 and sorted(hot.values())[-5] >= 80
    assert sum(len(p) > 1 for p in parts.values()) <= 3


def test_all_rows_in_groups_and_small_tables(spark):
    texts = [(i, f"g{i // 5}") for i in range(480)]
    got = sharded(spark.createDataFrame(texts, "doc_id long, text string"))
    holds(got, texts)
    assert sum(len(p) - 1 for p in spread(got).values()) <= 40
    kind = "doc_id long, text string"
    assert sharded(spark.createDataFrame([], kind)) == []
    few = [(1, "a"), (2, "a"), (3, None)]
    holds(sharded(spark.createDataFrame(few, kind)), few)


def test_thresholds_let_in_exactly_what_fits(spark):
    r = random.Random(9)
    rows = [(s, r.randrange(1 << 48)) for s in range(4) for _ in range(200)] + [(4, 77)] * 3
    asked = spark.createDataFrame(rows, "to int, o long")
    room = {0: 1, 1: 150, 2: 200, 3: 0, 4: 2}
    got = sharding.thresholds(asked, room)
    let_in = collections.Counter(s for s, o in rows if o < got[s])
    assert {s: let_in[s] for s in room} == {0: 1, 1: 150, 2: 200, 3: 0, 4: 0}
