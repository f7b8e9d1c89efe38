"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is a path: for each turn a record of fixed size, the digest of role and text and the bytes of the text, so that
the order of paths as bytes puts a prefix before what extends it. Map tasks sort batches of paths into runs that carry the
longest common prefix (LCP, in turns) of each path with the one before, and deal them over ranges of the order. A range's task merges its
runs with a loser tree: of two heads the one that shares more turns with the last path that came out is the smaller, and only where they share equally
many are turns compared, from there on. Runs beyond a memory bound wait in a temporary file of the task. The merged stream
keeps the open path on a stack; a node is finished when the next path leaves it.

Ranges begin at real paths, so every task knows which of its nodes go on in the next range: counts of members, children,
childless nodes and saved tokens are counted where a node ends, and add up over ranges. Only nodes on the first and last path of a range
(the spine: at most two paths a range) are added up by a shuffle. Their members' ids travel in order as joined text, a few
thousand to a row, and a digest reads them as a stream, since SHA-256 can't be split.

Turns go by number (null first), role, text; null role or text counts as empty. Rows without a conversation id belong to none and are left
out; repeated rows are turns of their own. An empty table has no root and gives no rows. A text may be of any length: only its digest moves. A
conversation must fit in one row as 20 bytes a turn. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafcalc.llm.common import discard, lean, small, stored

#: Bytes of a turn's record; bytes of paths of a range, and of runs that a task holds in memory; ids of a row of joined ids;
#: spine nodes that may be broadcast; sampled paths a range.
RECORD, RANGE_BYTES, HELD_BYTES, IDS, BROADCAST_ROWS, SAMPLES = 20, 16 << 20, 32 << 20, 4096, 200_000, 40
EMPTY = hashlib.sha256(b"").hexdigest()
SORTED = "pid int, run long, seq int, path binary, conv_id long, lcp int"
NODE = "key binary, parent_key binary, spine boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, pid int, seq long, ids string"


# --- conversations as paths ------------------------------------------------------------------------


def record() -> Column:
    """A turn as hexadecimal text: half of the SHA-256 of role and text, and the bytes of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(both, 256), 1, 32), F.lpad(F.hex(F.octet_length(text)), 8, "0"))


def paths(turns: DataFrame, siblings: int = 5, most_shared: int = 9) -> DataFrame:
    """conv_id and path of each conversation, rebuilt: the first h turns of conversation c - c % siblings, h the CRC of c modulo
    most_shared, then its own turns after its first h."""
    c = F.col("conv_id")
    t = turns.filter(c.isNotNull()).select(c.cast("long").alias("conv_id"), "turn", "role", "text")
    # Turns of one number are told apart by role and text, whose places are settled before texts are left behind.
    t = t.withColumn("base", c - c % siblings).withColumn("rec", record())
    tied = t.groupBy("conv_id", "turn").count().filter("count > 1").select("conv_id", F.col("turn").alias("tied"))
    tied = stored(tied)
    if tied.isEmpty():
        t = t.withColumn("at", F.lit(0))
    else:
        own = t.join(tied, (t.conv_id == tied.conv_id) & t.turn.eqNullSafe(tied.tied), "left_semi")
        rest = t.join(tied, (t.conv_id == tied.conv_id) & t.turn.eqNullSafe(tied.tied), "left_anti").withColumn("at", F.lit(0))
        by = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
        t = rest.unionByName(own.withColumn("at", F.row_number().over(by)))
    whole = t.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("late"), "turn", "at", "rec"))).alias("t"))
    whole = whole.select("base", "conv_id", F.transform("t", lambda x: x["rec"]).alias("recs"))
    lead = F.max(F.when(c == F.col("base"), F.slice("recs", 1, most_shared - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(c.cast("string").cast("binary")) % most_shared).cast("int")
    whole = whole.withColumn("lead", F.coalesce(lead, F.array().cast("array<string>"))).withColumn("h", h)
    own = F.slice("recs", F.col("h") + 1, F.greatest(F.size("recs") - F.col("h"), F.lit(0)))
    hexes = F.concat(F.when(F.col("h") > 0, F.slice("lead", F.lit(1), F.greatest(F.col("h"), F.lit(1)))).otherwise(F.array().cast("array<string>")), own)
    return whole.select("conv_id", F.unhex(F.array_join(hexes, "")).alias("path"))


# --- sorted runs -----------------------------------------------------------------------------------


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two paths share, known to share `start`."""
    most, i = min(len(a), len(b)) // RECORD, start
    while i < most and a[i * RECORD : (i + 1) * RECORD] == b[i * RECORD : (i + 1) * RECORD]:
        i += 1
    return i


def runs_of(splits: list[tuple[bytes, int]]):
    """A map task's batches as sorted runs, each path with its range, run, place and the turns it shares with the one before."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            rows = sorted(zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True))
            if not rows:
                continue
            name = (b.column("part")[0].as_py() << 24) + k
            pid, lcp, before, last = [], [], b"", -1
            for path, c in rows:
                p = bisect_right(splits, (path, c))
                lcp.append(common(before, path) if p == last else 0)
                pid.append(p)
                before, last = path, p
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array(lcp, pa.int32())], [x.split()[0] for x in SORTED.split(", ")])

    return run


class Runs:
    """The sorted runs of one range; beyond the memory bound their batches wait in a file that goes with the task."""

    def __init__(self, held_bytes: int):
        self.room, self.parts, self.file, self.sink, self.spilled = held_bytes, {}, None, None, 0

    def add(self, name: int, b: pa.RecordBatch) -> None:
        if b.nbytes <= self.room:
            self.room -= b.nbytes
            self.parts.setdefault(name, []).append(b)
            return
        if self.sink is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
            self.sink = pa.ipc.new_file(pa.PythonFile(self.file, mode="w"), b.schema)
        self.sink.write_batch(b)
        self.parts.setdefault(name, []).append(self.spilled)
        self.spilled += 1

    def streams(self) -> list[Iterator[tuple[bytes, int, int]]]:
        back = None
        if self.sink is not None:
            self.sink.close()
            back = pa.ipc.open_file(pa.PythonFile(self.file, mode="r"))

        def rows(parts: list) -> Iterator[tuple[bytes, int, int]]:
            for b in parts:
                b = back.get_batch(b) if isinstance(b, int) else b
                yield from zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), b.column("lcp").to_pylist(), strict=True)

        return [rows(p) for _, p in sorted(self.parts.items())]


class LoserTree:
    """Merges sorted streams of (path, conv_id, lcp with the one before in the stream) into one of (path, conv_id, lcp with the
    one before in the merged order). Inner places hold the loser of their match; a head's lcp is with the last winner on its way."""

    def __init__(self, streams: list[Iterator[tuple[bytes, int, int]]]):
        self.streams, self.n = streams, len(streams)
        self.heads: list[list | None] = [None] * self.n
        for i in range(self.n):
            self.advance(i)
            if self.heads[i] is not None:
                self.heads[i][2] = 0  # nothing has come out yet
        self.loser = [-1] * self.n
        self.top = self.play(1) if self.n else -1

    def advance(self, i: int) -> None:
        got = next(self.streams[i], None)
        self.heads[i] = None if got is None else list(got)

    def play(self, place: int) -> int:
        """The winner below a place, whose matches are all played for the first time."""
        stack, won = [(place, False)], {}
        while stack:
            p, ready = stack.pop()
            if p >= self.n:
                won[p] = p - self.n
            elif not ready:
                stack += [(p, True), (2 * p, False), (2 * p + 1, False)]
            else:
                won[p] = self.match(won.pop(2 * p), won.pop(2 * p + 1), p)
        return won[place]

    def match(self, a: int, b: int, place: int) -> int:
        """The stream with the smaller head; the other stays at the place, with its lcp to the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            win, lose = (b, a) if x is None else (a, b)
        elif x[2] != y[2]:
            # The one that shares less with the last winner shares just as little with the other.
            win, lose = (a, b) if x[2] > y[2] else (b, a)
        else:
            shared = common(x[0], y[0], x[2])
            at = shared * RECORD
            win, lose = (a, b) if (x[0][at : at + RECORD], x[1]) <= (y[0][at : at + RECORD], y[1]) else (b, a)
            self.heads[lose][2] = shared
        self.loser[place] = lose
        return win

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        while self.n and (head := self.heads[self.top]) is not None:
            yield head[0], head[1], head[2]
            self.advance(self.top)
            win, place = self.top, (self.top + self.n) // 2
            while place:
                win = self.match(win, self.loser[place], place)
                place //= 2
            self.top = win


# --- nodes -----------------------------------------------------------------------------------------


class Node:
    """An open node: its path's end and key, and what has been counted below it."""

    __slots__ = ("depth", "key", "spine", "least", "n", "children", "leaves", "saved", "ends", "sha", "waiting", "ids")

    def __init__(self, depth: int, key: bytes, spine: bool):
        self.depth, self.key, self.spine = depth, key, spine
        self.least, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, 0
        self.sha, self.waiting, self.ids = None, [], []


class Trie:
    """Nodes of a range from its merged stream. `first` and `after` are the first paths of this range and of the next (None: none);
    a node on either is on the spine, and one on `after` goes on there."""

    def __init__(self, pid: int, first: bytes | None, after: bytes | None):
        self.pid, self.first, self.after, self.stack, self.out, self.chunks = pid, first, after, [], [], 0
        self.path, self.shared = b"", [0, 0]

    def push(self, path: bytes, depth: int) -> None:
        key = path[: depth * RECORD]
        spine = any(p is not None and p[: len(key)] == key for p in (self.first, self.after)) if not self.stack or self.stack[-1].spine else False
        digest = hashlib.sha256((self.stack[-1].key if self.stack else b"") + key[-RECORD:]).digest()[:16]
        self.stack.append(Node(depth, digest, spine))

    def add(self, path: bytes, c: int, lcp: int) -> None:
        if not self.stack:
            self.push(path, 0)
        while len(self.stack) > lcp + 1:
            self.pop()
        self.path = path
        for depth in range(lcp + 1, len(path) // RECORD + 1):
            self.push(path, depth)
        top = self.stack[-1]
        top.n += 1
        top.least = c if top.least is None else min(top.least, c)
        if top.spine:
            top.ids.append(str(c))
            if len(top.ids) >= IDS:
                self.flush(top)
        else:
            top.sha = top.sha or hashlib.sha256()
            top.sha.update((f",{c}" if top.ends else str(c)).encode())
        top.ends += 1

    def flush(self, node: Node) -> None:
        if node.ids:
            self.out.append((node.key, None, True, None, None, None, None, None, None, None, None, self.pid, self.chunks, ",".join(node.ids)))
            self.chunks += 1
            node.ids = []

    def pop(self) -> None:
        v = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        on = v.spine and self.after is not None and self.after[: v.depth * RECORD] == self.path[: v.depth * RECORD]
        size = int.from_bytes(self.path[v.depth * RECORD - 4 : v.depth * RECORD], "big") if v.depth else 0
        v.leaves += not v.children and not on
        v.saved += (v.n - (not on)) * size
        if v.spine:
            self.flush(v)
        for row in v.waiting:
            self.out.append((*row[:5], v.least, *row[6:]))
        sha = None if v.spine else v.sha.hexdigest() if v.sha else EMPTY
        row = (v.key, parent.key if parent else None, v.spine, v.least, v.depth, None, v.n, v.children, v.leaves, v.saved, sha, None, None, None)
        if parent is None or parent.spine:
            self.out.append(row)  # the parent's least member is known after all ranges
        else:
            parent.waiting.append((row[0], None, *row[2:]))
        if parent:
            parent.n += v.n
            parent.least = v.least if parent.least is None else min(parent.least, v.least)
            parent.children += not on
            parent.leaves += v.leaves
            parent.saved += v.saved

    def close(self) -> None:
        while self.stack:
            self.pop()

    def taken(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in NODE.split(", ")]
        b, i, s = pa.binary(), pa.int64(), pa.string()
        kinds = (b, b, pa.bool_(), i, i, i, i, i, i, i, s, pa.int32(), i, s)
        out, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def nodes_of(splits: list[tuple[bytes, int]], held_bytes: int):
    """Range by range, the nodes of the merged runs; rows come ordered by range, run and place."""

    def ranged(pid: int, runs: Runs) -> Iterator[pa.RecordBatch]:
        trie = Trie(pid, splits[pid - 1][0] if pid else None, splits[pid][0] if pid < len(splits) else None)
        for path, c, lcp in LoserTree(runs.streams()):
            trie.add(path, c, lcp)
            if len(trie.out) >= 8192:
                yield trie.taken()
        trie.close()
        yield trie.taken()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, None
        for b in batches:
            key = list(zip(b.column("pid").to_pylist(), b.column("run").to_pylist(), strict=True))
            i = 0
            while i < len(key):
                j = i
                while j < len(key) and key[j] == key[i]:
                    j += 1
                if key[i][0] != now:
                    if runs is not None:
                        yield from ranged(now, runs)
                    now, runs = key[i][0], Runs(held_bytes)
                runs.add(key[i][1], b.select(["path", "conv_id", "lcp"]).slice(i, j - i))
                i = j
        if runs is not None:
            yield from ranged(now, runs)

    return run


@lean
def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each spine node's ids, whose parts come in order."""
    now, sha, out = None, None, []
    for b in batches:
        for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if now is not None:
        out.append((now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["key", "sha"])


def splitters(rows: DataFrame, range_bytes: int) -> list[tuple[bytes, int]]:
    """Paths (with ids) at which ranges begin: every so many of a sample by hash of the id, about range_bytes apart."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("path") + 64).alias("bytes")).first()
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(total.n, max((total.bytes or 0) // range_bytes + 1, min(width, total.n // 1000 + 1)))
    if n <= 1:
        return []
    share = min(1.0, n * SAMPLES / total.n)
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("range"), "conv_id"), 11)
    got = sorted((bytes(r.path), r.conv_id) for r in rows.filter(hashed < int(share * (1 << 53))).collect())
    return sorted({got[len(got) * i // n] for i in range(1, n)}) if got else []


def trie(turns: DataFrame, range_bytes: int = RANGE_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """A row for each node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = stored(paths(turns))
    splits = splitters(rows, range_bytes)
    n = len(splits) + 1
    dealt = rows.select("path", "conv_id", F.spark_partition_id().cast("long").alias("part")).mapInArrow(runs_of(splits), SORTED)
    dealt = dealt.repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "run", "seq")
    found = stored(dealt.mapInArrow(nodes_of(splits, held_bytes), NODE))
    discard(rows)
    outs = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ids = found.filter("ids IS NOT NULL").select("key", "pid", "seq", "ids")
    sha = ids.repartition("key").sortWithinPartitions("key", "pid", "seq").select("key", "ids").mapInArrow(digests, "key binary, sha string")
    nodes = found.filter("ids IS NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = nodes.filter("spine").groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *sums)
    spine = stored(spine.join(sha, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha"))
    above = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    below = spine.withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(nodes.filter("NOT spine").select("parent_key", "key", *outs))
    lone = below.filter("parent_key IS NULL")
    joined = below.filter("parent_key IS NOT NULL").join(small(above, above.count(), BROADCAST_ROWS), "parent_key").withColumn("parent_conv_id", F.col("above"))
    return lone.select(*outs).unionByName(joined.select(*outs))


def oracle_sql() -> str:
    """DuckDB SQL for the trie of conversations: every prefix of every conversation is a row, grouped by its list of turns."""
    return """
WITH RECURSIVE t AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS b, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, b, CAST(c AS VARCHAR) AS s FROM t),
crc AS (SELECT c, b, s, 1 AS k, xor(CAST(4294967295 AS BIGINT), CAST(ascii(s[1]) AS BIGINT)) AS v, 0 AS bit FROM ids
  UNION ALL SELECT c, b, s, CASE WHEN bit = 7 THEN k + 1 ELSE k END,
    CASE WHEN bit = 7 AND k < len(s) THEN xor(xor(v >> 1, (v & 1) * 3988292384), CAST(ascii(s[k + 1]) AS BIGINT)) ELSE xor(v >> 1, (v & 1) * 3988292384) END, (bit + 1) % 8 FROM crc WHERE k <= len(s)),
h AS (SELECT c, b, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE k > len(s)),
p AS (SELECT h.c, t.i, t.r, t.x FROM h JOIN t ON t.c = h.b AND t.i <= h.h UNION ALL SELECT h.c, t.i, t.r, t.x FROM h JOIN t ON t.c = h.c AND t.i > h.h),
n AS (SELECT h.c, coalesce(list(struct_pack(r := r, x := x) ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS l FROM h LEFT JOIN p USING (c) GROUP BY h.c),
e AS (SELECT c, len(l) AS len, d, l[1:d] AS k, CASE WHEN d > 0 THEN l[1:d - 1] END AS up, CASE WHEN d > 0 THEN strlen(l[d].x) ELSE 0 END AS size FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM n)),
g AS (SELECT k, any_value(d) AS depth, any_value(up) AS up, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len = d), '')) AS ends_sha256 FROM e GROUP BY k),
q AS (SELECT up, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
z AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN q ON q.up = g.k),
s AS (SELECT k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM z) GROUP BY 1)
SELECT z.conv_id, CAST(z.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, z.n_convs, CAST(z.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, z.ends_sha256
FROM z JOIN s ON s.k = z.k LEFT JOIN g o ON o.k = z.up
"""
