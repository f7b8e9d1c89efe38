"""Suffix-array dedup: bytes that strings of a text share with a text of smaller id are removed.

A string of `length` bytes is found by its anchor, an inner gram that its bytes alone choose (the place of
the least short gram, modulo the number of inner grams). Neighbouring strings with one anchor are an
occurrence: anchor, bytes around it, place. Occurrences are gathered by the anchor's digest; those with equal
bytes need no comparison, and of each distinct one only that of the smallest id goes on. Where an anchor has
different surroundings, these go to suffix arrays, built for blocks of anchors by linear grouping (lyndon.py)
with the anchor as one symbol. Equal strings are neighbours there, and all but those of the smallest id are
removed. An anchor with more surroundings than a block holds is dealt string by string: each task keeps those of
the smallest id of equal ones, by their bytes, and sends them to the block of the string's own digest.
No occurrence is dropped, at whatever count; each task sends one of each distinct occurrence.

Texts are UTF-8 bytes; null and empty texts have none. Matches never cross rows; rows of one id do not remove
each other's bytes, and rows equal in id and text have equal results. A null id comes after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafcalc.llm.common import BYTE_WORDS, U64, buffers, give_back, lean, mix, pieces, powers, release, stored
from sheafcalc.llm.lyndon import suffix_array
from sheafcalc.llm.pitman_yor import opened, shut

#: Bytes of the shared strings, of their anchors, and of the grams that place an anchor.
LENGTH, ANCHOR, SEED_GRAM = 50, 28, 5
#: Strings of large anchors that a task compares at a time.
STRINGS = 400_000
#: Bytes of text whose occurrences share a bucket, that a task gathers before it sends, that are put together again; and of a block of suffixes.
BUCKET_BYTES, FLUSH_BYTES, PART_BYTES, BLOCK_BYTES = 16 << 20, 10 << 20, 12 << 20, 1 << 20
#: Bytes of text whose occurrences are sought at a time: each takes some hundred bytes of memory meanwhile.
PIECE_BYTES = 256 << 10
NO_ID = np.iinfo(np.int64).max


def occurrences(b: pa.RecordBatch, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For each occurrence: row, place of its first string, place of the anchor after it, how many strings, digests of anchor and bytes."""
    data, at = buffers(b.column("text"))
    width, gram = length - anchor + 1, min(SEED_GRAM, anchor)
    n = len(data) - length + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return z, z, z, z, z.view(U64), z.view(U64)
    code = np.zeros(len(data) - gram + 1, U64)
    for k in range(gram):
        code = (code << U64(8)) | data[k : k + len(code)]
    low = (mix(code) >> U64(32)) << U64(32) | np.arange(len(code), dtype=U64)
    reach, span = length - gram + 1, 1
    while span < reach:  # least of the grams of each string, by doubling
        step = min(span, reach - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    x = np.arange(n)
    place = x + ((low[:n] & U64(0xFFFFFFFF)).astype(np.int64) - x) % width
    row = np.searchsorted(at, x, "right") - 1
    whole = x + length <= at[row + 1]
    x, place, row = x[whole], place[whole], row[whole]
    if not len(x):
        return z, z, z, z, z.view(U64), z.view(U64)
    edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (x[1:] != x[:-1] + 1)]))
    count = np.diff(np.concatenate([edge, [len(x)]]))
    x, place, row = x[edge], place[edge], row[edge]
    p, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_WORDS[data] * p[:-1], out=sums[1:])
    digest = lambda s, e: mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(U64))
    around = mix(digest(x, x + count - 1 + length) ^ ((place - x).astype(U64) << U64(8)))
    return row, x - at[row], place - x, count, digest(place, place + anchor), around


def runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring stretches of strings of one text put together; sorted."""
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    if not len(doc):
        return doc, start, count
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + count[:-1])]))
    last = np.concatenate([edge[1:], [len(doc)]]) - 1
    # Stretches of one text never overlap but by repeats, so the last one ends the run.
    return doc[edge], start[edge], start[last] + count[last] - start[edge]


def by_part(tag: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    part = tag.astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for k in range(parts):
        if cut[k + 1] > cut[k]:
            yield k, order[cut[k] : cut[k + 1]]


def tabled(ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct texts (id, tag) and the text of each entry."""
    order = np.lexsort((tags, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (tags[order][1:] != tags[order][:-1])
    which = np.empty(len(ids), np.int64)
    which[order] = np.cumsum(new) - 1
    return ids[order][new], tags[order][new], which


def settled(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, count: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Stretches to remove, for each part of the texts."""
    for k, i in by_part(tags, parts):
        d, t, which = tabled(ids[i], tags[i])
        doc, s, n = runs(which, start[i], count[i])
        yield k, shut(d, t, doc.astype(np.uint32), s.astype(np.uint32), n.astype(np.uint32))


def removals(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", rest: list[str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The texts (id, text, tag, part) and for each part packed stretches of strings to remove; and how many parts."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("order"), text.alias("text"), F.struct(*[F.col(c) for c in rest or []], F.lit(None).cast("int").alias("__none")).alias("rest"))
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = int(max(8, -(-size // PART_BYTES)))
    buckets = int(max(8, -(-size // BUCKET_BYTES)))
    own = own.withColumn("tag", F.expr("xxhash64(order, text) & 9223372036854775807")).withColumn("part", F.expr(f"cast(tag % {parts} as int)"))

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, tags, start, off, count, gram, around = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # Of occurrences with equal bytes the smallest id goes on; the others are settled here.
            key = mix(gram ^ mix(around))
            order = np.lexsort((ids, key))
            g, a = gram[order], around[order]
            edge = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1])]))
            least = np.empty(len(key), np.int64)
            least[order] = np.repeat(ids[order][edge], np.diff(np.concatenate([edge, [len(key)]])))
            out = []
            done = ids != least
            # Settled stretches go with any bucket, which only passes them on.
            for k, blob in settled(ids[done], tags[done], start[done], count[done], parts):
                out.append((k % buckets, k, blob))
            left = np.flatnonzero(~done)
            for k, i in by_part((gram[left] & U64(0xFFFF)).astype(np.int64), buckets):
                i = left[i]
                d, t, which = tabled(ids[i], tags[i])
                o = np.lexsort((start[i], which))
                i, which = i[o], which[o]
                columns = (d, t, which.astype(np.uint32), start[i].astype(np.uint32), off[i].astype(np.uint16), count[i].astype(np.uint16))
                out.append((k, -1, shut_raw(columns, (gram[i] >> U64(16), around[i]))))
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "part", "blob"])

        for whole in batches:
            for b in pieces(whole, "text", PIECE_BYTES):
                row, start, off, count, gram, around = occurrences(b, length, anchor)
                if len(row):
                    ids, tags = b.column("order").to_numpy(), b.column("tag").to_numpy()
                    held.append((ids[row], tags[row], start, off, count, gram, around))
                    size += int(count.sum())
                if size >= FLUSH_BYTES:
                    yield flush()
                    give_back()
                    size = 0
        if held:
            yield flush()

    @lean
    def gather(t: pa.Table) -> pa.Table:
        part = t.column("part").to_pylist()
        blobs = [x.as_py() for x in t.column("blob")]
        out = [(k, False, b, 0) for k, b in zip(part, blobs, strict=True) if k >= 0]
        rows = [opened_raw(b) for k, b in zip(part, blobs, strict=True) if k < 0]
        if rows:
            ids = np.concatenate([x[0][x[2]] for x in rows])
            tags = np.concatenate([x[1][x[2]] for x in rows]).astype(np.int64)
            start, off, count, gram, around = (np.concatenate([x[j] for x in rows]) for j in range(3, 8))
            start, off, count = start.astype(np.int64), off.astype(np.int64), count.astype(np.int64)
            order = np.lexsort((ids, around, gram))
            ids, tags, start, off, count, gram, around = (x[order] for x in (ids, tags, start, off, count, gram, around))
            new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
            new = new_gram | np.concatenate([[True], around[1:] != around[:-1]])
            edge = np.flatnonzero(new)
            least = np.repeat(ids[edge], np.diff(np.concatenate([edge, [len(ids)]])))
            done = ids != least
            out += [(k, False, b, 0) for k, b in settled(ids[done], tags[done], start[done], count[done], parts)]
            # Anchors with several surroundings go to the suffix arrays.
            g = np.cumsum(new_gram) - 1
            many = (np.bincount(g, new) > 1)[g] & ~done
            large = (np.bincount(g, many) * (2 * (length - anchor) + 2) > BLOCK_BYTES)[g]
            ids, tags, start, off, count, gram, large = (x[many] for x in (ids, tags, start, off, count, gram, large))
            symbols = np.where(large, count * (length - anchor + 2), 2 * (length - anchor) + 2)
            for k, i in by_part(tags, parts):
                d, tg, which = tabled(ids[i], tags[i])
                out.append((k, True, shut(d, tg, which.astype(np.uint32), start[i].astype(np.uint32), off[i].astype(np.uint16), count[i].astype(np.uint16), gram[i], large[i].astype(np.uint8)), int(symbols[i].sum())))
        return pa.table({n: pa.array([x[j] for x in out], t) for j, (n, t) in enumerate((("part", pa.int32()), ("open", pa.bool_()), ("blob", pa.binary()), ("symbols", pa.int64())))})

    sent = own.select("order", "tag", "text").mapInArrow(send, "bucket int, part int, blob binary")
    found = stored(sent.groupBy("bucket").applyInArrow(gather, "part int, open boolean, blob binary, symbols long"))
    release(spark)
    symbols = found.agg(F.sum("symbols").alias("n")).first().n or 0
    if not symbols:
        return own, found.select("part", "blob"), parts
    blocks = int(max(6, -(-symbols // BLOCK_BYTES)))

    @lean
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """Bytes of the open occurrences of the texts of a part, for each block of anchors."""
        texts = {(o, g): t.as_buffer() for o, g, t in zip(left.column("order").to_pylist(), left.column("tag").to_pylist(), left.column("text").cast(pa.binary()) if left.num_rows else [], strict=True)}
        got = [opened(x.as_py()) for x in right.column("blob")]
        out = []
        if got:
            ids, tags = np.concatenate([x[0][x[2]] for x in got]), np.concatenate([x[1][x[2]] for x in got]).astype(np.int64)
            start, off, count, gram, large = (np.concatenate([x[j] for x in got]) for j in range(3, 8))
            start, off, count, large = start.astype(np.int64), off.astype(np.int64), count.astype(np.int64), large > 0

            def bytes_of(i: np.ndarray) -> np.ndarray:
                end = start[i] + count[i] - 1 + length
                return np.frombuffer(b"".join(bytes(memoryview(texts[o, g])[a:e]) for o, g, a, e in zip(ids[i].tolist(), tags[i].tolist(), start[i].tolist(), end.tolist(), strict=True)), np.uint8)

            few, wide = np.flatnonzero(~large), np.flatnonzero(large)
            for k, i in by_part((mix(gram[few]) >> U64(32)).astype(np.int64), blocks):
                i = few[i]
                out.append((k, -1, shut(ids[i], tags[i], start[i].astype(np.uint32), off[i].astype(np.uint16), count[i].astype(np.uint16), bytes_of(i))))
            before = np.cumsum(count[wide]) - count[wide]
            for i in np.split(wide, np.flatnonzero(np.diff(before // STRINGS)) + 1) if len(wide) else []:
                own, k, string = strings(count[i], bytes_of(i), length)
                least = least_of(string, ids[i][own])
                own, k, string, gone = i[own], k, string, ids[i][own] != least
                for part, blob in settled(ids[own][gone], tags[own][gone], start[own][gone] + k[gone], np.ones(int(gone.sum()), np.int64), parts):
                    out.append((part % blocks, part, blob))
                own, k, string = own[~gone], k[~gone], string[~gone]
                code = np.zeros(len(own), U64)
                for j in range(length):
                    code = mix(code ^ BYTE_WORDS[string[:, j]])
                for block, x in by_part((code >> U64(32)).astype(np.int64), blocks):
                    o = own[x]
                    out.append((block, -1, shut(ids[o], tags[o], (start[o] + k[x]).astype(np.uint32), (off[o] - k[x]).astype(np.uint16), np.ones(len(x), np.uint16), string[x].ravel())))
        return pa.table({n: pa.array([x[j] for x in out], t) for j, (n, t) in enumerate((("block", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())))})

    @lean
    def compare(t: pa.Table) -> pa.Table:
        both = list(zip(t.column("part").to_pylist(), t.column("blob"), strict=True))
        out = [(k, x.as_py()) for k, x in both if k >= 0]
        if rows := [opened(x.as_py()) for k, x in both if k < 0]:
            out += settled(*compared(rows, length, anchor), parts)
        return pa.table({"part": pa.array([k for k, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    asked = own.select("part", "order", "tag", "text").groupBy("part").cogroup(found.filter("open").select("part", "blob").groupBy("part")).applyInArrow(cut, "block int, part int, blob binary")
    more = stored(asked.groupBy("block").applyInArrow(compare, "part int, blob binary"))
    release(spark)
    return own, found.filter("NOT open").select("part", "blob").unionByName(more), parts


def shut_raw(columns: tuple[np.ndarray, ...], digests: tuple[np.ndarray, ...]) -> bytes:
    """Columns packed, and digests, which do not pack, beside them: six bytes of the anchor's (its bucket has the rest) and all eight of the other."""
    body = shut(*columns)
    gram, around = digests
    return len(gram).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body + (gram & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (gram >> U64(32)).astype(np.uint16).tobytes() + around.astype(U64).tobytes()


def opened_raw(blob: bytes) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    at = 16 + size
    take = lambda kind, at: np.frombuffer(blob, kind, n, at).astype(U64)
    return [*opened(blob[16:at]), take(np.uint32, at) | (take(np.uint16, at + 4 * n) << U64(32)), take(U64, at + 6 * n)]


def strings(count: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each string of occurrences whose bytes follow each other in raw: its occurrence, its place there, its bytes."""
    size = count - 1 + length
    own = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(own)) - (np.cumsum(count) - count)[own]
    return own, k, raw[((np.cumsum(size) - size)[own] + k)[:, None] + np.arange(length)]


def least_of(string: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each string (a row of bytes) the smallest id that has the same bytes."""
    _, same = np.unique(np.ascontiguousarray(string).view(f"S{string.shape[1]}").ravel(), return_inverse=True)
    least = np.full(same.max(initial=-1) + 1, NO_ID)
    np.minimum.at(least, same, ids)
    return least[same]


def ranked_bytes(raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The rank of raw[at : at + width] among all of them, by the bytes."""
    return np.unique(np.ascontiguousarray(raw[at[:, None] + np.arange(width)]).view(f"V{width}").ravel(), return_inverse=True)[1]


def reach(raw: np.ndarray, first: np.ndarray, step: int, room: np.ndarray, width: int, rank: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each occurrence how many bytes beside its anchor, from `first` on by `step`, agree with one of another id that has the
    anchor; -1 where no other id has it. Sorted by these bytes, the nearest other ids before and after agree the longest."""
    n = len(ids)
    k = np.arange(width)
    byte = np.zeros((n, -(-max(width, 1) // 8) * 8), np.uint8)
    byte[:, :width] = np.where(k < room[:, None], raw[np.clip(first[:, None] + step * k, 0, len(raw) - 1)], 0)
    order = np.lexsort((ids, *byte.view(">u8").astype(U64).T[::-1], rank))
    byte, who, rank = byte[order, :width], ids[order], rank[order]
    differs = np.column_stack([byte[1:] != byte[:-1], np.ones(n - 1, bool)])
    near = np.where(rank[1:] == rank[:-1], differs.argmax(axis=1), -1)
    # A run of one id looks past itself: the least of the agreements on the way.
    run = np.concatenate([[0], np.cumsum(who[1:] != who[:-1])]) * (width + 2)
    before = np.minimum.accumulate(np.concatenate([[-1], near]) - run) + run
    after = (np.minimum.accumulate((np.concatenate([near, [-1]]) + run)[::-1]) - run[::-1])[::-1]
    best = np.empty(n, np.int64)
    best[order] = np.maximum(before, after)
    return np.minimum(best, room)


def narrowed(raw: np.ndarray, at: np.ndarray, off: np.ndarray, size: np.ndarray, rank: np.ndarray, ids: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences that may share a string with another id's, and how many bytes before and after the anchor such a string may
    have. Bytes that agree with no other id, at the same distance from the anchor and all the way to it, are in no shared string;
    what has not enough bytes left for one is left out, and then agrees with none either."""
    keep = np.arange(len(ids))
    left, right = off, size - off - anchor
    while len(keep):
        before = reach(raw, at[keep] + off[keep] - 1, -1, left, length - anchor, rank[keep], ids[keep])
        after = reach(raw, at[keep] + off[keep] + anchor, 1, right, length - anchor, rank[keep], ids[keep])
        live = (before >= 0) & (before + after >= length - anchor)
        was, keep, left, right = len(keep), keep[live], before[live], after[live]
        if len(keep) > 0.9 * was:
            break
    return keep, left, right


def compared(rows: list[list[np.ndarray]], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """id, tag, start and count of strings that an occurrence of smaller id has too, by a suffix array of the block."""
    ids, tags, start, off, count, raw = (np.concatenate([x[j] for x in rows]) for j in range(6))
    tags, start, off, count = (x.astype(np.int64) for x in (tags, start, off, count))
    size = count - 1 + length
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    rank = ranked_bytes(raw, at + off, anchor)
    keep, left, right = narrowed(raw, at, off, size, rank, ids, length, anchor)
    if not len(keep):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    ids, tags, start, off, at, rank = (x[keep] for x in (ids, tags, start, off, at, rank))
    start, at, off, size = start + off - left, at + off - left, left, left + anchor + right
    count = size - length + 1
    # Symbols of an occurrence: bytes before the anchor, the anchor, bytes after it, and an end.
    wide = size - anchor + 2
    new = np.concatenate([[0], np.cumsum(wide)])
    text = np.zeros(new[-1], np.int64)
    owner = np.repeat(np.arange(len(ids)), wide)
    j = np.arange(new[-1]) - new[owner]
    byte = np.where(j < off[owner], j, j + anchor - 1)
    inner = (j != off[owner]) & (j < wide[owner] - 1)
    text[inner] = raw[(at[owner] + byte)[inner]].astype(np.int64) + 1
    text[j == off[owner]] = 257 + rank[owner[j == off[owner]]]
    order = np.array(suffix_array(text.tolist()), np.int64)
    order = order[j[order] < count[owner[order]]]  # places where a string begins
    span = length - anchor + 1
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(span):
        live = np.flatnonzero(same)
        same[live] = text[order[live] + k] == text[order[live + 1] + k]
    edge = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    who = ids[owner[order]]
    least = np.repeat(np.minimum.reduceat(who, edge), np.diff(np.concatenate([edge, [len(order)]]))) if len(order) else who
    gone = order[who != least]
    o = owner[gone]
    return ids[o], tags[o], start[o] + j[gone], np.ones(len(gone), np.int64)


def nullable(structs: pa.ChunkedArray) -> pa.Array:
    """The structs with fields that may be null, as a schema in text has them."""
    one = structs.combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    return pa.StructArray.from_arrays(one.flatten(), fields=[pa.field(f.name, f.type, True) for f in one.type])


def kept_texts(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", rest: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (the text left, without letters that lost a byte) and rest
    (a struct of the columns asked for) of each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    own, packed, _ = removals(docs, length, anchor, id_col, text_col, rest)

    @lean
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cover: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for blob in right.column("blob"):
            d, t, doc, s, n = opened(blob.as_py())
            edge = np.concatenate([np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), [len(doc)]]) if len(doc) else [0]
            for a, e in zip(edge, edge[1:], strict=False):
                k = int(doc[a])
                cover.setdefault((int(d[k]), int(t[k])), []).append((s[a:e].astype(np.int64), n[a:e].astype(np.int64)))
        rows = []
        for o, g, text in zip(left.column("order").to_pylist(), left.column("tag").to_pylist(), left.column("text").to_pylist(), strict=True):
            raw = text.encode("utf-8")
            got = cover.get((o, g))
            removed = spans = 0
            if got:
                step = np.zeros(len(raw) + 1, np.int64)
                np.add.at(step, np.concatenate([s for s, _ in got]), 1)
                np.add.at(step, np.concatenate([s + n for s, n in got]) + length - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                total, raw = len(raw), np.frombuffer(raw, np.uint8)[~gone].tobytes()
            else:
                total = len(raw)
            rows.append((total, removed, spans, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "ignore") if with_text else None))
        out = {"id": left.column("id")} | {n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())))}
        return pa.table(out | {"rest": nullable(left.column("rest"))})

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, rest {own.schema['rest'].dataType.simpleString()}"
    out = own.select("part", "id", "order", "tag", "text", "rest").groupBy("part").cogroup(packed.groupBy("part")).applyInArrow(run, schema).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept", "rest")
