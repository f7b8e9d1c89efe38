"""Every corpus operator on a small table of hard cases, against brute force, and on an empty table."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafcalc.llm import decontaminate, jaccard_join, language_id, mixing, pitman_yor, quality_rules, suffix_dedup, token_counts, toxicity, warc
from sheafcalc.llm.common import id_crc, work_dir

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def rows():
    base, passage = prose(120), prose(25)
    words = base.split(" ")
    near = words[:60] + ["edited"] + words[61:]
    out = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n "), (7, "x"), (8, passage + " " + prose(40)), (9, prose(30) + " " + passage), (10, prose(3000)), (11, "a a a a a a a a a a a a a a a a"), (12, "one line\none line\ntwo line"), (13, "ÀÉ ß 你好 мир 123 !!"), (14, base.upper()), (None, prose(20)), (15, prose(9)), (16, prose(3)), (17, "a b c"), (18, "a b c"), (19, base[:300])]
    out += [(20, prose(15)), (20, prose(15))]  # one id, two texts
    out += [(21, "same row " + passage)] * 2  # a repeated row
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    own = [(i, t, ("en", "de")[k % 2] if k % 5 else None, f"src{k % 3}" if k % 7 else None, None if t is None else len(t), "clash", -1.0, k) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words double, part int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_place(found, names):
    """Rows as a counter, for tables in which ids repeat."""
    return collections.Counter(tuple(r[n] for n in names) for r in found.collect())


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.default_tokenizer())
    got = by_place(token_counts.count_tokens(docs), ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    want = collections.Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in ROWS)
    assert got == want
    assert token_counts.count_tokens(none).count() == 0


def test_token_pieces_of_hard_texts():
    from tokenizers import Tokenizer

    path = token_counts.default_tokenizer()
    tok = Tokenizer.from_file(path)
    texts = ["<|endoftext|> a <|startoftext|>b", "á ́x", "x y z", "don't 'S A'", "\x1c a\x85b", "é" * 500, " ".join(["wort"] * 5000), "ΑΣ ΟΔΟΣ σ", None, ""]
    assert list(token_counts.lengths(texts, path)) == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/ c\r\n", None), (4, "u", ""), (5, "u", "é" * 70_000), (6, "u", "y"), (6, "u", "y"), (None, "u", "x"), (None, "u", "lone")], "page_id long, url string, html string").withColumn("size", F.lit("clash"))
    folder = work_dir(spark)
    warc.write_archives(pages, folder)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, folder).collect()}
    d = warc.sha1_base32
    assert got == {(1, "revisit", 2, 1, d(b"x")), (2, "response", None, 1, d(b"x")), (3, "revisit", 4, 0, d(b"")), (4, "response", None, 0, d(b"")), (5, "response", None, 140_000, d(("é" * 70_000).encode())), (6, "response", None, 1, d(b"y")), (None, "revisit", 2, 1, d(b"x")), (None, "response", None, 4, d(b"lone"))}
    empty = work_dir(spark)
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_says_what_is_wrong():
    good = warc.record(1, "u", warc.sha1_base32(b"abc"), 3, b"abc", None)
    assert warc.page_row(good)["payload"] == b"abc"
    for bad in (good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"abc", b"abd"), good[:-2], good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            warc.page_row(bad)
    with pytest.raises(ValueError):
        list(warc.frames_of(b"\x28\xb5\x2f\xfd"))


def hits(text, items):
    w = PLAIN.findall((text or "").translate(FOLD))
    hit, names = set(), set()
    for name, t in items:
        v = PLAIN.findall((t or "").translate(FOLD))
        n = min(10, len(v))
        for s in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[s : s + n]:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontaminate(spark, docs, none):
    items = [(1, ROWS[7][1].split(" ", 3)[3][:120]), (2, "a b c"), (3, None), (4, "!!"), (10, ROWS[0][1]), (10, ROWS[0][1]), (11, "a a a"), (12, "nowhere to be found in any of these texts at all, ever")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = by_place(decontaminate.decontaminate(docs, bench), ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    assert got == collections.Counter((i, *hits(t, items)) for i, t in ROWS)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x y z z z beta"), (3, "beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    assert decontaminate.proximity_matches(docs, items, 1).count() == 1
    assert decontaminate.proximity_matches(docs, items, 5).count() == 2


def test_proximity_takes_all_terms(spark):
    docs = spark.createDataFrame([(1, "rare one two x three odd"), (2, "rare y y y y odd"), (3, "rare one two odd three"), (4, "rare rare one two three y odd"), (5, "one"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "rare one two three odd")], "item_id long, text string")
    keys = {r.doc: r.id for r in decontaminate.keyed(docs, "doc_id", "text").collect()}
    near = lambda slop: {keys[r.doc] for r in decontaminate.proximity_matches(docs, items, slop).collect()}
    assert near(0) == set() and near(1) == {1, 4}


def test_suffix_dedup(docs, none):
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in ROWS]
    first = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    want = collections.Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[None if i == float("inf") else i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()] += 1
    got = by_place(suffix_dedup.kept_texts(docs, rest=["score", "part"]), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert got == want and sum(k[2] for k in want) > 500
    assert suffix_dedup.kept_texts(none).count() == 0


def test_half_digests_do_not_settle(spark):
    line = "the same words stand in all of these "  # the digests of the two surroundings agree in 32 bits
    docs = spark.createDataFrame([(1, line + "uykbppnystxgmadlqxoazxyp"), (2, line + "wrebtyvumykutbufmqexlbru")], "doc_id long, text string")
    assert {r.n_removed for r in suffix_dedup.kept_texts(docs).collect()} == {0}


def test_texts_without_ids_are_told_apart(spark):
    # Two texts that share nothing and whose digests agree in 32 bits.
    a, b = "bfe3461940c868bcb6942b75f9ad8e9fad7de729a267c4444ecaf236999fa858", "51b2e11a6297ffe47fbc5c76757cf709540d86e35b6fef1b82c2448e9215f3a0"
    docs = spark.createDataFrame([(1, a), (None, a), (None, b)], "doc_id long, text string")
    assert sorted((r.doc_id or 9, r.kept) for r in suffix_dedup.kept_texts(docs).collect()) == [(1, a), (9, ""), (9, b)]


def test_large_anchors_are_dealt_over_blocks(spark, monkeypatch):
    size, real = 4096, suffix_dedup.compared

    def bounded(rows, length, anchor):
        assert sum(int(n) + length - anchor + 1 for x in rows for n in x[4]) < 4 * size
        return real(rows, length, anchor)

    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", size)
    monkeypatch.setattr(suffix_dedup, "compared", bounded)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 500, raising=False)
    own = random.Random(3)
    other = lambda n: "".join(own.choice("abcdefghij") for _ in range(n))
    ends = [other(14) for _ in range(40)]
    line = "these words stand in a great many of all texts"
    texts = [(i, other(20) + own.choice(ends) + line + own.choice(ends) + other(20)) for i in range(600)] + [(None, other(9) + line + ends[0]), (7, line + ends[1] + line + ends[1])]
    first = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], 10**9), 10**9 if i is None else i)
    want = collections.Counter()
    for i, t in texts:
        gone = {j for k in range(len(t) - 49) if first[t[k : k + 50]] < (10**9 if i is None else i) for j in range(k, k + 50)}
        want[i, hashlib.sha256("".join(c for j, c in enumerate(t) if j not in gone).encode()).hexdigest()] += 1
    docs = spark.createDataFrame(own.sample(texts, len(texts)), "doc_id long, text string")
    assert by_place(suffix_dedup.kept_texts(docs), ["doc_id", "kept_sha256"]) == want


def test_suffix_arrays_get_only_what_may_be_shared(monkeypatch):
    """Occurrences of one block against all strings by brute force; what shares 49 bytes with others is no symbol of the array."""
    sizes, real = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda s: sizes.append(len(s)) or real(s))
    own, length, anchor = random.Random(11), 50, 28
    other = lambda n: bytes(own.choice(b"ab\0") for _ in range(n))
    anchors = [other(anchor) for _ in range(3)]
    made = []
    for k in range(400):
        left, right = own.randint(0, 22), own.randint(11, 22)
        left = max(left, 22 - right)
        made.append((own.choice([k % 150, suffix_dedup.NO_ID]), k, own.randint(0, 99), left, other(left) + own.choice(anchors) + other(right)))

    def blocks(made):
        ids, tags, start, off = (np.array([m[j] for m in made], np.int64) for j in range(4))
        return [[ids, tags, start, off, np.array([len(m[4]) - length + 1 for m in made]), np.frombuffer(b"".join(m[4] for m in made), np.uint8)]]

    # Repeats of parts at the same distance from the anchor, by other ids and by the same one.
    made += [(own.choice([m[0], m[0] + 1 if m[0] < 999 else 3]), 1000 + k, 7, m[3] - x, m[4][x : len(m[4]) - y]) for k, m in enumerate(made) for x, y in [(own.randint(0, m[3]), own.randint(0, len(m[4]) - m[3] - anchor))] if len(m[4]) - x - y >= length]
    first = {}
    for i, _, _, off, raw in made:
        for k in range(len(raw) - length + 1):
            key = raw[k : k + length], off - k
            first[key] = min(first.get(key, i), i)
    want = sorted((i, t, s + k) for i, t, s, off, raw in made for k in range(len(raw) - length + 1) if first[raw[k : k + length], off - k] < i)
    ids, tags, start, _ = suffix_dedup.compared(blocks(made), length, anchor)
    assert sorted(zip(ids.tolist(), tags.tolist(), start.tolist())) == want and len(want) > 50
    sizes.clear()
    line = b"x" * 10 + anchors[0] + b"y" * 11
    near = [(i, i, 0, 16, bytes([65 + i]) * 6 + line + bytes([97 + i]) * 6) for i in range(20)]
    assert not len(suffix_dedup.compared(blocks(near), length, anchor)[0]) and sum(sizes) == 0


def test_words_of_the_index_are_those_of_the_contract(spark):
    """Every code point, and places between them, by the contract's own pattern. The classes name what is in a word: a negated
    one of several ranges has taken ten times as long, depending on what the JVM made of it."""
    assert not any("[^" in x for x in (decontaminate.FOLDED, decontaminate.ANY_CASE))
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[k : k + 4096]) for k in range(0, len(points), 4096)] + ["a".join(points[:3000]), "Z0".join(points[:300]), "\0a\0"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", decontaminate.words("text").alias("w"), F.expr(f"regexp_count(text, '{decontaminate.ANY_CASE}')").alias("n"), decontaminate.terms("text").alias("t")).collect()
    for r in rows:
        assert r.w == PLAIN.findall(r.text.translate(FOLD)) and r.n == len(r.w)
    assert [x for r in rows[-2:] for x in r.t] == [x for r in rows[-2:] for x in PLAIN.findall(r.text.lower())]


def test_small_groups_need_no_centre(monkeypatch):
    """Up to PAIRWISE members all pairs of bitmaps are compared; components are those of brute force."""
    own = np.random.default_rng(4)
    base = own.integers(0, 1 << 62, 60).astype(np.uint64)
    for n in (0, 1, 2, 9, 128):
        sets = [np.unique(np.concatenate([own.choice(base, 50, replace=False), own.integers(0, 1 << 62, own.integers(0, 12)).astype(np.uint64)]))[: own.choice([0, 40, 60])] for _ in range(n)]
        sig = jaccard_join.Signatures(np.stack([jaccard_join.bitmap(x, 8) for x in sets]) if n else np.zeros((0, 8), np.uint64), np.array([len(x) for x in sets], np.int64))
        leaf, root = (sig.bits, sig.weight, sig.size, sig.size), list(range(n))
        for i in range(n):
            for j in range(i + 1, n):
                if len(sets[i]) and len(sets[j]) and jaccard_join.possible(leaf, np.array([i]), leaf, np.array([j]), 80, 100)[0]:
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
        with monkeypatch.context() as m:
            m.setattr(jaccard_join, "centrality", None)
            assert jaccard_join.connected(sig, 80, 100) == root


def test_digests_that_agree_in_their_upper_bits_are_ordered():
    h, doc = np.array([3, 2, 9, 1, 2, 3], np.uint64), np.array([0, 0, 0, 1, 1, 1])
    x, y = jaccard_join.by_text(h, doc)
    assert x.tolist() == [2, 3, 9, 1, 2, 3] and y.tolist() == doc.tolist()
    assert [len(x) for x in jaccard_join.by_text(h[:0], doc[:0])] == [0, 0]


def test_words_are_scored_together(monkeypatch):
    """Scores and labels by loops over words and their trigrams, in scripts beyond 16 bits too."""
    own = np.random.default_rng(6)
    words = ["über", "x", "кот", "漢字", "\U00010400b", "ß", *{"".join(own.choice(list("abcdefñ"), own.integers(1, 9))) for _ in range(200)}]
    index = {g: k for k, g in enumerate(dict.fromkeys(g for w in words[::2] for g in language_id.grams(w)))}
    model = language_id.Model(["a", "b", "c"], index, np.round(own.normal(-9, 2, (len(index) + 1, 3)), 1), {"Latin": np.array([True, False, True]), "Cyrillic": np.ones(3, bool)})
    want = []
    for w in words:
        score = np.add.reduceat(model.logs[[index.get(g, len(index)) for g in language_id.grams(w)]], [0])[0]
        may = model.scripts.get(language_id.script(w), np.zeros(3, bool))
        want.append(np.where(may, score, score.min() - 4 * language_id.SWITCH) if may.any() else np.zeros(3))
    texts = [[int(k) for k in own.integers(0, len(words), n)] for n in (0, 1, 2, 30, 30, 7)]
    with monkeypatch.context() as m:
        m.setattr(language_id, "grams", None)
        got = model.word_scores(words)
        labels = language_id.Labeller(model).label([" 1 ".join(words[k] for k in t) for t in texts])
    assert np.array_equal(got, np.array(want))
    for t, lang, score in zip(texts, *labels[:2]):
        ways = [np.zeros(3)]
        back = []
        for k in t:
            u = ways[-1]
            top = int(u.argmax())
            jump = u < u[top] - language_id.SWITCH
            back.append(np.where(jump, top, np.arange(3)))
            ways.append(np.where(jump, u[top] - language_id.SWITCH, u) + want[k])
        at, letters = int(ways[-1].argmax()), np.zeros(3)
        for k, b in zip(t[::-1], back[::-1]):
            letters[at] += len(words[k]) * (language_id.script(words[k]) in model.scripts)
            at = int(b[at])
        total = sum(len(words[k]) for k in t)
        assert (lang, score) == ((model.langs[int(letters.argmax())], letters.max() / total) if total else ("und", 0.0))


def test_language_id(docs, none, spark):
    train = spark.createDataFrame([(1, "the cat and the dog are in the house with the other cats " * 3, "en"), (2, "der hund und die katze sind in dem haus mit den anderen " * 3, "de"), (3, "кот и собака живут в большом доме вместе с другими " * 3, "ru"), (4, None, "xx"), (5, "text", None)], "doc_id long, text string, lang string")
    model = language_id.train(train, F.lit(True))
    texts = [(1, "the dogs are with the cat"), (2, "die hunde sind in den häusern"), (3, "собака и кот"), (4, None), (5, ""), (6, "123 !?"), (7, "the house and the dog and the cat are here. der hund und die katze sind in dem haus mit den anderen hunden und katzen"), (8, "漢字")]
    got = {r.doc_id: r for r in language_id.label(spark.createDataFrame(texts, "doc_id long, text string"), model, with_spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["en", "de", "ru", "und", "und", "und"]
    assert [s.lang for s in got[7].spans] == ["en", "de"] and 0 < got[7].score < 1 and got[8].lang_pred in model.langs
    assert language_id.label(docs, language_id.train(none, F.lit(True))).filter("lang_pred <> 'und'").count() == 0
    assert language_id.label(none, model).count() == 0


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)] + [(3, None)], "doc_id long, quality int")
    got = by_place(quality_rules.judge(docs, labels), ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    want = collections.Counter()
    for i, t in ROWS:
        w = SPACED.findall(t or "")
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if SPACED.search(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice), len(w) < 10 or 100 * len(twice) > 20 * len(w)] += 1
    assert got == want
    assert quality_rules.judge(none, labels).count() == 0 and quality_rules.judge(docs, labels.limit(0)).filter("kept AND base_failed").count() == 0


def test_rules_are_learned(spark):
    good = [(i, prose(60)) for i in range(300)]
    bad = [(i, " ".join(w + "###" for w in prose(60).split())) for i in range(300, 400)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert sum(got[i] for i in range(300)) > 290 and sum(got[i] for i in range(300, 400)) < 5


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_join(docs, none, n, num, den):
    sets = []
    for i, t in ROWS:
        w = SPACED.findall((t or "").translate(FOLD))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and den * both >= num * len(sets[a][1] | sets[b][1]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((sets[k][0] for k in range(len(sets)) if group[k] == g and sets[k][0] is not None), default=None) for g in group}
    want = collections.Counter((i, len(s), least[group[k]] if s else i) for k, (i, s) in enumerate(sets))
    assert by_place(jaccard_join.link_classes(docs, n, num, den), ["doc_id", "n_shingles", "component_id"]) == want
    assert jaccard_join.link_classes(none, n, num, den).count() == 0


def test_near_copies_without_an_id(spark):
    words = [f"w{i}" for i in range(120)]
    near, other = [*words[:60], "edited", *words[61:]], [f"v{i}" for i in range(50)]
    texts = [(1, words), (None, near), (None, near), (None, other), (None, [*other, "more"]), (2, [f"u{i}" for i in range(50)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    got = by_place(jaccard_join.link_classes(docs), ["doc_id", "n_shingles", "component_id"])
    assert got == collections.Counter([(1, 117, 1), (None, 117, 1), (None, 117, 1), (None, 47, None), (None, 48, None), (2, 47, 2)])


def test_links_between_components_of_leaders():
    import itertools

    import numpy as np

    tokens = jaccard_join.mix(np.arange(1, 400, dtype=np.uint64))
    chain = [np.sort(tokens[6 * k : 6 * k + 100]) for k in range(6)]  # only neighbours link
    apart = [np.sort(tokens[200 + 6 * k : 300 + 6 * k]) for k in range(2)]
    for order in itertools.permutations(range(6)):
        sets = [chain[k] for k in order]
        assert jaccard_join.linked_parts(sets, 85, 100) == [0] * 6
        sig = jaccard_join.Signatures(np.stack([jaccard_join.bitmap(x) for x in sets]), np.full(6, 100))
        assert jaccard_join.connected(sig, 85, 100) == [0] * 6
        assert jaccard_join.linked_parts(apart + sets, 85, 100) == [0, 0] + [2] * 6


def test_chains_of_edits(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[3 * k : 3 * k + 60]) for k in (3, 0, 5, 1, 4, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.link_classes(docs).collect()} == {0}


def test_large_clusters_are_linked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    words = [f"w{i}" for i in range(80)]
    chain = [(i, " ".join(words[: 60 - i % 3] + [f"x{i}"] * (i % 2) + words[60:])) for i in range(30)] + [(100 + i, " ".join(words[: 66 + i])) for i in range(10)]
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in chain}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    assert {r.doc_id: r.component_id for r in jaccard_join.link_classes(docs).collect()} == group


def test_near_copies_send_their_bitmaps_to_few_packs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 1024)
    sent, real = [], jaccard_join.stored

    def watched(df):
        out = real(df)
        if "ids" in df.columns:
            sent.extend(len(set(r.ids)) for r in out.collect())
        return out

    monkeypatch.setattr(jaccard_join, "stored", watched)
    words = [[f"{c}w{j}" for j in range(200)] for c in range(20)]
    texts = [(3 * c + k, " ".join(w[:50] + [f"edit{k}"] * (k > 0) + w[50:])) for c, w in enumerate(words) for k in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.link_classes(docs).collect()} == {i: i - i % 3 for i in range(60)}
    assert sum(sent) <= 60 * 3


def test_equal_groups_meet_once():
    import numpy as np

    ids, sizes = jaccard_join.distinct_groups(np.array([5, 9, 1, 2, 3, 5, 9, 4, 8]), np.array([2, 3, 2, 2]))
    assert ids.tolist() == [4, 8, 5, 9, 1, 2, 3] and sizes.tolist() == [2, 2, 3]
    ids, sizes, packs, id_cut, cut = jaccard_join.dealt(ids, sizes, 0, 1000)
    groups = {tuple(x) for a, e in zip(cut, cut[1:]) for x in np.split(ids, np.cumsum(sizes)[:-1])[a:e]}
    assert groups == {(4, 8), (5, 9), (1, 2, 3)} and id_cut[-1] == 7 and len(packs) == len(cut) - 1
    many = np.arange(jaccard_join.LOCAL + 1)
    assert jaccard_join.dealt(many, np.array([len(many)]), 7, 1000)[2].tolist() == [7]


def test_words_of_a_matched_text_are_sought_once(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(5, 30)))], "item_id string, text string")
    found = decontaminate.phrase_matches(docs, items)
    assert [(m.item, sorted(m.covered)) for m in found.first().matches] == [("a", list(range(5, 30)))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(regexp_extract_all" not in plan and plan.count("regexp_extract_all") == 1


def test_pitman_yor(docs, none):
    import math

    out = pitman_yor.score(docs, id_crc("doc_id", 7) != 2, block_bytes=4096)
    tokens = [(i, SPACED.findall((t or "").translate(FOLD)) + [None]) for i, t in ROWS]
    c = collections.Counter(x for i, w in tokens if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for x in w)
    n, v = sum(c.values()), len(c)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect())
    assert got == sorted((i or 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert all(r.score < 0 for r in out.collect())
    assert pitman_yor.score(none, F.lit(True)).count() == 0
    assert pitman_yor.score(docs, F.lit(False)).filter("n_known > 0 OR score > 1e-9").count() == 0


def test_pitman_yor_chances_add_up():
    import numpy as np

    words = np.arange(1, 6, dtype=np.uint64) * np.uint64(1 << 59)
    b = pitman_yor.Bucket(words, np.full(5, 2), np.array([0, 300] * 5), np.array([3, 1, 40, 2, 1, 1, 7, 5, 1, 90]), [])
    b.samples = [[np.ones(10, int), np.ones(len(b.mid), int), np.ones(5, int)]]
    of = b.totals() | {"v": 5}
    b.sweep(of, [0.5, 0.5, 0.5], np.random.default_rng(1))
    b.samples, of = b.samples[-1:], b.totals() | {"v": 5}
    assert all((t >= 1).all() and (t <= c).all() for t, c in zip(b.samples[0], b.customers(b.samples[0])))
    for context in (0, 300, 77):
        q = pitman_yor.question(np.append(words, np.uint64(7))[np.argsort(np.append(words, np.uint64(7)))], np.full(6, context), np.zeros(6))
        count, logs = pitman_yor.opened(b.answer(q, [of], [0.5, 0.5, 0.5]))
        assert abs((10.0**logs).sum() - 1) < 1e-5  # five words and one unseen


def test_pitman_yor_contexts_are_words(docs):
    """Against plain counting, with one table a dish (no sweep): the restaurant of a word is the whole word before it."""
    import math

    learns = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
    texts = [(i, ["<begin>", *SPACED.findall((t or "").translate(FOLD)), None]) for i, t in ROWS]
    pairs = [list(zip(w[1:], w[:-1], strict=True)) for _, w in texts]
    up = lambda u: -1 if u == "<begin>" else u.encode()[-1]
    low = collections.Counter(x for (i, _), p in zip(texts, pairs, strict=True) if learns(i) for x in p)
    mid = collections.Counter((w, up(u)) for w, u in low)
    top = collections.Counter(w for w, _ in mid)
    words = collections.Counter(x for (i, w), _ in zip(texts, pairs, strict=True) if learns(i) for x in w[1:])

    def discount(c):
        one, two = (sum(x == k for x in c.values()) for k in (1, 2))
        return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5

    d0, d2 = discount(words), discount(low)
    d1 = (d0 + d2) / 2
    inside = lambda c, key: (sum(n for k, n in c.items() if k[1] == key), sum(k[1] == key for k in c))
    lows, mids = {u: inside(low, u) for u in {u for p in pairs for _, u in p}}, {m: inside(mid, m) for m in range(-1, 256)}

    def chance(w, u):
        seat = lambda c, d, total, above: (max(c - d, 0) + (1 + d * total[1]) * above) / (1 + total[0])
        root = seat(top[w], d0, (sum(top.values()), len(top)), 1 / (len(words) + 1))
        return seat(low[w, u], d2, lows[u], seat(mid[w, up(u)], d1, mids[up(u)], root))

    expected = sorted((i or 0, round(sum(math.log10(chance(*x)) for x in p), 4)) for (i, _), p in zip(texts, pairs, strict=True))
    got = sorted((r.doc_id or 0, round(r.score, 4)) for r in pitman_yor.score(docs, id_crc("doc_id", 7) != 2, sweeps=0, block_bytes=4096).collect())
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert all(abs(a - b) < 2e-3 for (_, a), (_, b) in zip(got, expected, strict=True))


def test_pitman_yor_tells_words_of_one_ending_apart(spark):
    rows = [(i, "hand up" if i % 2 else "wind down") for i in range(40)] + [(2000, "hand up"), (2001, "wind up")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score(df, F.col("doc_id") < 1000).collect()}
    assert got[2000] - got[2001] > 0.5  # both end in nd: contexts of two bytes give both the same chance of up


def test_toxicity(spark, docs, none):
    toxic = [(i, prose(30) + (" you idiot" if i % 3 == 0 else "")) for i in range(200)]
    own = spark.createDataFrame(toxic + [(900, None), (901, ""), (902, "you 1d1ot")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(1, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(own, labels, id_crc("doc_id", 5) != 0).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == int(i % 3 == 0) for i in held) and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].score == got[901].score and got[900].predicted == 0
    assert toxicity.score(none, labels, F.lit(True)).count() == 0
    assert toxicity.score(docs, labels.limit(0), F.lit(True)).filter("score <> 0").count() == 0
    assert toxicity.plain("i.d.1.0.t") == "idiot"


def test_mixing_edges(docs, none):
    got = mixing.mix(docs)
    assert got.count() == len(ROWS)
    tokens, taken = got.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("n_copies"))).first()
    assert taken <= tokens * mixing.SHARE // 1000
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs, share=0).filter("n_copies > 0 AND n_tokens > 0").count() == 0
    assert mixing.mix(docs, share=100_000).filter(f"n_tokens > 0 AND n_copies <> {mixing.EPOCHS}").count() == 0


def test_mixing_water_level(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", s) for s, n in (("a1", 2), ("b4", 50), ("c7", 50)) for i in range(n)], "doc_id long, text string, lang string, source string")
    got = {r.source: r.n for r in mixing.mix(docs, share=500, epochs=1).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("n")).collect()}
    assert got == {"a1": 20, "b4": 240, "c7": 240} or (got["a1"] == 20 and abs(got["b4"] - 245) <= 10 and abs(got["c7"] - 245) <= 10)


def test_ids_that_sets_share_are_split(spark):
    texts = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(24)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.link_classes(docs, id_bits=3).collect()}
    assert got == {i: i - i % 2 for i in range(24)}


def test_foreign_script_scores_nothing(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    texts = spark.createDataFrame([(1, "漢字 собака"), (2, "the dog собака")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.label(texts, language_id.train(train, F.lit(True))).collect()}
    assert got[1].score == 0 and got[1].lang_pred in ("de", "en") and got[2].lang_pred == "en" and got[2].score == 0.5


def test_archives_roll_over(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    folder = work_dir(spark)
    warc.write_archives(pages, folder, file_rows=8, file_bytes=400)
    assert {r.page_id for r in warc.read_archives(spark, folder).collect()} == set(range(50))
    assert spark.read.format("binaryFile").load(folder).count() > 7


def test_lean_functions_return_what_they_did():
    from sheafcalc.llm.common import lean

    def batches(b):
        yield from b

    assert list(lean(batches)(iter([1, 2]))) == [1, 2]
    assert lean(lambda t: t + 1)(1) == 2
    assert lean(lambda left, right: (left, right))(1, 2) == (1, 2)
