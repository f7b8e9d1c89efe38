"""The pipeline as a whole against brute force, and each stage on hard rows."""

import collections

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from test_operators import FOLD, SPACED, hits, prose

from sheafcalc.llm import mixing

ASCII = str.maketrans("é", "e")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, epoch string"


def fixture():
    plain = lambda n: prose(n).translate(ASCII)
    base, passage, item = plain(150), plain(30), plain(14)
    words = base.split(" ")
    texts = {i: plain(40 + i) for i in range(1, 25)}
    texts |= {30: base, 31: base, 32: " ".join(words[:70] + ["edited"] + words[71:]), 33: base.upper()}
    texts |= {40: passage + " " + plain(60), 41: plain(50) + " " + passage, 42: passage[:60]}
    texts |= {50: plain(20) + " " + item + " " + plain(20), 51: plain(20) + " " + item[:20] + " " + plain(20)}
    texts |= {60: None, 61: "", 62: " \n", 63: "12 34 !?"}
    rows = [(i, t, "en", f"src{i % 4}", None if t is None else len(t), "clash") for i, t in texts.items()]
    return rows, [(1, item), (2, None), (3, "words of which no text has any at all, not even the shortest one of them")]


def brute(rows, items):
    """Rows of run(): (doc_id, text, epoch)."""
    docs = {i: t for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    # Near duplicates: the smallest id of each component stays.
    sets = {}
    for i, t in docs.items():
        w = SPACED.findall(t.translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    group = {i: i for i in docs}
    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    docs = {i: t for i, t in docs.items() if group[i] == i}
    assert len(docs) == len(group) - 3
    # Shared strings: bytes that a document of smaller id has in a string of 50.
    first, kept = {}, {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 49):
            first.setdefault(docs[i][k : k + 50], i)
    for i, t in docs.items():
        gone = {j for k in range(len(t) - 49) if first[t[k : k + 50]] < i for j in range(k, k + 50)}
        left = "".join(c for j, c in enumerate(t) if j not in gone)
        if not gone or SPACED.search(left):
            kept[i] = left
    assert 42 not in kept and len(kept[41]) < len(docs[41])
    docs = {i: t for i, t in kept.items() if not hits(t, items)[-1]}
    assert 50 in kept and 50 not in docs and 51 in docs
    source = {r[0]: (r[2], r[3]) for r in rows}
    documents = pd.DataFrame([(i, t, *source[i]) for i, t in docs.items()], columns=["doc_id", "text", "lang", "source"])
    with duckdb.connect() as db:
        db.register("documents", documents)
        mixed = db.sql(mixing.oracle_sql()).df()
    return collections.Counter((int(r.doc_id), docs[r.doc_id], len(docs[r.doc_id]), e) for r in mixed.itertuples() for e in range(1, int(r.n_copies) + 1))


def test_run(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert collections.Counter((r.doc_id, r.text, r.n_chars, r.epoch) for r in out.collect()) == brute(rows, items)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_hard_rows(spark, tmp_path, name, stage):
    """Nulls in any column, repeated rows and ids, and no rows at all."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = prose(40)
    rows = [(1, text, "en", "a", 9, None), (1, text, "en", "a", 9, None), (2, text, None, None, None, "x"), (None, text, "en", None, 3, "x"), (None, prose(30), None, "b", None, None), (3, None, "en", "a", None, None), (4, "", None, None, 0, None), (5, prose(30), "en", "b", 5, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    found = stage(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    if name != "mixture":
        assert found.schema.simpleString() == docs.schema.simpleString()
        assert found.filter("doc_id = 5").count() == 1
    if name == "near_duplicates":
        # The repeated row stays twice; its copies of larger id and without one go.
        assert collections.Counter(r.doc_id for r in found.collect()) == {1: 2, None: 1, 3: 1, 4: 1, 5: 1}
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_executors_rest_before_the_large_stages(spark, monkeypatch):
    """A full collection in each executor comes before the stages whose Python workers need the most memory."""
    from sheafcalc.llm.common import rested

    rests = []
    monkeypatch.setattr(corpus_pipeline, "rested", lambda s: rests.append(rested(s)))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.shared_strings):
        stage(spark, empty, "")
    assert len(rests) == 2
