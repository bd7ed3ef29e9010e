import math
import random
import re
from collections import Counter

import duckdb
import pytest
from helpers import LONG, documents, edge_rows, prose

from sensorframe.llm import lexical, queries
from sensorframe.llm.lexical import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(rows, items, k=10):
    docs = [(i, terms(t)) for i, t in rows]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // total
            score = 0
            for t in set(terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for r, (s, none, i) in enumerate(sorted(scored)[:k]):
            out.append((item, r + 1, None if none else i, -s))
    return sorted(out, key=str)


def found(spark, rows, items, **more):
    table = spark.createDataFrame([(i, t, 9, "x") for i, t in items], "item_id long, text string, item int, term string")
    out = ranked_search(spark, documents(spark, rows), table, **more).collect()
    return sorted(((r["item_id"], r["rank"], r["id"], r["score"]) for r in out), key=str)


def corpus(seed, n=400):
    """Prose of two kinds, copies, passages of the items in some texts, and one item in a third of all."""
    rng = random.Random(seed)
    kinds = [("on", "er", "th", "ing", "ra"), ("lo", "mi", "ve", "su", "ka", "É")]
    items = [(i, prose(rng, rng.randint(3, 30), kinds[i % 2])) for i in range(12)] + [(50, ""), (51, None), (52, "Qqq"), (53, "...")]
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice((3, 20, 80, 300)), kinds[i % 2])
        if rng.random() < 0.3:
            text += " " + items[rng.randrange(12)][1].upper()
        if i % 3 == 0:
            text += "; " + items[0][1]
        rows.append((i, text))
    rows += [(1000 + i, t) for i, t in rows[:60]] + [rows[5]] * 12
    rng.shuffle(rows)
    return rows, items


@pytest.mark.parametrize("block, wide, cells", [(16, 4096, 1 << 26), (3, 7, 1 << 26), (2, 50, 1 << 14)])
def test_against_every_document(spark, monkeypatch, block, wide, cells):
    for name, value in (("BLOCK", block), ("WIDE", wide), ("CELLS", cells), ("SEEDS", 5 * block), ("GATHER", 1000)):
        monkeypatch.setattr(lexical, name, value)
    rows, items = corpus(block)
    for k in (1, 10):
        assert found(spark, rows, items, k=k) == plain_ranking(rows, items, k)


def test_edge_cases(spark):
    rows = edge_rows() + [(None, "One two"), (None, "one two")]
    items = [(1, "ONE two"), (1, "one"), (None, "alpha 123"), (3, "alpha alpha words")]
    assert found(spark, rows, items) == plain_ranking(rows, items)
    assert found(spark, [], items) == []
    assert found(spark, rows, []) == []
    assert found(spark, [(1, None), (2, "..")], items) == []


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 64)
    table = lexical._table()
    for text in (LONG[:3000], "a" * 200 + " b " + "c" * 70, "É\x7fx" * 99, " " * 300, ""):
        got = [w.decode() for part in lexical.terms_of(text, table) for w in part]
        assert got == terms(text)


def test_blocks_are_skipped(spark, monkeypatch):
    """The summaries rule out most of the documents that share a term with an item."""
    rows, items = corpus(8, 1500)
    items = [(i, t) for i, t in items if t and len(t.split()) > 10]
    shared = sum(bool(set(terms(t)) & set(terms(x))) for _, t in rows for _, x in items)
    left = spark.sparkContext.accumulator(0)
    plain = lexical._prober

    def counting(queries):
        def probe(batches):
            for batch in plain(queries)(batches):
                left.add(len(set(zip(batch.column("row").to_pylist(), batch.column("item").to_pylist(), strict=True))))
                yield batch

        return probe

    monkeypatch.setattr(lexical, "_prober", counting)
    assert found(spark, rows, items) == plain_ranking(rows, items)
    assert 10 * len(items) <= left.value < shared / 4


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.SQL["op13_lexical_search"]).df()
    got = queries.QUERIES["op13_lexical_search"](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist()))
    assert len(got) > 100
