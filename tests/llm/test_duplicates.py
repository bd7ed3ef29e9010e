import hashlib
import random
import re

import duckdb
from helpers import LONG, documents, edge_rows, near_copies, prose, words
from pyspark.sql import functions as F

from sensorframe.llm import queries
from sensorframe.llm.components import connected_components
from sensorframe.llm.exact_dedup import drop_exact, exact_dedup
from sensorframe.llm.line_dedup import PARAGRAPH, line_dedup
from sensorframe.llm.minhash import near_dedup
from sensorframe.llm.substrings import repeated_substrings


def test_exact_groups(spark):
    rows = edge_rows() + [(8, "a b c"), (9, "abc"), (10, " a b\nc "), (11, "abd"), (12, "x" * 200 + "1"), (13, "x" * 200 + "2")]
    got = exact_dedup(documents(spark, rows), all_digests=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert [(by[i][0]["keep_id"], by[i][0]["group_size"]) for i in (8, 9, 10)] == [(10, 3)] * 3
    assert {by[i][0]["keep_id"] for i in (1, 2, 3)} == {3} and by[5][0]["keep_id"] == by[6][0]["keep_id"] == 5
    assert sorted(r["kept"] for r in by[4]) == [False, True]  # of repeated rows one stays
    assert all(by[i][0]["kept"] and by[i][0]["group_size"] == 1 for i in (11, 12, 13, None))
    assert by[9][0]["digest"] == hashlib.sha256(b"abc").hexdigest()
    assert exact_dedup(documents(spark, [])).collect() == []
    narrow = exact_dedup(documents(spark, rows), bits=15).collect()  # no result depends on the bitmap
    assert sorted((str(r["id"]), str(r["keep_id"]), r["kept"]) for r in narrow) == sorted((str(r["id"]), str(r["keep_id"]), r["kept"]) for r in got)
    assert {r["digest"] is None for r in narrow if r["id"] == 11} <= {True, False}
    kept = drop_exact(documents(spark, [r for r in rows if r[0] not in (4, None)]))
    assert {r["doc_id"] for r in kept.collect()} == {3, 5, 7, 10, 11, 12, 13} and "digest" in kept.columns


def test_drop_exact_decides_by_row(spark):
    rows = edge_rows() + [(None, "Twowords"), (None, "Two words"), (4, "Other text of id four"), (8, "Two words more"), (1, "Not null")]
    kept = drop_exact(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    want = [(3, " \n\t "), (4, "One."), (4, "Other text of id four"), (5, LONG), (7, "!!! 123 ..."), (None, "Two words"), (8, "Two words more"), (1, "Not null")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))
    assert drop_exact(documents(spark, [])).collect() == []


def brute_near(rows, size):
    sets, parent = {}, {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark):
    rows = near_copies() + [(100, "Ab cd"), (101, "aB  CD"), (102, "ab"), (103, "ab"), (104, None), (105, ""), (106, " \n")]
    for size in (2, 5):
        got = near_dedup(documents(spark, rows), size=size).collect()
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_near(rows, size)
        assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_deep_regions_and_many_blocks(spark, monkeypatch):
    import sensorframe.llm.minhash as m

    monkeypatch.setattr(m, "REGION", 5)
    monkeypatch.setattr(m, "BLOCK", 4)
    rng = random.Random(8)
    base = prose(rng, 150).split(" ")
    rows = [(i, " ".join(prose(rng, 1) if rng.random() < 0.01 else w for w in base)) for i in range(60)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(documents(spark, rows), size=2).collect()}
    assert got == brute_near(rows, 2)


def test_a_crowd_beyond_one_region(spark):
    """More near copies than a region holds, at the default sizes, against all pairs."""
    import numpy as np
    import sensorframe.llm.minhash as m

    rng = random.Random(12)
    base = prose(rng, 90).split(" ")
    rows = []
    for i in range(m.REGION + 700):
        change = rng.choice((0.02, 0.04, 0.06))
        rows.append((i, " ".join(prose(rng, 1) if rng.random() < change else w for w in base)))
    got = {r["id"]: r["component_id"] for r in near_dedup(documents(spark, rows), size=2).collect()}
    grams, sets = {}, []
    for _, text in rows:
        w = words(text)
        sets.append({grams.setdefault(g, len(grams)) for g in zip(w, w[1:], strict=False)})
    table = np.zeros((len(rows), len(grams)), np.float32)
    for i, s in enumerate(sets):
        table[i, list(s)] = 1
    both, size = (table @ table.T).astype(int), table.sum(axis=1).astype(int)
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    left, want = set(range(len(rows))), {}
    while left:
        first = min(left)
        group, queue = {first}, [first]
        while queue:
            near = set(np.flatnonzero(linked[queue.pop()]).tolist()) - group
            group |= near
            queue += near
        want |= {i: first for i in group}
        left -= group
    assert got == want and len(set(want.values())) > 1


def test_near_duplicates_edge_cases(spark):
    got = near_dedup(documents(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    by = {r["id"]: r for r in got}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["component_id"] is None and by[None]["kept"]
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["component_id"] == 2
    assert near_dedup(documents(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def brute_substrings(rows, length=50):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out.setdefault(i, []).append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def substring_rows():
    rng = random.Random(5)
    passage = [prose(rng, 20) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randint(0, 30)), rng.choice(passage), prose(rng, rng.randint(0, 9)), rng.choice(passage)[: rng.randint(40, 90)]]
        rows.append((i * 7 % 40, " é".join(parts)))
    rows += [(50, "x" * 49), (51, "x" * 49), (52, "y" * 50), (53, "y" * 50), (54, "z" * 500), (55, "z" * 120), (56, None), (57, ""), (60, rows[3][1]), (60, rows[3][1])]
    return rows + [(None, rows[3][1])]


def test_substrings_against_all_windows(spark, monkeypatch):
    import sensorframe.llm.substrings as s

    rows, want = substring_rows(), brute_substrings(substring_rows())
    for hot in (s.HOT, 2):  # also with windows spread by their content
        monkeypatch.setattr(s, "HOT", hot)
        got = {}
        for r in repeated_substrings(spark, documents(spark, rows)).collect():
            got.setdefault(r["id"], []).append((r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]))
        assert got == want


def test_substrings_of_long_texts_and_empty_tables(spark):
    rng = random.Random(6)
    long = prose(rng, 300_000)
    rows = [(1, "head " + long), (2, long[700_000:] + " tail"), (3, "aé" * 600_000)]
    got = {r["id"]: r for r in repeated_substrings(spark, documents(spark, rows)).drop("kept").collect()}
    assert got[1]["n_removed"] == got[3]["n_removed"] == 0 and got[3]["n_bytes"] == 1_800_000
    assert [(s["start"], s["end"]) for s in got[2]["removed"]] == [(0, len(long) - 700_000)]
    assert repeated_substrings(spark, documents(spark, [])).collect() == []


def test_lines_and_paragraphs(spark):
    rows = [
        (3, "Same line of five words\nown line number three is here\nSAME  line of five words "),
        (1, "Intro text that is quite own\n same line of five words\nshort"),
        (2, "short\nSame line of five words"),
        (4, None), (5, ""), (6, "\n\n"), (6, "\n\n"), (None, "Same line of five words"), (7, LONG), (8, LONG),
    ]
    got = {}
    for r in line_dedup(documents(spark, rows)).collect():
        got.setdefault(r["id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    text = rows[0][1]
    spans = got[3][0]["removed"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["Same line of five words", "SAME  line of five words "]
    assert got[3][0]["kept_text"] == "own line number three is here"
    assert got[1][0]["kept_text"] == rows[1][1] and got[2][0]["kept_text"] == "short" and got[8][0]["kept_text"] == ""
    assert got[4][0]["n_units"] == got[5][0]["n_units"] == 1 and got[6][0]["n_units"] == 3 and got[None][0]["removed"] == []
    paragraphs = line_dedup(documents(spark, [(1, "one two three\nfour five\n\nb"), (2, "a\n\none two three four five")]), separator=PARAGRAPH)
    assert {r["id"]: r["kept_text"] for r in paragraphs.collect()} == {1: "one two three\nfour five\n\nb", 2: "a"}
    assert line_dedup(documents(spark, [])).collect() == []
    assert line_dedup(documents(spark, rows)).where(F.size("removed") > 0).count() == 3


def test_passages_within_longer_lines(spark):
    """Passages of sentences, put into lines of other text at any place, are met; texts without one are left alone."""
    rng = random.Random(11)
    sentence = lambda: prose(rng, rng.randint(6, 12)).capitalize() + rng.choice(". . . ! ?".split())
    passages = [" ".join(sentence() for _ in range(7)) for _ in range(5)]
    rows, planted = [], set()
    for i in range(300):
        lines = [" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))] + ["}", "Home"]
        if i % 3 == 0:
            k = rng.randrange(len(lines))
            lines[k] = f"{prose(rng, 4)} {rng.choice(passages)} {prose(rng, 3)}"
            planted.add(i)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    got = {r["id"]: r for r in line_dedup(documents(spark, rows)).collect()}
    hit = {i for i, r in got.items() if r["removed"]}
    recall = len(hit & planted) / (len(planted) - len(passages))
    assert recall == 1.0 and not hit - planted
    for i, text in rows:
        spans = got[i]["removed"]
        assert all(any(text[s["start"] : s["end"]].strip() in p for p in passages) for s in spans)
        assert sum(s["end"] - s["start"] for s in spans) + len(got[i]["kept_text"]) == len(text)
    whole_units = line_dedup(documents(spark, rows), least_sentence=None).where(F.size("removed") > 0)
    assert whole_units.count() == 0
    every = line_dedup(documents(spark, rows), least_unit=1).where(F.size("removed") > 0).count()
    assert every > 290


def test_line_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.SQL["op2_line_dedup"]).df()
    got = queries.QUERIES["op2_line_dedup"](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and want["n_removed"].sum() > 50
    assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist()))
