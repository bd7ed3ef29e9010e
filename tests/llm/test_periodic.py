import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import documents, edge_rows

from sensorframe.llm import periodic, queries
from sensorframe.llm.periodic import find_runs, occurrences, periodic_runs


def plain_runs(words, least=6, repeats=4):
    """Every distance, every maximal stretch; of equal stretches the smallest distance."""
    found, n = {}, len(words)
    for d in range(1, n // repeats + 1):
        i = 0
        while i + d < n:
            j = i
            while j + d < n and words[j] == words[j + d]:
                j += 1
            if j > i and j - i + d >= max(least, repeats * d):
                found.setdefault((i, j + d), d)
            i = j + 1
    return sorted((i, j - i, d) for (i, j), d in found.items())


def kept(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sample(rng):
    """Words of small alphabets with repeated parts, some nested, and long periods of many different words."""
    kind = rng.random()
    if kind < 0.4:
        return rng.choices("ab" if kind < 0.2 else "abcd", k=rng.randint(0, 60))
    words = []
    for _ in range(rng.randint(1, 4)):
        base = rng.choices([f"w{i}" for i in range(rng.choice((1, 2, 5, 400)))], k=rng.randint(1, 70))
        if rng.random() < 0.4:
            base = base[:5] * rng.randint(1, 12) + base[:1]
        part = base * rng.randint(1, 7)
        words += part[rng.randint(0, 3) : len(part) - rng.randint(0, len(base) // 2)] + rng.choices("xyz", k=rng.randint(0, 3))
    return words


@pytest.mark.parametrize("chunk", [periodic.CHUNK, 64])
def test_runs_against_every_distance(monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(150):
        texts = [sample(rng) for _ in range(rng.randint(1, 4))]
        numbers, code = {}, []
        for t, text in enumerate(texts):
            code += [numbers.setdefault((t, w), len(numbers)) for w in text]
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        least, repeats = rng.choice([(6, 4), (6, 4), (4, 4), (9, 5)])
        got = find_runs(np.array(code, np.int64), doc, least, repeats).tolist()
        want, base = [], 0
        for text in texts:
            want += [[base + s, n, q] for s, n, q in plain_runs(text, least, repeats)]
            base += len(text)
        assert got == want, texts


def test_occurrences_are_exact_for_large_numbers():
    """Differences whose squares add up to a multiple of the prime must not pass for equal."""
    rng = np.random.default_rng(2)
    for size in (1, 2, 8, 64, 512):
        blocks = rng.integers(0, 1 << 20, (6, size))
        windows = rng.integers(0, 1 << 20, (6, 2 * size - 1))
        place = rng.integers(0, size, 6)
        for r, k in enumerate(place[:4]):
            windows[r, k : k + size] = blocks[r]
        want = np.array([[(windows[r, k : k + size] == blocks[r]).all() for k in range(size)] for r in range(6)])
        assert (occurrences(blocks, windows) == want).all()
    assert not occurrences(np.array([[periodic.PRIME]]), np.array([[0]])).any()


def test_long_text_of_one_word_and_of_nested_periods():
    for words in (["a"] * 20_000, (["a"] * 300 + ["b"]) * 9, [f"w{i % 2500}" for i in range(12_000)], ["a", "b"] * 4000 + ["a", "a"]):
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        code = np.array([number[w] for w in words])
        got = find_runs(code, np.zeros(len(code), np.int64)).tolist()
        if len(words) < 10_000:
            assert got == [list(r) for r in plain_runs(words)]
        else:
            assert got == [[0, len(words), len(number)]]


def test_documents_and_edge_cases(spark):
    rng = random.Random(4)
    rows = edge_rows() + [(100 + i, "\x0b".join(sample(rng)) + " é" * (i % 2)) for i in range(40)]
    got = periodic_runs(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((i or -1, tuple(words), plain_runs(words) if len(words) < 5000 else [(0, 80_000, 4)]) for i, words in ((i, _words(t)) for i, t in rows))
    mine = sorted((r["id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in got)
    assert [m[:3] for m in mine] == [(i, len(w), runs) for i, w, runs in want]
    assert [m[3] for m in mine] == [kept(w, runs) for _, w, runs in want]
    assert periodic_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(documents(spark, rows), repeats=3)


def _words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_query_against_plain_python(spark, sf_dir):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = _words(text)
        if len(words) > 4000:
            continue
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, row = plain_runs(words), got[doc_id]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        planted += bool(runs)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row["collapsed_sha256"] == sha(kept(words, runs))
    assert planted > 5
