import random
import re

import pytest
from helpers import documents, edge_rows, prose
from pyspark.sql import functions as F

from sensorframe.llm import language_id, quality
from sensorframe.llm.url_filter import longest_rule, ratios, train, url_filter

ENGLISH, OTHER = ("the", "ing", "and", "er", "wh", "tion"), ("que", "ñ", "ción", "os", "ll", "ar")


def corpus(n=60):
    rng = random.Random(1)
    return [(i, prose(rng, rng.randint(3, 60), ENGLISH if i % 2 else OTHER), "en" if i % 2 else "es") for i in range(n)]


def test_language_of_held_out_texts(spark):
    rows = corpus()
    train = spark.createDataFrame(rows[:40], "doc_id long, text string, lang string")
    model = language_id.train(train)
    got = language_id.identify(spark, spark.createDataFrame(rows[40:], "doc_id long, text string, lang string"), model).collect()
    assert {r["id"]: r["lang_pred"] for r in got} == {i: lang for i, _, lang in rows[40:]}
    assert all(0 <= r["score"] <= 1 for r in got)


def brute_bits(texts, text, order, least):
    """Code length of a text by plain counting, one byte at a time."""
    counts = {}
    for t in texts:
        b = bytes(order) + t.encode()
        for p in range(order, len(b)):
            for k in range(order + 1):
                counts.setdefault(b[p - k : p], {}).setdefault(b[p], 0)
                counts[b[p - k : p]][b[p]] += 1
    import math

    def bits(context, byte):
        lower = bits(context[1:], byte) if context else 8.0
        nodes = counts.get(context, {})
        kept = {c: m for c, m in nodes.items() if m >= least}
        if not kept:
            return lower
        n, d = sum(nodes.values()), len(nodes)
        if byte in kept:
            return -math.log2(kept[byte] / (n + d))
        return lower - math.log2(1 - sum(kept.values()) / (n + d))

    b = bytes(order) + text.encode()
    return sum(bits(b[p - order : p], b[p]) for p in range(order, len(b)))


@pytest.mark.parametrize("least, at_once", [(1, None), (3, None), (1, 40)])
def test_code_lengths_against_plain_counting(spark, least, at_once):
    """Every node of the trees counts, in one pass and in many."""
    by = {lang: [t for _, t, x in corpus(12) if x == lang] for lang in ("en", "es")}
    rows = spark.createDataFrame([(t, lang) for lang, texts in by.items() for t in texts], "text string, lang string")
    model = language_id.train(rows, order=3, least=least, at_once=at_once)
    assert (len(model.passes) > 3) == bool(at_once) and model.langs == ["en", "es"]
    texts = [by["es"][0], "the unknown", "ñandú", "q", "", by["en"][1] * 3, None, "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r for r in language_id.code_lengths(spark, docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i]["n_bytes"] == len((text or "").encode())
        want = [brute_bits(by[lang], text or "", 3, least) for lang in model.langs]
        assert got[i]["bits"] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_language_edge_cases(spark):
    train = spark.createDataFrame(corpus(20), "doc_id long, text string, lang string")
    model = language_id.train(train)
    rows = language_id.identify(spark, documents(spark, edge_rows()), model).collect()
    assert len(rows) == len(edge_rows())
    assert {r["lang_pred"] for r in rows if r["id"] in (1, 2, 3, 7)} == {"und"}
    assert language_id.identify(spark, documents(spark, []), model).collect() == []
    empty = language_id.train(train.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(spark, train, empty).collect()} == {"und"}


def test_tree_paths_become_rules():
    debug = """RandomForestClassificationModel: uid=x
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0E-3)
      Predict: 0.0
     Else (feature 1 > 2.0E-3)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    assert quality.tree_rules(debug, ["a", "b"]) == [
        [("a", "<=", 0.5)],
        [("a", "<=", 0.5), ("b", "<=", 0.002)],
        [("a", "<=", 0.5), ("b", ">", 0.002)],
        [("a", ">", 0.5)],
    ]


def test_quality_on_held_out_texts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        text = prose(rng, rng.randint(20, 60))
        rows.append((i, text if i % 3 else " ".join(w for w in text.split() for _ in range(5)), int(i % 3 > 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows[:180]] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.with_score(docs, quality.fit(docs, labels)).collect()
    wrong = [r for r in got if r["doc_id"] >= 180 and (r["score"] >= 0.3) != bool(r["doc_id"] % 3)]
    assert not wrong


def test_quality_edge_cases(spark):
    docs = documents(spark, edge_rows())
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.with_score(docs, model).collect()
    assert len(rows) == len(edge_rows()) and {r["score"] for r in rows} == {0.5}
    model = quality.RuleModel(0.0, [([("log_words", "<=", 0.1)], -1.0), ([("repeats", ">", 0.5)], 2.0)])
    got = quality.with_score(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.with_score(documents(spark, []), model).collect() == []


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def brute_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_url_rules_and_models(spark):
    rng = random.Random(4)
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/x?y#z", "x://b.com", "http://www.example.com/en/1", "http://m.example.com/en/", "http://xcom/", "a://b://c.net/es/"]
    urls += [f"http://{prose(rng, 1)}.example.com/good/{i}" for i in range(80)]
    urls += [f"http://{prose(rng, 1)}.net/es/bad{i}" for i in range(80)]
    urls += [f"http://{prose(rng, 1)}.org/good/{i}" for i in range(10)] + [f"http://{prose(rng, 1)}.org/es/bad{i}" for i in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"id": F.lit(1), "host": F.lit("x"), "ratio": F.lit(2)})
    got = {r["id"]: r for r in url_filter(pages, RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = brute_rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert all(got[i]["verdict"] == ("allow" if "good" in urls[i] else "block") for i in range(170, 190))
    assert url_filter(pages.limit(0), RULES).collect() == []
    none = url_filter(pages.where("page_id < 3"), RULES).collect()
    assert [r["verdict"] for r in none] == ["allow"] * 3 and longest_rule([]) is not None


def brute_ratio(urls, text, order=4):
    """Mean log ratio of two Witten-Bell models by plain counting, one character at a time."""
    import math

    counts = {True: {}, False: {}}
    for url, accepted in urls:
        u = "\2" * order + url + "\3"
        for p in range(order, len(u)):
            for k in range(order + 1):
                at = counts[accepted].setdefault(u[p - k : p], {})
                at[u[p]] = at.get(u[p], 0) + 1
    symbols = len(counts[True][""].keys() | counts[False][""].keys())

    def share(m, context, c):
        lower = share(m, context[1:], c) if context else 1 / (symbols + 1)
        after = counts[m].get(context, {})
        return (after.get(c, 0) + len(after) * lower) / (sum(after.values()) + len(after)) if after else lower

    u = "\2" * order + text + "\3"
    return sum(math.log(share(True, u[p - order : p], u[p]) / share(False, u[p - order : p], u[p])) for p in range(order, len(u))) / (len(u) - order)


def test_url_models_of_a_small_class_against_plain_counting(spark):
    """Grams of a class that has a thousandth of the characters are kept."""
    rng = random.Random(9)
    urls = [(f"http://{prose(rng, 1)}.com/good/{prose(rng, 1)}/{i}", True) for i in range(6000)]
    urls += [(f"http://{w}.net/win-{w}?q={w}", False) for w in ("casino", "poker", "lotto", "bingo", "roulette")]
    levels = train(spark.createDataFrame(urls, "url string, accepted boolean"))
    texts = ["http://casino.org/win-roulette", "http://poker.com/good/7", "", "win?q=bingo", urls[5][0], urls[-1][0]]
    got = {r["row"]: r["ratio"] for r in ratios(spark.createDataFrame(list(enumerate(texts)), "row long, url string"), levels).collect()}
    assert got == {i: pytest.approx(brute_ratio(urls, t), abs=1e-9) for i, t in enumerate(texts)}


def plain_statistics(text):
    """The statistics of a text by their definitions."""
    import math

    text = text or ""
    words, lines = [w for w in re.split("[ \t-\r]+", text) if w], text.split("\n")
    n, chars = max(len(words), 1), max(len(text), 1)
    share = lambda marks: sum(c in marks for c in text) / chars
    return {
        "log_words": math.log(len(words) + 1),
        "word_length": sum(map(len, words)) / n,
        "distinct_words": len(set(words)) / n,
        "repeats": sum(a == b for a, b in zip(words, words[1:])) / n,
        "capital_words": sum(w == w.upper() and w != w.lower() for w in words) / n,
        "capitals": sum(c.isupper() for c in text) / chars,
        "digits": share("0123456789"),
        "marks": share(".,;:?"),
        "shouts": share("!"),
        "symbols": share("#$%&*+/<=>@\\^_`{|}~[]"),
        "line_words": n / len(lines),
        "distinct_lines": len(set(lines)) / len(lines),
    }


def test_quality_scores_against_plain_rules(spark):
    """Statistics, rules and the logistic of their weights in plain Python."""
    import math

    rng = random.Random(9)
    pieces = ["Word", "word", "SHOUT!!", "a,b;", "12", "#", "é", "Ä", "\n", "\n\n", "word word", "[x]", "\\", "?"]
    texts = ["".join(rng.choice(pieces) + rng.choice(" \t ") for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", " "]
    rows = [(i, t) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(len(t or "") > 60)) for i, t in rows[::2]], "doc_id long, quality long")
    docs = documents(spark, rows)
    model = quality.fit(docs, labels, trees=4)
    assert model.rules
    for r in quality.with_score(docs, model).collect():
        stats = plain_statistics(texts[r["doc_id"]])
        total = model.intercept
        for rule, weight in model.rules:
            total += weight * all(stats[k] <= at if sign == "<=" else stats[k] > at for k, sign, at in rule)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_repeated_ids_do_not_pass_the_bound_of_the_sample(spark):
    docs = spark.createDataFrame([(i % 5, f"word {i} " * (i % 5 + 1)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality long")
    model = quality.fit(docs, labels, sample=20, trees=2)
    scores = [r["score"] for r in quality.with_score(docs, model).collect()]
    assert len(scores) == 200 and all(0 <= s <= 1 for s in scores)
