"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import free_name
from sensorframe.session import stored

# At most so many labelled rows fit the model; statistics and scores cover every text.
SAMPLE = 20_000

Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold


def with_statistics(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """The rows with statistics of the whole text in further columns, and these columns by name.

    Null counts as empty, and every value is finite. Words and statistics are columns of their own, so that
    each is computed once however many rules ask for it. Their names begin with a prefix that no column has.
    """
    prefix = free_name(df, "_q_")
    text, words, lines = (F.col(prefix + x) for x in ("text", "words", "lines"))
    df = df.withColumn(prefix + "text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns(
        {prefix + "words": F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""), prefix + "lines": F.split(text, "\n")}
    )
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    stats = {
        "log_words": F.log(F.size(words) + F.lit(1.0)),
        "word_length": F.length(F.array_join(words, "")) / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "repeats": F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))) / n,
        "capital_words": F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)))) / n,
        "capitals": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "marks": share(r"[.,;:?]"),
        "shouts": share(r"!"),
        "symbols": share(r"[#$%&*+/<=>@\\^_`{|}~\[\]]"),
        "line_words": n / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }
    df = df.withColumns({prefix + k: c.cast("double") for k, c in stats.items()})
    return df, {k: F.col(prefix + k) for k in stats}


@dataclass
class RuleModel:
    """Rules with weights; the score is the logistic of the intercept and the weights of the rules that hold."""

    intercept: float
    rules: list[tuple[list[Condition], float]] = field(default_factory=list)

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(rule: list[Condition], stats: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, sign, at in rule:
        out = out & (stats[name] <= at if sign == "<=" else stats[name] > at)
    return out


def tree_rules(debug: str, names: list[str]) -> list[list[Condition]]:
    """The path to every node below the roots, as a conjunction of conditions, from the printed trees."""
    path: list[tuple[int, Condition]] = []
    rules = []
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+\dE.]+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            rule = sorted({c for _, c in path})
            if rule not in rules:
                rules.append(rule)
        elif "Tree " in line:
            path = []
    return rules


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    trees: int = 24,
    depth: int = 3,
    lasso: float = 0.001,
    seed: int = 7,
) -> RuleModel:
    """A rule model from at most ``sample`` labelled rows, those with the smallest hash of their id.

    Trees of a random forest on the statistics give the rules; logistic regression with a lasso penalty weighs
    them and drops most. Rows with a null id or label, and labels without a document, are not used; repeated rows
    count each, up to the bound. Without labels of both kinds, as with an empty table, the score is the same for every text.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    chosen = chosen.where("id is not null and label in (0, 1)").orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")  # bounded by ``sample``
    rows, stats = with_statistics(rows)
    names = list(stats)
    rows = rows.select("label", *[c.alias(k) for k, c in stats.items()])
    # Documents that share an id each come with its label; the bound holds for them too.
    rows = stored(rows.orderBy(F.xxhash64(*names), *names, "label").limit(sample))
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        good, bad = seen.get(1.0, 0) + 1, seen.get(0.0, 0) + 1
        return RuleModel(log(good / bad))
    rows = rows.orderBy(*names, "label").coalesce(4)
    table = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(table)
    rules = tree_rules(forest.toDebugString, names)
    flags = rows.select("label", *[_holds(r, {n: F.col(n) for n in names}).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags)
    line = LogisticRegression(regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(
        flags.select("label", "features")
    )
    weights = line.coefficients.toArray()
    return RuleModel(line.intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w != 0.0])


def with_score(docs: DataFrame, model: RuleModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns with the score of the whole text in a column ``out``, which replaces one of that name.

    The statistics and the compiled rules are built-in expressions of one scan without a shuffle. Null and
    empty texts are scored like any other, texts of any length whole, repeated rows each; an empty table gives none.
    Do not filter on the score in the same plan: the optimiser would move the filter below the columns of
    statistics and compute them anew for every rule. Store the scores first, as ``keep_scored`` does.
    """
    rows, stats = with_statistics(docs, text_col)
    return rows.withColumn(out, model.score(stats)).select(*[c for c in docs.columns if c != out], out)


def keep_scored(docs: DataFrame, model: RuleModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns; scores are stored before the filter.

    Every row is judged by its text alone, whatever its id; null and empty texts are scored like any other.
    """
    out = free_name(docs, "_score")
    return stored(with_score(docs, model, text_col, out)).where(F.col(out) >= least).select(*docs.columns)
