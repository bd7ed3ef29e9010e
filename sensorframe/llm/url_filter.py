"""URL filter: host rules, and a ratio of two character Markov models for all URLs without a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import remainder
from sensorframe.session import stored

PAD, END = "\u0002", "\u0003"
ORDER = 4
# Of the URLs with a rule, those whose id has this remainder calibrate the threshold; the others train.
FOLDS = 5
BINS = 400

Rule = tuple[str, str, str]  # verdict, host, start of the path


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty for null and for text without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def longest_rule(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """Struct of name and verdict of the longest rule that fits the host or a parent domain, else null."""
    fits = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        hit = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        fits = F.when(hit, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character and the end of each URL: the character with ``order`` characters before it."""
    padded = F.concat(F.lit(PAD * order), F.coalesce("url", F.lit("")), F.lit(END))
    urls = urls.select(*keep, padded.alias("padded"))
    urls = urls.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("padded") - order)))
    return urls.select(*keep, F.substring("padded", F.col("at"), F.lit(order + 1)).alias("gram"))


def train(urls: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Log ratios of the two models for each order: (gram, ratio) and (context, escape ratio).

    ``urls`` has url and accepted (boolean). Characters are smoothed by Witten and Bell: with n occurrences of
    the context and t different characters after it, a share t / (n + t) goes to the next shorter context, and
    below order 0 all characters are alike. Counts cover all given URLs, and every gram of either model is kept, so
    the tables grow with the URLs; only grams that neither model has seen are priced by escapes.
    """
    counts = _grams(urls, order, "accepted").groupBy("gram").agg(
        F.count_if("accepted").alias("n_a"), F.count_if(~F.col("accepted")).alias("n_b")
    )
    counts = stored(counts)
    symbols = counts.agg(F.countDistinct(F.right("gram", F.lit(1)))).first()[0]
    shorter = F.lit(1.0 / (symbols + 1))
    lower, levels = None, []
    for k in range(order + 1):
        grams = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(
            F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")
        )
        grams = grams.withColumn("context", F.expr(f"left(gram, {k})"))
        contexts = grams.groupBy("context").agg(
            *[F.sum(f"n_{m}").alias(f"s_{m}") for m in "ab"], *[F.count_if(F.col(f"n_{m}") > 0).alias(f"t_{m}") for m in "ab"]
        )
        kept = grams.join(contexts, "context")
        if lower is not None:
            kept = kept.withColumn("suffix", F.right("gram", F.lit(k))).join(lower, "suffix")
        for m in "ab":
            back = shorter if lower is None else F.col(f"q_{m}")
            size = F.col(f"s_{m}") + F.col(f"t_{m}")
            kept = kept.withColumn(f"p_{m}", F.when(size == 0, back).otherwise((F.col(f"n_{m}") + F.col(f"t_{m}") * back) / size))
        kept = stored(kept.select("gram", "p_a", "p_b"))
        lower = kept.select(F.col("gram").alias("suffix"), F.col("p_a").alias("q_a"), F.col("p_b").alias("q_b"))
        escape = [F.when(F.col(f"s_{m}") > 0, F.col(f"t_{m}") / (F.col(f"s_{m}") + F.col(f"t_{m}"))).otherwise(1.0) for m in "ab"]
        levels.append(
            (
                kept.select("gram", F.log(F.col("p_a") / F.col("p_b")).alias("ratio")),
                stored(contexts.select("context", F.log(escape[0] / escape[1]).alias("escape"))),
            )
        )
    return levels


def ratios(urls: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(row, ratio): log-likelihood of accepted less that of rejected, by character. ``urls`` has row and url."""
    order = len(levels) - 1
    rows, value = _grams(urls, order, "row"), F.lit(0.0)
    # Each gram is priced once. No table is bounded, so no join has a hint: Spark goes by measured bytes.
    grams = rows.select("gram").distinct()
    for k, (ratio, escape) in enumerate(levels):
        ratio = ratio.select(F.col("gram").alias("g"), F.col("ratio").alias(f"ratio_{k}"))
        grams = grams.withColumn("g", F.right("gram", F.lit(k + 1))).join(ratio, "g", "left").drop("g")
        if k:
            escape = escape.select(F.col("context").alias("c"), F.col("escape").alias(f"escape_{k}"))
            context = F.substring("gram", order + 1 - k, k)
            grams = grams.withColumn("c", context).join(escape, "c", "left").drop("c")
            value = value + F.coalesce(f"escape_{k}", F.lit(0.0))
        value = F.coalesce(f"ratio_{k}", value)
    values = stored(grams.select("gram", value.alias("value")))
    return rows.join(values, "gram").groupBy("row").agg(F.avg("value").alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """The cut between bins that gets most right, each class weighted alike; 0 without one of the classes."""
    bins = F.least(F.greatest(F.floor(F.col("ratio") * 50) + BINS // 2, F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(bins.alias("bin")).agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).collect()
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    count = {r[0]: (r[1], r[2]) for r in rows}
    right = 1.0  # all accepted
    best = (right, -BINS, 0)  # ties go to the cut nearest to 0
    for b in range(BINS):
        n_a, n_b = count.get(b, (0, 0))
        right += n_b / bad - n_a / good
        best = max(best, (round(right, 9), -abs(b + 1 - BINS // 2), b + 1))
    return (best[2] - BINS // 2) / 50


def url_filter(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, ratio, verdict (allow or block).

    A rule's verdict stands. All other URLs, null and malformed ones included (null counts as empty), are
    allowed if the length-normalised log-likelihood ratio reaches a threshold. The two models learn from the
    whole text of the URLs that a rule allows or blocks; a fifth of these, by CRC-32 of the id, is kept from
    training and sets the threshold on a histogram. Without URLs of both kinds the threshold is 0. Repeated
    rows and ids each keep their row; an empty table gives no rows; other columns are not looked at.
    """
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"fits": longest_rule(rules), "fold": F.coalesce(remainder("id", FOLDS), F.lit(1))})
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    taught = rows.where("fits is not null").withColumn("accepted", F.col("fits.verdict") == "allow")
    levels = train(taught.where("fold != 0").select("url", "accepted"))
    scores = stored(ratios(rows, levels))
    cut = _threshold(taught.where("fold = 0").join(scores, "row"))
    verdict = F.coalesce("fits.verdict", F.when(F.col("ratio") >= cut, "allow").otherwise("block"))
    return rows.join(scores, "row").select("id", "host", "path", F.col("fits.name").alias("rule"), "ratio", verdict.alias("verdict"))
