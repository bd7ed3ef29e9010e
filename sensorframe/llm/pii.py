"""Personal data: fixed patterns, and contextual extraction that starts from what these find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.session import stored

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A match begins at the start of a run or where the last match ended: from inside a run it fails as it did from
# the start. Possessive runs keep the scan linear and the stack flat on texts of any length.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A text without a match of this has none of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
KINDS = [*PATTERNS, "context"]
# A token with a digit or an at sign may be an identifier.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# Characters on both sides of a token that its context is taken from; longer words count by their near end.
SIDE = 80
# Shape of a token that is an identifier for sure: length, digits, letters, different characters, letters after digits.
SHAPE = {"shortest": 16, "longest": 512, "digits": 4, "letters": 4, "different": 8, "turns": 3}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Check sum of at most 19 digits, from the right."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    octets = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255))
    card = F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", octets).when(kind == "card", card).otherwise(n.between(8, 15))
    )


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Matches in order with the text's length before each since the last one, and the end of that text."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(
        found,
        lambda m, i: F.struct(
            i.alias("at"),
            F.length(F.get(gaps, i)).alias("gap"),
            m.alias("match"),
            F.right(F.get(gaps, i), F.lit(SIDE)).alias("left"),
            F.left(F.get(gaps, i + 1), F.lit(SIDE)).alias("right"),
        ),
    )
    return F.when(text.rlike(hint), rows)


def _placed(rows: DataFrame) -> DataFrame:
    """Start and end of each match from the lengths of gaps and matches before it in its text."""
    before = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(before)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("match"))


def _shaped(core: Column) -> Column:
    """Whether a token looks like a key or hash: long, of letters and digits in turn, with many different characters."""
    n, letters, digits = F.length(core), F.regexp_replace(core, "[^A-Za-z]", ""), _digits(core)
    return (
        n.between(SHAPE["shortest"], SHAPE["longest"])
        & core.rlike("^[A-Za-z0-9+/_=.-]++$")
        & (F.length(digits) >= SHAPE["digits"])
        & (F.length(letters) >= SHAPE["letters"])
        & (F.size(F.array_distinct(F.split(core, ""))) >= SHAPE["different"])
        & (F.regexp_count(core, F.lit("[0-9][A-Za-z]")) >= SHAPE["turns"])
    )


def _contexts(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, start, end, token, pattern, seed, known): identifier-like tokens, once for each pattern they stand in.

    Patterns are the two words before, the word before, and the word after. Marks around a token are not part of it. A
    token is a seed if it overlaps a span of a fixed pattern (then it is ``known``) or if its shape leaves no doubt.
    """
    edge = r"^[^A-Za-z0-9]*+"
    head = F.length(F.regexp_extract("match", edge, 0))
    tail = F.when(head < F.length("match"), F.length(F.regexp_extract(F.reverse("match"), edge, 0))).otherwise(0)
    core = F.substring(F.col("match"), head + 1, F.length("match") - head - tail)
    before, after = F.lower("left"), F.lower("right")
    two = F.regexp_replace(F.regexp_extract(before, r"(\S++\s++\S++)\s*+$", 1), r"\s+", " ")
    patterns = {"< ": two, "< . ": F.regexp_extract(before, r"(\S++)\s*+$", 1), "> ": F.regexp_extract(after, r"^\s*+(\S++)", 1)}
    named = F.array(*[F.when(p != "", F.concat(F.lit(side), p)) for side, p in patterns.items()])
    tokens = tokens.select(
        "row", (F.col("start") + head).alias("start"), (F.col("end") - tail).alias("end"), F.lower(core).alias("token"),
        _shaped(core).alias("shaped"), F.array_compact(named).alias("patterns"),
    ).where("token != ''")
    base = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("base"))
    known = F.exists("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    tokens = tokens.join(base, "row", "left").withColumn("known", F.coalesce(known, F.lit(False))).drop("base")
    return tokens.select("row", "start", "end", "token", F.explode("patterns").alias("pattern"), (F.col("known") | F.col("shaped")).alias("seed"), "known")


def discover(contexts: DataFrame, rounds: int = 3, support: int = 3, confident: float = 0.8) -> DataFrame:
    """(row, start, end) of tokens that no fixed pattern found and that stand in a pattern of high confidence.

    Patterns and tokens form a graph, one edge for each pair that occurs. Seeds weigh 1. In each round a
    pattern's weight is the mean weight of its tokens, with one token of weight 0 added as caution, and 0 below
    ``support`` different seeds; a token's weight is that of its best pattern. Edges are combined before they
    are shuffled, so a frequent pattern or token costs its different neighbours only.
    """
    edges = stored(contexts.groupBy("pattern", "token").agg(F.max("seed").alias("seed")))
    weight = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("weight", F.lit(0.0)))
    tokens = edges.select("token", F.lit(None).cast("double").alias("weight")).limit(0)
    for _ in range(rounds):
        weighed = edges.join(tokens, "token", "left")
        patterns = weighed.groupBy("pattern").agg(
            (F.sum(weight) / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count_if("seed").alias("seeds")
        )
        patterns = stored(patterns.where(F.col("seeds") >= support).select("pattern", "confidence"))
        tokens = stored(edges.where("not seed").join(patterns, "pattern").groupBy("token").agg(F.max("confidence").alias("weight")))
    good = patterns.where(F.col("confidence") >= confident).select("pattern")
    return contexts.where("not known").join(good, "pattern").select("row", "start", "end").distinct()


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id and spans, a sorted array of (kind, start, end) in code points, end exclusive.

    Kinds are email, ip, card and phone by pattern, with the leftmost matches of each kind that do not
    overlap and matches that fail their check dropped; and context, a token with a digit or an at sign that
    no pattern found and that stands beside words which identifiers tend to stand beside (see ``discover``): what the
    fixed patterns find, and tokens of an unmistakable shape, such as keys, are the seeds. Words beside a token
    count by their nearest ``SIDE`` characters. A null text
    counts as empty and has no span; the whole text is searched; repeated rows and ids each get a row; an
    empty table gives no rows; other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    text = F.col("text")
    found = {k: _matches(text, p, HINTS[k]) for k, p in PATTERNS.items()} | {"token": _matches(text, TOKEN, "[0-9@]")}
    found = stored(
        texts.select("id", F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in found.items()])
    )

    def rows(kind: str) -> DataFrame:
        return found.where(F.col(kind).isNotNull()).select("row", F.lit(kind).alias("kind"), F.inline(kind))

    every = rows("token")
    for kind in PATTERNS:
        every = every.unionByName(rows(kind))
    placed = stored(_placed(every))
    spans = placed.where("kind != 'token'").where(_valid(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end")
    contexts = stored(_contexts(placed.where("kind = 'token'"), spans))
    more = discover(contexts, **options).select("row", F.lit("context").alias("kind"), "start", "end")
    span = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), "start", "end", "kind")
    spans = spans.unionByName(more).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    spans = spans.withColumn("spans", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return found.select("id", "row").join(spans, "row", "left").select("id", F.coalesce("spans", empty).alias("spans"))
