"""URL verdicts by host rules and a character language-model ratio, in DataFrame operations only.

Two smoothed variable-order Markov models of URLs, one of accepted and one of rejected ones,
are counted on the URLs that rules decide.  URLs are spelled in an alphabet of ``SYMBOLS``
(letters lower-cased, digits as 0, anything else as ~), so a model has at most
(len(SYMBOLS) + 2)^(ORDER + 1) rows whatever the table holds; that bounds what is broadcast.
A URL's score is its log-likelihood difference divided by its length; the threshold is calibrated on a
fold of the decided URLs that the models don't see.  Scores are whole numbers (millionths of a nat), so their sums don't
depend on order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhub.llm.common import cut, md5_bits

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = LOWER + "0/.-_:?=&#%~"
START, END = "^", "$"
ORDER = 3  # symbols of context, at most
PRIOR = 4.0  # weight of the shorter context's estimate
MICRO = 1_000_000
FOLDS = 5  # one of the folds of decided URLs, by the spelled URL's MD5, places the threshold


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first :// and / ? # or the end, and from there to ? # or the end."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", known)
    rest = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def deciding(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Position of the longest rule that fits, null if none does; of equally long ones the
    one that blocks."""
    found = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i].name), rules[i].verdict == "block"))
    for i in order:
        rule = rules[i]
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def spelled(url: Column) -> Column:
    known = F.translate(F.coalesce(url.cast("string"), F.lit("")), UPPER + "123456789", LOWER + "0" * 9)
    return F.regexp_replace(known, r"[^a-z0/._:?=&#%-]", "~")


def _positions(urls: DataFrame, *keep: str) -> DataFrame:
    """A row per symbol and for the end: ``_g0`` to ``_g3``, the symbol after 0 to 3 others."""
    padded = F.concat(F.lit(START * ORDER), F.col("_spelled"), F.lit(END))
    at = urls.select(*keep, padded.alias("_padded"), F.explode(
        F.sequence(F.lit(1), F.length("_spelled") + 1)).alias("_at"))
    grams = [F.substring("_padded", F.col("_at") + (ORDER - k), F.lit(k + 1)).alias(f"_g{k}") for k in range(ORDER + 1)]
    return at.select(*keep, *grams)


def model(urls: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order k the tables (gram, ratio) and (context, ratio), in millionths of a nat.

    ``urls`` has distinct ``_spelled`` with the numbers ``_allow`` and ``_block``.  The gram's
    ratio compares P(last symbol | the others) of both models; each estimate is
    (count + PRIOR * shorter estimate) / (context count + PRIOR).  The context's ratio is what a symbol that
    neither model saw there adds to the ratio of the shorter context.
    """
    seen = _positions(urls.filter("_allow + _block > 0"), "_allow", "_block")
    grams = cut(
        seen.select("_allow", "_block", F.explode(F.array(*(f"_g{k}" for k in range(ORDER + 1)))).alias("_gram"))
        .groupBy("_gram").agg(F.sum("_allow").alias("_allow"), F.sum("_block").alias("_block")),
        "grams",
    )
    found, shorter = [], None
    for k in range(ORDER + 1):
        own = grams.filter(F.length("_gram") == k + 1).withColumn("_context", F.substring("_gram", 1, k) if k else F.lit(""))
        contexts = own.groupBy("_context").agg(F.sum("_allow").alias("_in_allow"), F.sum("_block").alias("_in_block"))
        met = own.join(contexts, "_context").withColumn("_tail", F.substring("_gram", 2, k) if k else F.lit(""))
        if shorter is None:
            even = F.lit(1.0 / (len(SYMBOLS) + 1))
            met = met.withColumn("_less_allow", even).withColumn("_less_block", even)
        else:
            met = met.join(shorter, "_tail")
        estimate = lambda side: (F.col(f"_{side}") + PRIOR * F.col(f"_less_{side}")) / (F.col(f"_in_{side}") + PRIOR)
        fitted = cut(met.select("_gram", "_context", "_in_allow", "_in_block",
                                estimate("allow").alias("_p_allow"), estimate("block").alias("_p_block")), "model")
        shorter = fitted.select(F.col("_gram").alias("_tail"), F.col("_p_allow").alias("_less_allow"),
                                F.col("_p_block").alias("_less_block"))
        micro = lambda ratio: F.round(F.log(ratio) * MICRO).cast("long")
        found.append((
            fitted.select(F.col("_gram").alias(f"_g{k}"), micro(F.col("_p_allow") / F.col("_p_block")).alias(f"_r{k}")),
            fitted.select(F.col("_context").alias(f"_c{k}"), micro(
                (F.col("_in_block") + PRIOR) / (F.col("_in_allow") + PRIOR)).alias(f"_m{k}")).distinct(),
        ))
    return found


def ratios(urls: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(_spelled, _score): thousandths of a nat per symbol, rounded down."""
    at = _positions(urls.select("_spelled"), "_spelled")
    ratio = F.lit(0)
    for k, (grams, contexts) in enumerate(tables):
        at = at.withColumn(f"_c{k}", F.substring(f"_g{k}", 1, k) if k else F.lit(""))
        at = at.join(F.broadcast(grams), f"_g{k}", "left").join(F.broadcast(contexts), f"_c{k}", "left")
        ratio = F.coalesce(F.col(f"_r{k}"), F.coalesce(F.col(f"_m{k}"), F.lit(0)) + ratio)
    summed = at.groupBy("_spelled").agg(F.sum(ratio).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return summed.select("_spelled", F.floor(F.col("_sum") / (F.col("_n") * 1000)).alias("_score"))


def threshold(decided: DataFrame) -> int:
    """The score from which URLs are allowed: best sum of the shares of allowed URLs at or
    over it and of blocked ones under it, halfway down to the next score.  0 if either kind is
    missing.

    ``decided`` has ``_score`` and ``_allows``; scores are bounded, so the sums by score are few.
    """
    sums = decided.groupBy("_score").agg(
        F.sum(F.col("_allows").cast("long")).alias("a"), F.sum((~F.col("_allows")).cast("long")).alias("b")
    ).orderBy("_score").collect()
    allowed, blocked = sum(r["a"] for r in sums), sum(r["b"] for r in sums)
    if not allowed or not blocked:
        return 0
    best, mark, under_a, under_b, before = None, 0, 0, 0, None
    for r in sums:
        at = r["_score"]
        rank = ((allowed - under_a) * blocked + under_b * allowed, -abs(at), -at)
        if best is None or rank > best:
            best, mark = rank, at if before is None else (before + at + 1) // 2
        under_a, under_b, before = under_a + r["a"], under_b + r["b"], at
    return mark


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_id, _host, _path, _rule, _verdict, _score) for every row of ``pages``.

    Null URLs, and those without ://, have an empty host and path; no rule with a path fits them.
    A rule's verdict stands; the others are allowed from the calibrated score on.  Without any
    decided URL every score is 0 and every URL is allowed.  Repeated rows are judged alike.
    """
    host, path = parts(F.col(url_col))
    known = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"),
                         spelled(F.col(url_col)).alias("_spelled"))
    at = deciding(F.col("_host"), F.col("_path"), rules)
    names = F.array(*(F.lit(r.name) for r in rules))
    verdicts = F.array(*(F.lit(r.verdict) for r in rules))
    ruled = known.withColumn("_at", at).withColumn("_rule", F.get(names, F.col("_at"))).withColumn(
        "_ruled", F.get(verdicts, F.col("_at"))).drop("_at")
    aside = md5_bits(F.col("_spelled")) % FOLDS == 0
    train = (~aside).cast("long")
    weigh = lambda verdict: F.sum(F.when(F.col("_ruled") == verdict, train).otherwise(0))
    urls = cut(ruled.groupBy("_spelled").agg(weigh("allow").alias("_allow"), weigh("block").alias("_block")), "urls")
    scores = cut(ratios(urls, model(urls)), "scores")
    judged = ruled.join(scores, "_spelled")
    mark = threshold(
        judged.filter(F.col("_ruled").isNotNull() & aside)
        .select("_score", (F.col("_ruled") == "allow").alias("_allows"))
    )
    own = F.when(F.col("_score") >= mark, "allow").otherwise("block")
    return judged.select("_id", "_host", "_path", "_rule", F.coalesce("_ruled", own).alias("_verdict"), "_score")
