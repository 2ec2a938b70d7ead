"""URL filters: rules first, and for the rest a character language-model ratio.

Rules accept or reject a host, its subdomains and what lies below a path; the longest fitting rule wins. Two character
models, of the URLs that rules accept and of those they reject, judge the others: variable-order Markov
models with Witten-Bell smoothing over the whole address (scheme, lower-cased host, path, query, fragment), where each order falls back on the next shorter one as far as its context is
rare, down to a uniform start. An address's score is the mean log ratio of its characters, so length
doesn't matter. The threshold is calibrated: addresses whose hash falls in a fold of their own aren't learned from,
and the threshold separates that fold best by balanced accuracy.

Counts cover all URLs. They are taken once, for the longest contexts, in one pass whose counts combine
before the shuffle; shorter orders are sums of longer ones. Each different address is scored once, and only a digest of it
goes with its characters, so the work is linear in its length. The table of ratios is sent to all tasks up to
``BROADCAST_BYTES``, and joined by a shuffle beyond. Only DataFrame functions are used.

Cases: a null url or one without ``://`` has an empty host and path and fits no rule; the raw text is scored as it stands, null
as an empty one;
repeated rows get equal verdicts; without accepted or without rejected URLs the models say nothing and the method allows;
rows without page_id are judged too; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.session import written

#: Characters of the longest context.
ORDER = 4
#: Fold of addresses that only calibrate: one in so many.
CALIBRATION = 5
#: Largest table of character ratios that is sent to all tasks; a larger one is joined by shuffles.
BROADCAST_BYTES = 32 << 20
_START, _END = "\u0002", "\u0003"
#: Uniform start: one of so many characters.
_ALPHABET = 256.0
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest fitting rule, null where none fits."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.host + rule.path) if text is None else text.when(fits, rule.host + rule.path)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if text is None else (text, verdict)


def address_of(url: Column) -> Column:
    """The whole url with its host in lower case; without ``://`` the raw text."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*(.*)", 1)
    return F.when(at > 0, F.concat(F.substring(url, F.lit(1), at + 2), host_of(url), rest)).otherwise(url)


def _grams(address: Column, order: int) -> Column:
    """Every character of the address and its end, each with ``order`` characters before it."""
    padded = F.concat(F.lit(_START * order), address, F.lit(_END))
    return F.regexp_extract_all(padded, F.lit(rf"(?s)(?=(.{{{order + 1}}}))."), F.lit(1))


def log_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) from (gram, accepted, rejected) counts of all grams to be judged.

    ``ratio`` is the log of the last character's probability after the others as accepted, over that as rejected.
    """
    sides = ("accepted", "rejected")
    below = None
    for size in range(order + 1):
        own = grams.groupBy(F.expr(f"right(gram, {size + 1})").alias("gram")).agg(
            *[F.sum(side).alias(side) for side in sides]).withColumn("context", F.expr(f"left(gram, {size})"))
        contexts = own.groupBy("context").agg(
            *[F.sum(side).alias(f"n_{side}") for side in sides],
            *[F.count_if(F.col(side) > 0).alias(f"t_{side}") for side in sides])
        joined = own.join(contexts, "context")
        if below is None:
            joined = joined.select("*", *[F.lit(1 / _ALPHABET).alias(f"below_{side}") for side in sides])
        else:
            shorter = below.select(F.col("gram").alias("_rest"), *[F.col(f"p_{s}").alias(f"below_{s}") for s in sides])
            joined = joined.withColumn("_rest", F.expr(f"right(gram, {size})")).join(shorter, "_rest")
        # Witten-Bell: a context lends as much to the shorter one as it has different followers.
        smoothed = [
            F.when(F.col(f"n_{s}") > 0, (F.col(s) + F.col(f"t_{s}") * F.col(f"below_{s}")) / (
                F.col(f"n_{s}") + F.col(f"t_{s}"))).otherwise(F.col(f"below_{s}")).alias(f"p_{s}") for s in sides]
        below = joined.select("gram", *smoothed)
    return below.select("gram", (F.ln("p_accepted") - F.ln("p_rejected")).alias("ratio"))


def threshold_of(scores: DataFrame) -> float:
    """The score that separates ``scores`` (score, verdict) best: at or above it means accepted.

    Scores are counted in steps of a thousandth, so the driver sees one row. The threshold lies half-way between
    the step found and the one below.
    """
    steps = scores.groupBy(F.round(F.col("score") * 1000).cast("bigint").alias("step")).agg(
        F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    # A few thousand rows at most: scores are mean logs of probabilities.
    below = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    good = (F.coalesce(F.sum("block").over(below), F.lit(0)) / F.sum("block").over(whole)
            + 1 - F.coalesce(F.sum("allow").over(below), F.lit(0)) / F.sum("allow").over(whole))
    usable = (F.sum("block").over(whole) > 0) & (F.sum("allow").over(whole) > 0)
    under = F.coalesce(F.lag("step").over(W.orderBy("step")), F.col("step") - 1)
    best = steps.withColumn("good", F.when(usable, good)).withColumn("under", under).where("good is not null").orderBy(
        F.desc("good"), "step").first()
    return 0.0 if best is None else (best["step"] + best["under"]) / 2000


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    url = F.col("url").cast("string")
    parts = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"),
        F.coalesce(path_of(url), F.lit("")).alias("path"), F.coalesce(address_of(url), F.lit("")).alias("address"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = written(parts.select("*", F.sha2(F.col("address").cast("binary"), 256).alias("key"), rule.alias("rule"),
                                verdict.alias("_fixed")), "urls")

    # Copies of an address count for each copy, but are cut into characters once. Urls that differ after the path
    # are in one fold.
    held = F.pmod(F.xxhash64("host", "path"), F.lit(CALIBRATION)) == 0
    addresses = written(rows.groupBy("key", "address", held.alias("_held"), "_fixed").agg(
        F.count(F.lit(1)).alias("copies")), "addresses")
    cut = addresses.select("key", "_fixed", "copies", "_held", F.explode(_grams(F.col("address"), order)).alias("gram"))

    def learned(side: str) -> Column:
        return F.sum(F.when((F.col("_fixed") == side) & ~F.col("_held"), F.col("copies")).otherwise(0))

    grams = written(cut.groupBy("gram").agg(learned("allow").alias("accepted"), learned("block").alias("rejected")), "grams")
    seen = grams.agg(F.sum("accepted"), F.sum("rejected"), F.count(F.lit(1))).first()
    if not seen[0] or not seen[1]:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_fixed", F.lit("allow")).alias("verdict"),
                           F.lit(0.0).alias("score"))
    # A row has a gram, of at most order + 1 characters, and a number: 64 bytes.
    ratios = written(log_ratios(grams, order), "ratios")
    ratios = F.broadcast(ratios) if seen[2] * 64 <= BROADCAST_BYTES else ratios
    scores = written(cut.select("key", "_fixed", "_held", "gram").join(ratios, "gram").groupBy(
        "key", "_fixed", "_held").agg(F.avg("ratio").alias("score")), "scores")
    limit = threshold_of(scores.where(F.col("_held") & F.col("_fixed").isNotNull()).withColumnRenamed("_fixed", "verdict"))
    method = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return rows.join(scores.select("key", "score"), "key").select(
        "page_id", "host", "path", "rule", F.coalesce("_fixed", method).alias("verdict"), "score")


def allowed(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages``, all columns, less those whose verdict is block; rows without page_id stay."""
    gone = judged(pages, rules).where("verdict = 'block' and page_id is not null").select(
        F.col("page_id").alias("_gone")).distinct()
    return pages.join(gone, pages["page_id"].cast("bigint") == gone["_gone"], "left_anti")
