"""URL filter by the ratio of two character language models.

Rules judge some hosts and paths. The urls they allow and block train one smoothed variable-order Markov model each: the
probability of a character after its last ``ORDER`` ones mixes that context's counts with the probability after one character
less, down to a uniform start; a context never seen leaves it to the shorter one. A url's score is the difference of its two
log-likelihoods for each character. The score that lies equally many standard deviations from both means of the urls set
aside for calibration (one in five, by hash) parts allow from block for all urls without a rule.

Counts are grouped by n-gram over all urls, combined before the shuffle; only SQL functions run.

Defined results: a null url counts as empty; hosts and paths follow the first ``://``; rows with null or repeated identifiers
are judged like any other; if one kind of rule matches no url, urls without a rule are allowed; an empty table gives an empty
result. Urls of any length are scored whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import SMALL, ascii_lower
from geopanel.session import materialised

#: (host, path, verdict); the longest that fits wins.
Rule = tuple[str, str, str]
ORDER, WEIGHT, ALPHABET, FIFTHS = 4, 2.0, 256, 5
#: Characters before a url and after it.
FRONT, BACK = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(url: Column) -> Column:
    """Each character with the ``ORDER`` ones before it."""
    chars = F.split(F.concat(F.lit(FRONT * ORDER), url, F.lit(BACK)), "")
    return F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.array_join(F.slice(c, i, ORDER + 1), "")))[0]


def model(counts: DataFrame) -> DataFrame:
    """(gram, gain): log of the ratio of a character's two probabilities. ``counts`` has gram, allow and block."""
    total = counts.agg(F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0)).alias("block")).first()
    uniform = 1.0 / ALPHABET
    level = None
    for order in range(ORDER + 1):
        own = counts.groupBy(F.right("gram", F.lit(order + 1)).alias("s")).agg(F.sum("allow").alias("na"), F.sum("block").alias("nb"))
        if order == 0:
            own = own.withColumns({"ca": F.lit(total["allow"]), "cb": F.lit(total["block"]), "pa": F.lit(uniform), "pb": F.lit(uniform)})
        else:
            context = own.groupBy(F.substring("s", 1, order).alias("x")).agg(F.sum("na").alias("ca"), F.sum("nb").alias("cb"))
            own = own.withColumn("x", F.substring("s", 1, order)).join(context, "x").withColumn("t", F.right("s", F.lit(order)))
            own = own.join(level.withColumnRenamed("s", "t"), "t")
        mixed = lambda n, c, p: (F.col(n) + F.lit(WEIGHT) * F.col(p)) / (F.col(c) + F.lit(WEIGHT))
        level = own.select("s", mixed("na", "ca", "pa").alias("pa"), mixed("nb", "cb", "pb").alias("pb"))
    return level.select(F.col("s").alias("gram"), (F.log("pa") - F.log("pb")).alias("gain"))


def judged(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("m", matched(F.col("host"), F.col("path"), rules))
    aside = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(FIFTHS)) == 0
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.first("m.verdict").alias("known"))
    urls = materialised(urls.withColumn("aside", aside))
    learned = lambda v: F.sum(F.when((F.col("known") == v) & ~F.col("aside"), F.col("n")).otherwise(F.lit(0)))
    split = urls.withColumn("gram", F.explode(grams(F.col("url"))))
    gains = materialised(model(materialised(split.groupBy("gram").agg(learned("allow").alias("allow"), learned("block").alias("block")))))
    gains = F.broadcast(gains) if gains.count() <= SMALL else gains
    scores = materialised(split.join(gains, "gram").groupBy("url").agg(F.avg("gain").alias("score"), F.first("known").alias("known"), F.first("aside").alias("aside"), F.first("n").alias("n")))
    held = scores.where("aside AND known IS NOT NULL").groupBy("known").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("s"), F.sum(F.col("n") * F.col("score") * F.col("score")).alias("q"))
    part = {r["known"]: (r["s"] / r["n"], max(0.0, r["q"] / r["n"] - (r["s"] / r["n"]) ** 2) ** 0.5) for r in held.collect()}
    threshold = float("-inf")
    if len(part) == 2:
        (ma, sa), (mb, sb) = part["allow"], part["block"]
        threshold = (ma * sb + mb * sa) / (sa + sb) if sa + sb > 0 else (ma + mb) / 2
    own = F.when(F.col("score") >= F.lit(threshold), F.lit("allow")).otherwise(F.lit("block"))
    return rows.join(scores.select("url", "score"), "url").select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", own).alias("verdict"), "score")
