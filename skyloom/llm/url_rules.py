"""URL verdicts by fixed host and path rules and by mined association rules.

Spark's FP-growth mines which combinations of URL tokens go with the class of bad pages in a
labelled table. Rules below a support, a confidence or a lift are pruned, and so are rules that
contain a shorter one. A rule is filed under its rarest token only: a page looks up its own tokens
and checks the few rules found there.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from skyloom.llm.common import table

# Fixed rules of the query: verdict, host, beginning of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.002  # share of the labelled pages that have the tokens and are bad
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
BAD = "class=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path of a URL; both '' for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host and each domain above it, path words, query keys, file ending."""
    host, path = host_and_path(url)
    parts = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(parts, i, F.size(parts)), "."))
    )
    words = F.transform(
        F.filter(F.split(path, r"[/.\-_]"), lambda w: (w != "") & ~w.rlike("^[0-9]+$")),
        lambda w: F.concat(F.lit("path="), w),
    )
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    keys = F.transform(
        F.filter(query, lambda q: q != ""), lambda q: F.concat(F.lit("key="), F.regexp_extract(q, "^[^=]*", 0))
    )
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "^([^:]*)://", 1)))
    made = F.array_distinct(F.concat(scheme, domains, words, keys))
    return F.when(host != "", made).otherwise(F.array().cast("array<string>"))


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
) -> DataFrame:
    """``filed_under, needs``: minimal token sets that tell bad pages, from (url, bad).

    Rows with a null label or a URL without host teach nothing; without rows there are no rules.
    """
    rows = labelled.where(F.col("bad").isNotNull()).select(tokens(F.col("url")).alias("t"), "bad").where(F.size("t") > 0)
    items = rows.select(F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items"))
    model = FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(
        (F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= min_lift)
    ).select(F.array_sort("antecedent").alias("needs"))
    # a rule with a shorter one inside adds nothing; the shorter one shares one of its tokens
    inside = found.select(F.col("needs").alias("short"), F.explode("needs").alias("token"))
    longer = (
        found.select("needs", F.explode("needs").alias("token"))
        .join(inside, "token")
        .where((F.size("short") < F.size("needs")) & (F.size(F.array_except("short", "needs")) == 0))
        .select("needs")
    )
    least = found.join(longer.distinct(), "needs", "left_anti")
    rarity = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    return (
        least.select("needs", F.explode("needs").alias("token"))
        .join(rarity, "token")
        .groupBy("needs")
        .agg(F.min_by("token", F.struct("freq", "token")).alias("filed_under"))
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest fixed rule that fits; null without one. A rule fits its host and subdomains."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, kind).otherwise(verdict)
    return text, verdict


def judged(pages: DataFrame, mined: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for every page row.

    ``mined`` tells whether a mined rule fits; it decides where no fixed rule does. Null URLs have no
    tokens and are allowed. Repeated rows each get a row; other columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(
        "page_id",
        F.monotonically_increasing_id().alias("row"),
        host.alias("host"),
        path.alias("path"),
        tokens(F.col("url")).alias("has"),
    )
    looked = rows.select("*", F.explode_outer("has").alias("token")).join(
        mined,
        (F.col("token") == F.col("filed_under")) & (F.size(F.array_except("needs", "has")) == 0),
        "left",
    )
    met = looked.groupBy("row", "page_id", "host", "path").agg(F.count("needs").alias("fitting"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return met.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("fitting") > 0, "block").otherwise("allow")).alias("verdict"),
        (F.col("fitting") > 0).alias("mined"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages that have a quality label under their id; any label 0 makes an id bad."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    return pages.select("page_id", "url").join(known, "page_id").select("url", "bad")


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages, mine(labelled_pages(pages, table(spark, sf_dir, "labels"))))
