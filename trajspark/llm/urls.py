"""URL filtering with association rules mined by Spark's FP-growth.

A labelled URL is a basket of its tokens (host labels, top domain, scheme, path words, file ending, query keys, fragment;
numbers are left out) and its class, block or allow. Tokens that stand in the same labelled URLs count as one, so that a
URL template with many query keys does not multiply item sets. FP-growth mines the frequent combinations; a rule from
tokens to a class is kept if its support suffices, if its confidence exceeds the class's share of all labels `min_lift`
times and by more than chance gives (`min_z` standard errors), and if no part of its tokens has as much confidence for the
same class. Rules are matched through an inverted index: each rule is filed under its rarest token, the tokens of a URL
look up the rules, and the rest of a rule's tokens is then compared. The matching rule of the highest lift gives the
verdict (ties: higher support, then allow, then the rule's text); a URL that no rule matches is allowed. Listed host rules
come first and override it.

Cases: null URLs and URLs without "://" have an empty host and path, no listed rule, and the verdict of the tokens they
have; without labels, or with labels of one class, no rule is mined and everything not listed is allowed; repeated rows
give one result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

#: (host, path, verdict): the listed rules.
LISTED = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def listed_rule(h: Column, p: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls."""
    rule = verdict = None
    for rh, rp, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule = F.when(fits, rh + rp) if rule is None else rule.when(fits, rh + rp)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, without numbers; each names the part that it comes from."""
    u = F.coalesce(url, F.lit(""))
    h, p = host(u), path(u)
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    named = lambda prefix, parts: F.transform(parts, lambda x: F.concat(F.lit(prefix), x))
    words = F.regexp_extract_all(p, F.lit(r"([^/.]*[^/.0-9][^/.]*)"), F.lit(1))
    keys = F.regexp_extract_all(u, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme:"), scheme), F.when(u.contains("#"), F.lit("fragment")), F.concat(F.lit("tld:"), F.element_at(F.split(h, r"\."), -1))),
        named("host:", F.split(h, r"\.")),
        named("path:", words),
        named("key:", keys),
    )
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull() & ~x.rlike(":$"))))


def token_groups(labelled: DataFrame, least: int) -> DataFrame:
    """token, item, freq: every token of at least `least` rows of labelled (id, tokens, verdict), with the first by name of
    the tokens that stand in the same rows."""
    h = F.xxhash64("id")
    each = labelled.select("id", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("s")).where(F.col("freq") >= least)
    # there are at most (tokens of all baskets) / least frequent tokens
    same = Window.partitionBy("freq", "x", "s").orderBy("token")
    return seen.select("token", F.first("token").over(same).alias("item"), "freq")


def mine(labelled: DataFrame, min_support: float = 0.005, min_lift: float = 1.2, min_z: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(rules: items, rarest, verdict, confidence, lift, support; groups: token, item) from a frame of url, verdict.

    FP-growth runs on the cluster; the number of rules depends on the support, not on the rows.
    """
    rows = stash(labelled.where("verdict in ('block', 'allow')").select(F.monotonically_increasing_id().alias("id"), url_tokens(F.col("url")).alias("tokens"), "verdict"))
    share = {r["verdict"]: r["n"] for r in rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    groups = stash(token_groups(rows, max(1, int(min_support * total))))
    if len(share) < 2:
        none = rows.sparkSession.createDataFrame([], "items array<string>, rarest string, verdict string, confidence double, lift double, support double")
        return none, groups
    base = F.when(F.col("verdict") == "block", share["block"] / total).otherwise(share["allow"] / total)
    each = rows.select("id", "verdict", F.explode("tokens").alias("token"))
    items = each.hint("merge").join(groups.hint("merge"), "token").groupBy("id", "verdict").agg(F.collect_set("item").alias("items"))
    left = rows.select("id", "verdict").hint("merge").join(items.hint("merge"), ["id", "verdict"], "left")
    baskets = stash(left.select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit("="), "verdict")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min(1.0, min_lift * min(share.values()) / total)).fit(baskets)
    is_class = lambda x: x.startswith("=")
    rules = model.associationRules.where(is_class(F.col("consequent")[0]) & ~F.exists("antecedent", is_class))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence", "support")
    n = F.col("support") / F.col("confidence") * total  # baskets with the rule's items
    z = (F.col("confidence") - base) * F.sqrt(n / (base * (1 - base)))
    rules = rules.withColumn("lift", F.col("confidence") / base).where((F.col("lift") >= min_lift) & (z >= min_z))
    rules = stash(rules)
    # a rule goes if some of its items alone give the same verdict as surely; both sides meet on an item
    short = rules.select(F.col("items").alias("t"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("items")[0].alias("on"))
    long = rules.select("items", "verdict", "confidence", F.explode("items").alias("on"))
    covered = long.hint("merge").join(short.hint("merge"), "on").where((F.size("t") < F.size("items")) & (F.size(F.array_except("t", "items")) == 0) & (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence"))).select("items", "verdict").distinct()
    kept = rules.hint("merge").join(covered.hint("merge"), ["items", "verdict"], "left_anti")
    often = groups.select("item", "freq").distinct()
    by_item = kept.select("*", F.explode("items").alias("item")).hint("merge").join(often.hint("merge"), "item")
    filed = by_item.groupBy("items", "verdict").agg(F.min(F.struct("freq", "item")).alias("r"), *[F.first(c).alias(c) for c in ("confidence", "lift", "support")])
    return stash(filed.select("items", F.col("r.item").alias("rarest"), "verdict", "confidence", "lift", "support")), groups


def judge(urls: DataFrame, rules: DataFrame, groups: DataFrame) -> DataFrame:
    """tokens (distinct token lists of urls.tokens that match a rule), the mined verdict and the rule's items."""
    baskets = urls.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    known = baskets.hint("merge").join(groups.select("token", "item").hint("merge"), "token")
    asked = known.groupBy("tokens").agg(F.collect_set("item").alias("basket"))
    asked = asked.select("tokens", "basket", F.explode("basket").alias("rarest"))
    found = asked.hint("merge").join(rules.hint("merge"), "rarest").where(F.size(F.array_except("items", "basket")) == 0)
    rank = F.struct(F.col("lift"), F.col("support"), (F.col("verdict") == "allow").alias("allow"), F.array_join("items", " ").alias("text"), F.col("verdict"))
    best = found.groupBy("tokens").agg(F.max(rank).alias("best"))
    return best.select("tokens", F.col("best.verdict").alias("mined"), F.col("best.text").alias("mined_rule"))


def filter_urls(pages: DataFrame, labelled: DataFrame, listed=LISTED, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for every row of pages; how: the parameters of mine()."""
    rules, groups = mine(labelled, **how)
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), h.alias("host"), p.alias("path"), url_tokens(F.col("url")).alias("tokens"))
    mined = stash(judge(urls, rules, groups))  # written, so that a basket with very many pages can be split
    out = urls.hint("merge").join(mined.hint("merge"), "tokens", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("mined"), F.lit("allow")).alias("verdict"), "mined_rule")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, verdict of the pages whose path ends in the id of a labelled document: block if of low quality or toxic."""
    doc = F.regexp_extract("url", r"^(?s:.*?)://[^?#]*/([0-9]{1,18})(?:\.html)?/?(?:[?#]|$)", 1)
    known = pages.select("url", F.when(doc != "", doc).cast("long").alias("doc_id")).where("doc_id is not null")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    mark = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad.cast("int")).alias("bad"))
    return known.hint("merge").join(mark.hint("merge"), "doc_id").select("url", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return filter_urls(pages, labelled_pages(pages, labels))
