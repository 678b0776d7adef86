"""URL filter by association rules (operator 8), all in DataFrame, SQL and Spark ML operations.

A URL becomes a set of tokens: its host suffixes, host words, first path segment and parameter names. Tokens that stand in
the same labelled URLs are one item, which loses nothing and spares every subset of them. FP-growth mines the item sets of
labelled URLs together with their label; an item set needs ``SUPPORT`` of them, and ``URLS`` at least; rules ``tokens -> label`` with enough support and confidence are
kept if they tell more than the label's own share, without those that a more general rule covers. A rule tells more if its
lift is ``LIFT``, or, as a frequent label leaves no room for that, if its error is the label's over ``LIFT`` at most; the
error is taken with ``PRIOR`` more URLs at the label's share, so that few URLs do not pass by chance. An inverted index holds each rule under its rarest token;
a URL looks up its tokens and keeps the rules all of whose tokens it has. The most confident rule decides, block before
allow, and ``allow`` where none fits.

Curated rules (host, path) come first: a rule fits its host and all subdomains if the path starts with its path; the
longest wins.

Defined results: a null URL or one without ``://`` has an empty host and path and is allowed unless a rule says else;
URLs that repeat are judged once and each row gets the verdict; without labels nothing is mined; other columns are
never read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import broadcast_if_small
from .common import prepare, query, stored, table

#: (verdict, host, path) of the curated rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Support as a share of the labelled URLs, confidence, and lift over the label's own share.
SUPPORT, CONFIDENCE, LIFT = 0.001, 0.8, 1.5
#: Labelled URLs that an item set needs at least, however few there are: fewer say nothing.
URLS = 10
#: URLs at the label's share that are added to those of a rule before its error is compared.
PRIOR = 20
LABELS = ("label=block", "label=allow")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; numbers say nothing and are left out."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    words = F.transform(F.split(host, r"[^a-z0-9]+"), lambda w: F.concat(F.lit("word="), w))
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike("^[0-9]"))
    segments = F.transform(segments, lambda s: F.concat(F.lit("path="), s))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda p: F.concat(F.lit("query="), p))
    every = F.array_distinct(F.concat(suffixes, words, segments, names))
    return F.filter(every, lambda t: ~t.isin("word=", "host="))


def merged(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``labelled`` (tokens, blocked) with ``items`` instead of tokens, and item, members, n: the tokens that stand in the same n URLs."""
    rows = stored(labelled.select("tokens", "blocked").withColumn("id", F.monotonically_increasing_id()), "url-rows")
    each = rows.select("id", F.explode("tokens").alias("token"))
    # The URLs of a token, as their number and two independent sums of 64-bit hashes.
    hashes = [F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b")]
    places = stored(each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *hashes), "url-tokens")
    items = stored(places.groupBy("n", "a", "b").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")), "url-items")
    own = each.join(broadcast_if_small(items.select("item")), F.col("token") == F.col("item"), "left_semi")
    own = own.groupBy("id").agg(F.collect_list("token").alias("items"))
    return rows.join(own, "id", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "blocked"), items.select("item", "members", "n")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = URLS) -> DataFrame:
    """Rules from ``labelled`` (tokens, blocked): antecedent, verdict, confidence, support. A written table."""
    rows, items = merged(labelled)
    baskets = stored(rows.select(F.concat("items", F.array(F.when(F.col("blocked"), LABELS[0]).otherwise(LABELS[1]))).alias("items")), "url-baskets")
    n = baskets.count()
    enough = min(1.0, max(support, least / n)) if n else 1.0
    rules = FPGrowth(itemsCol="items", minSupport=enough, minConfidence=confidence).fit(baskets).associationRules
    error, urls = 1 - F.col("confidence") / F.col("lift"), F.col("support") / F.col("confidence") * n
    surer = ((1 - F.col("confidence")) * urls + PRIOR * error) * lift <= (urls + PRIOR) * error
    rules = rules.filter(F.col("consequent")[0].isin(*LABELS) & ((F.col("lift") >= lift) | surer)).select(
        F.array_sort("antecedent").alias("antecedent"), F.regexp_extract(F.col("consequent")[0], "=(.*)", 1).alias("verdict"), "confidence", "support"
    )
    rules = stored(rules, "url-rules")
    # A rule goes if a part of its items says the same at least as surely: the part is looked up by its rarest item.
    parts = inverted(rules, items.select(F.col("item").alias("token"), "n")).select("token", F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("sure"))
    covered = (
        rules.withColumn("token", F.explode("antecedent"))
        .join(broadcast_if_small(parts), ["token", "verdict"])
        .filter((F.size("part") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
        .select("antecedent", "verdict")
        .distinct()
    )
    kept = stored(rules.join(covered, ["antecedent", "verdict"], "left_anti").withColumn("rule", F.monotonically_increasing_id()), "url-kept-rules")
    # Back to tokens: a URL that was not labelled has to have all tokens of an item.
    whole = kept.select("rule", F.explode("antecedent").alias("item")).join(items, "item").groupBy("rule").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("antecedent"))
    return stored(kept.drop("antecedent").join(whole, "rule").select("antecedent", "verdict", "confidence", "support"), "url-whole-rules")


def inverted(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """Each rule under the rarest of its tokens; ``seen`` (token, n) says how often each stands."""
    wanted = rules.select("antecedent", "verdict", F.explode("antecedent").alias("token"))
    rarest = wanted.join(seen, "token").groupBy("antecedent", "verdict").agg(F.min(F.struct("n", "token")).alias("least"))
    return rules.join(rarest, ["antecedent", "verdict"]).select(F.col("least.token").alias("token"), "antecedent", "verdict", "confidence", "support")


def curated(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    whens = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        value = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        whens = whens.when(fits, value)
    return whens


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule, verdict, mined (the tokens that decided) and confidence.

    ``labels`` (url, blocked) are the labelled URLs to mine.
    """
    prepare(pages.sparkSession)
    host, path = host_path(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    known = stored(labels.filter("blocked is not null").select(tokens(F.col("url"), host, path).alias("tokens"), "blocked"), "url-labels")
    seen = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = stored(inverted(mine(known), seen), "url-index")

    urls = own.filter("url is not null").select("url", "host", "path").distinct()
    asked = urls.select("url", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    met = asked.select("url", "tokens", F.explode("tokens").alias("token")).join(broadcast_if_small(index), "token")
    met = met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct("confidence", (F.col("verdict") == "block").alias("blocks"), "support", "antecedent")
    best = met.groupBy("url").agg(F.max(order).alias("best"))

    out = own.join(best, "url", "left").withColumn("by_rule", curated(F.col("host"), F.col("path"), rules))
    mined = F.when(F.col("best.blocks"), "block").otherwise("allow")
    return out.select(
        "page_id", "url", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce(F.col("by_rule.verdict"), mined).alias("verdict"),
        F.when(F.col("by_rule").isNull(), F.col("best.antecedent")).alias("mined"), F.when(F.col("by_rule").isNull(), F.col("best.confidence")).alias("confidence"),
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the documents that page URLs name by number: toxic or poor ones are to be blocked."""
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"/([0-9]{1,18})(?:[^0-9]|$)", 1)
    rows = pages.select("url", number.try_cast("bigint").alias("doc_id"))
    marked = labels.select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return rows.join(marked, "doc_id").select("url", "blocked")


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, page_labels(pages, table(spark, sf_dir, "labels")), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined", " ").alias("mined"), "confidence")
