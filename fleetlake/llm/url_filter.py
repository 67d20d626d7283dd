"""URL filters: explicit host/path rules, and association rules mined from
the pages they label.

``RULES`` (host, path prefix, verdict) decide the URLs they fit; the longest
wins.  The URLs so decided are labelled baskets of tokens (scheme, host
suffixes, path segments, query keys); FP-growth finds token combinations
frequent among them.  Combinations that name a label with enough confidence
and support become mined rules, but not those that only say again what an
explicit rule says: the support has to come from URLs whose deciding rule names
none of the combination's tokens (its host's suffixes and subdomains, its
path's segments).  Rules that a more general one of at least the same
confidence covers are pruned.  A mined rule fires when all its tokens
are in the URL; firing rules are found by an inverted index from token to
rule, and the most confident one decides.  Where none fires, ``DEFAULT``
holds.

Every mined rule's combination occurs in at least ``MIN_SUPPORT`` of the
labelled baskets, so the number of rules is bounded by the combinations in a
basket over ``MIN_SUPPORT``, whatever the number of pages.  The joins are left
to Spark; nothing is broadcast by hint.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and gets ``DEFAULT``; repeated rows are judged alike; without
labelled URLs nothing is mined; an empty table gives an empty result.  Only
the id and the URL are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SHAPE, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SHAPE, 2), F.lit(""))


def explicit(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits; nulls if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: s:scheme, h:suffix for each host suffix, p:segment
    (runs of digits as #), q:key of the query."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda _, i: F.concat(
        F.lit("h:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""),
                           lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"\d+", "#")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1)))
    return F.when(host == "", F.array().cast("array<string>")) \
        .otherwise(F.array_distinct(F.concat(scheme, suffixes, segments, keys)))


def unnamed(items: Column, name: Column, rules) -> Column:
    """The tokens that the explicit rule ``name`` does not name itself."""
    def free(h: str, p: str) -> Column:
        labels = h.split(".")
        own = ["h:" + ".".join(labels[k:]) for k in range(len(labels))] + [f"p:{x}" for x in p.split("/") if x]
        return F.filter(items, lambda x: ~x.isin(own) & ~(x.startswith("h:") & x.endswith("." + h)))

    out = items
    for h, p, _ in rules:
        out = F.when(name == h + p, free(h, p)).otherwise(out)
    return out


def mine(baskets: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(rule, items, label, confidence, support) from labelled baskets
    (items, free, label); ``free`` are the items that count as evidence."""
    labels = [r.label for r in baskets.select("label").distinct().collect()]  # allow, block
    spark = baskets.sparkSession
    if not labels:
        return spark.createDataFrame([], "rule long, items array<string>, label string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(
        baskets.select(F.concat("items", F.array(F.concat(F.lit("="), "label"))).alias("items")))
    found = model.associationRules.where(F.col("consequent")[0].startswith("=")
                                         & ~F.exists("antecedent", lambda x: x.startswith("="))) \
        .select(F.xxhash64(F.array_sort("antecedent")).alias("rule"), F.array_sort("antecedent").alias("items"),
                F.expr("substring(consequent[0], 2)").alias("label"), "confidence", "support")
    found = written(found, "url-rules")
    # Rules whose own label has enough evidence in tokens that no deciding rule names.
    evidence = written(baskets.groupBy(F.array_sort("free").alias("free"), "label").agg(F.count("*").alias("urls")),
                       "url-evidence")
    n_all = evidence.agg(F.sum("urls")).head()[0]
    wanted = found.select("rule", "label", F.size("items").alias("n"), F.explode("items").alias("token"))
    proven = evidence.select("free", "label", "urls", F.explode("free").alias("token")).join(wanted, ["token", "label"]) \
        .groupBy("free", "label", "urls", "rule", "n").agg(F.count("*").alias("met")).where("met = n") \
        .groupBy("rule").agg(F.sum("urls").alias("urls")) \
        .where(F.col("urls") >= min_support * n_all).select("rule")
    found = written(found.join(proven, "rule", "left_semi"), "url-rules")
    # A rule is covered if all tokens of a smaller one, as confident, are its own.
    posted = found.select("rule", "label", "confidence", F.size("items").alias("n"), F.explode("items").alias("token"))
    general = posted.select(F.col("rule").alias("by"), F.col("label").alias("by_label"), F.col("n").alias("by_n"),
                            F.col("confidence").alias("by_confidence"), "token")
    covered = posted.join(general, "token").where(
        (F.col("by_label") == F.col("label")) & (F.col("by_n") < F.col("n"))
        & (F.col("by_confidence") >= F.col("confidence"))) \
        .groupBy("rule", "by", "by_n").agg(F.count("*").alias("met")).where("met = by_n").select("rule").distinct()
    return written(found.join(covered, "rule", "left_anti"), "url-rules")


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, label, confidence, items) of the best firing rule for distinct
    ``urls`` (url, items)."""
    posting = rules.select(F.explode("items").alias("token"), "rule", F.size("items").alias("n"))
    hits = urls.select("url", F.explode("items").alias("token")) \
        .join(posting.select("token").distinct(), "token", "left_semi")
    # Many URLs have the same tokens that matter; each such set is matched once.
    basket = hits.groupBy("url").agg(F.array_sort(F.collect_set("token")).alias("basket"))
    fired = basket.select("basket").distinct().select("basket", F.explode("basket").alias("token")) \
        .join(posting, "token").groupBy("basket", "rule", "n").agg(F.count("*").alias("met")).where("met = n") \
        .join(rules, "rule")
    best = fired.groupBy("basket").agg(F.max(F.struct(
        "confidence", "support", (-F.col("n")).alias("general"), "label", "items")).alias("best"))
    return basket.join(best, "basket").select(
        "url", F.col("best.label").alias("label"), F.col("best.confidence").alias("confidence"),
        F.col("best.items").alias("matched"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, default: str = DEFAULT,
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and for mined
    verdicts the confidence and the matched tokens."""
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    parsed = pages.select(F.col(f"`{page_id}`").alias("page_id"), address.alias("url")) \
        .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, verdict = explicit(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("explicit"))
    items = tokens(F.col("url"), F.col("host"), F.col("path"))
    mined = mine(parsed.where("rule IS NOT NULL").select(
        items.alias("items"), unnamed(items, F.col("rule"), rules).alias("free"), F.col("explicit").alias("label")),
        min_support, min_confidence)
    open_urls = parsed.where("rule IS NULL").select("url", "host", "path").distinct().select("url", items.alias("items"))
    return parsed.join(decide(open_urls, mined), "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("explicit", "label", F.lit(default)).alias("verdict"),
        F.when(F.col("explicit").isNull(), F.col("confidence")).alias("confidence"),
        F.when(F.col("explicit").isNull(), F.col("matched")).alias("matched"))
