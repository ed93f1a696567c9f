"""URL filter by stated rules and mined token combinations (operator 6)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import counted_join
from ledgerloom.session import stage

# Rules of the registered query: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SUPPORT = 0.005
CONFIDENCE = 0.5
BLOCK = "label:block"
BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?`` or ``#``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_name(host: str, path: str) -> str:
    return host + path


def stated_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Name of the longest rule that fits: the rule's host or a subdomain of it, and a path that starts with its path."""
    ordered = sorted(rules, key=lambda r: (-len(rule_name(*r[:2])), rule_name(*r[:2])))
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(rule_name(h, p))) for h, p, _ in ordered
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the scheme, every label of the host with its place from the end, path parts and query keys.

    Digits become 0, so that page numbers are no tokens of their own.
    """
    scheme = F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^:/?#]*)://", 1)))
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("key:"), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_sort(F.array_distinct(F.concat(F.array(scheme), labels, parts, keys)))


def token_classes(sets: DataFrame) -> DataFrame:
    """(token, class, n) of the tokens in ``sets`` (page, tokens): tokens of just the same ``n`` pages share a class.

    A class goes by its first token. Pages are compared by their number and the sums of two
    64-bit hashes, so a token costs one record however many pages hold it.
    """
    held = sets.select("page", F.explode("tokens").alias("token"))
    two = [F.sum(F.xxhash64(F.lit(i), "page").cast("decimal(38,0)")).alias(f"h{i}") for i in (0, 1)]
    tokens = held.groupBy("token").agg(F.count("*").alias("n"), *two)
    # Equal classes are found by grouping; a class holds tokens of one URL, so it is short.
    same = tokens.groupBy("n", "h0", "h1").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return same.select(F.explode("tokens").alias("token"), F.element_at("tokens", 1).alias("class"), "n")


def mined_rules(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (classes, confidence) whose labelled pages are mostly bad, and the frequent ``token_classes``.

    FP-growth runs over the classes of tokens of labelled pages, with one more item for bad ones
    (quality 0 or toxic 1). A combination stays if it and the bad label share ``support`` of
    labelled pages and ``confidence`` of its own pages are bad. Tokens of just the same labelled
    pages, as the labels of a long host, are one class, so they do not multiply into
    combinations; a rule stands for all those with at least one token of each of its classes.
    Tokens below ``support`` are in no rule and left out before. What FP-growth may enumerate
    grows with the number of classes that one URL holds.
    """
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    known = stage(pages.join(marks, "page_id").select(F.monotonically_increasing_id().alias("page"), "tokens", "bad"), "url-pages")
    least = known.count() * support
    classes = stage(token_classes(known).where(F.col("n") >= least), "url-classes")
    kept = known.select("page", "bad", F.explode_outer("tokens").alias("token")).join(classes, "token", "left")
    # A URL's own classes, no more of them than it has tokens.
    items = kept.groupBy("page", "bad").agg(F.collect_set("class").alias("items"))
    items = stage(items.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items")), "url-items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BLOCK)
    return stage(rules.select(F.array_sort("antecedent").alias("classes"), "confidence"), "url-rules"), classes


def blocked_sets(sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """The token sets (tokens) that hold a token of each class of some rule.

    Rules are posted under their rarest class; a set looks up each of its classes and checks
    the rest of the rules that it finds.
    """
    sized = rules.withColumn("_no", F.monotonically_increasing_id()).select("_no", "classes", F.explode("classes").alias("class"))
    sized = sized.join(classes.select("class", "n").distinct(), "class")
    posted = sized.groupBy("_no", "classes").agg(F.min_by("class", F.struct("n", "class")).alias("class"))
    posted = stage(posted.select("class", F.col("classes").alias("needs")), "url-posted")
    own = sets.select(F.xxhash64("tokens").alias("key"), "tokens", F.explode("tokens").alias("token")).join(classes, "token")
    own = own.groupBy("key", "tokens").agg(F.collect_set("class").alias("own"))
    found = own.select("tokens", "own", F.explode("own").alias("class")).join(posted, "class")
    return found.where(F.size(F.array_except("needs", "own")) == 0).select("tokens").distinct()


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page, a row per input row.

    The longest stated rule decides. Without one, mined token combinations decide: block if
    one is contained in the URL's tokens, else allow. Stated rules are a short list and
    become one expression. Pages are matched with mined rules through their distinct token sets,
    which are few, since numbers are dropped: a host with a third of all pages is a few sets.
    ``labels`` (doc_id, quality, toxic) name pages by ``doc_id``; pass a table with the page's
    id under that name to teach from labelled pages.

    A null url, or one without ``://``, has an empty host and path. Null labels are not bad;
    labels of unknown pages are left out; repeated pages count each. Runs jobs when called.
    """
    verdicts = {rule_name(h, p): v for h, p, v in rules}
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": stated_rule(F.col("host"), F.col("path"), rules), "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))})
    mined, classes = mined_rules(rows, labels, support, confidence)
    sets = rows.where("rule is null").groupBy("tokens").count().select("tokens")
    # Written, so that Spark knows its size: it is broadcast below the session's limit.
    bad = stage(blocked_sets(sets, mined, classes), "url-bad")
    several = bad.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS
    bad = bad.withColumn("mined", F.lit("block"))
    by_rule = F.coalesce(*[F.when(F.col("rule") == n, v) for n, v in verdicts.items()], F.lit(None).cast("string"))
    # Above it the pages of one token set may be many, and are spread by their counts.
    joined = counted_join(rows, bad, ["tokens"], "left") if several else rows.join(F.broadcast(bad), "tokens", "left")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, "mined", F.lit("allow")).alias("verdict")
    )
