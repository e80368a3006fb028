"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

A rule decides where one fits. All other urls get the verdict of a linear model over hashed
character n-grams of host and path, fitted on a small table of labelled urls. Fitting uses MLlib on
that table; scoring is one projection of SQL functions, without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import ascii_lower, double_array
from tallymark.session import cut

#: (verdict, host, path). A rule fits its host and all subdomains.
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
GRAM_SIZES = (3, 4, 5)
#: Feature space of one part (host or path).
BUCKETS = 1024

#: Words of which the labelled host names are made, chosen without a look at any table: hosts that sell, bait
#: or farm links, and hosts with ordinary content.
BLOCKED_WORDS = (
    "cheap discount casino poker adult xxx spam bulk ads click free bonus payday replica warez phishing".split(),
    "meds pharmacy slots jackpot cams tube links mailer server tracker money offers loans watches downloads login".split(),
)
ALLOWED_WORDS = (
    "daily city open green north family music school travel health garden river mountain island winter summer".split(),
    "news library museum weather theatre journal education station history science recipes forum nature "
    "tradition research letters".split(),
)


def host_names(words: tuple[list[str], list[str]], each: int) -> list[str]:
    """Every first word with `each` second words in turn."""
    first, second = words
    return [f"{a}-{second[(i + j) % len(second)]}" for i, a in enumerate(first) for j in range(each)]


BLOCKED_NAMES = host_names(BLOCKED_WORDS, 6)
ALLOWED_NAMES = [*host_names(ALLOWED_WORDS, 12), *ALLOWED_WORDS[0], *ALLOWED_WORDS[1]]
#: Both kinds are labelled under the same domains and paths, so that these tell nothing by themselves.
DOMAINS = ("example.com", "example.net", "example.org")
PREFIXES = ("", "www.", "blog.", "m.")
PATHS = ("/en/450", "/de/39547.html", "/fr/825?page=2&ref=x", "/es/978/", "/en/7198#top",
         "/en/36675?utm_source=feed", "/de/12", "/fr/9.html")
BLOCKED_PATHS = ("/en/buy-cheap-pills", "/en/free-spins", "/en/claim-prize", "/es/order-now")
ALLOWED_PATHS = ("/en/article", "/de/story.html", "/fr/lesson", "/en/about")


def url_parts(url: Column) -> dict[str, Column]:
    """Host in lower case and path; both empty without `://` or for a null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)),
                            r"(?s)^[^?#]*", 0)
    empty = F.lit("")
    return {"host": F.coalesce(ascii_lower(host), empty), "path": F.coalesce(path, empty)}


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.

    Rules are tried from the longest to the shortest, ties in the order given.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (F.concat(F.lit("."), host).endswith("." + rule_host)
                & path.startswith(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def gram_buckets(text: Column, sizes=GRAM_SIZES, buckets: int = BUCKETS) -> Column:
    """Bucket of every character n-gram of `text` with its borders marked."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        grams = F.transform(
            F.sequence(F.lit(1), F.length(marked) - (n - 1)),
            lambda i: F.pmod(F.xxhash64(F.substring(marked, i, F.lit(n))), F.lit(buckets)).cast("int"))
        return F.when(F.length(marked) >= n, grams).otherwise(F.array().cast("array<int>"))

    return F.concat(*[of_size(n) for n in sizes])


def _share(weights: Column, grams: Column, shift: int) -> Column:
    """Mean weight of the n-grams; 0 without any."""
    total = F.aggregate(grams, F.lit(0.0),
                        lambda acc, b: acc + F.element_at(weights, b + (shift + 1)))
    return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): each name under each domain, with prefixes and paths in turn."""
    rows = []
    for blocked, names, own in ((1, BLOCKED_NAMES, BLOCKED_PATHS), (0, ALLOWED_NAMES, ALLOWED_PATHS)):
        for i, name in enumerate(names):
            for j, domain in enumerate(DOMAINS):
                k = i + j
                path = own[k % len(own)] if k % 5 == 4 else PATHS[k % len(PATHS)]
                rows.append((f"https://{PREFIXES[k % len(PREFIXES)]}{name}.{domain}{path}", blocked))
    return spark.createDataFrame(rows, "url string, blocked int")


def fit(labelled: DataFrame, url: str = "url", label: str = "blocked",
        iterations: int = 60, penalty: float = 1e-6) -> tuple[float, list[float]]:
    """(intercept, weights) of the model; `labelled` is a small table of urls and 0/1 labels."""
    parts = url_parts(F.col(url))

    def frequencies(grams: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
            lambda b: F.when(F.size(grams) > 0, F.size(F.filter(grams, lambda g: g == b))
                             / F.size(grams)).otherwise(0.0))

    grams = labelled.select(
        F.col(label).cast("double").alias("label"), gram_buckets(parts["host"]).alias("h"),
        gram_buckets(parts["path"]).alias("p"))
    # One task: the sums of the fit then do not depend on the order of tasks.
    vectors = cut(grams.coalesce(1).select("label", F.concat(
        frequencies(F.col("h")), frequencies(F.col("p"))).alias("x"))
    ).select("label", array_to_vector("x").alias("features"))
    model = LogisticRegression(
        maxIter=iterations, regParam=penalty, standardization=False, aggregationDepth=2).fit(vectors)
    return float(model.intercept), [float(w) for w in model.coefficients.toArray()]


def filter_urls(pages: DataFrame, model: tuple[float, list[float]], url: str = "url",
                rules=RULES, threshold: float = 0.5) -> DataFrame:
    """`pages` with host, path, rule, score and verdict of every url.

    `score` is the model's probability of a block; `verdict` is the rule's where one fits.
    A null or empty url and one without `://` have empty parts and get the model's verdict on
    them. Columns of `pages` with the names of the results are replaced; rows are never dropped.
    """
    intercept, weights = model
    parts = url_parts(F.col(url))
    host, path = parts["host"], parts["path"]
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    cut_up = pages.select(*kept, host.alias("host"), path.alias("path"))
    table = double_array(weights)
    logit = (F.lit(intercept) + _share(table, gram_buckets(F.col("host")), 0)
             + _share(table, gram_buckets(F.col("path")), BUCKETS))
    judged = cut_up.withColumns({
        "__rule": rule_of(F.col("host"), F.col("path"), rules),
        "score": 1.0 / (1.0 + F.exp(-logit)),
    })
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select(
        *kept, "host", "path", F.col("__rule.rule").alias("rule"), "score",
        F.coalesce(F.col("__rule.verdict"), by_model).alias("verdict"))
