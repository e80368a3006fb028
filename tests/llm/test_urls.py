import random
import re

from pyspark.sql import functions as F

from tallymark.llm import urls


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


URLS = [
    None, "", "no scheme", "://", "http://", "http://a.net", "http://a.net/", "http://EXAMPLE.net/en/x",
    "http://example.net/en", "http://sub.Example.com/de/x?q=http://b.net/", "http://notexample.com/de/",
    "http://x.org/fr/#a", "http://net/", "http://planet/", "a://b://c.net/x", "http://h?x/de/", "http://h#/",
    "http://É.Org/fr/é", "http://x.org/fr/\nz", "http://" + "a" * 20000 + ".net/" + "b" * 20000,
]


def test_parts_and_rules(spark):
    rows = [(i, u, "clash", 1.5) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, score double")
    model = (0.0, [0.0] * (2 * urls.BUCKETS))
    got = urls.filter_urls(pages, model).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = brute(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule[1] if rule else None)
        assert r["verdict"] == (rule[0] if rule else "block")  # score 0.5 of an empty model


def test_model_tells_farms_from_pages(spark):
    model = urls.fit(urls.labelled_urls(spark))
    fresh = [("https://m.cheap-casino-pills.example.com/en/3", "block"),
             ("http://spam-farm.example.org/xx/9", "block"),
             ("https://blog.thertion.example.com/en/3", "allow"),
             ("http://library.example.org/es/9", "allow")]
    pages = spark.createDataFrame([(u, v) for u, v in fresh], "url string, want string")
    assert all(r["verdict"] == r["want"] for r in urls.filter_urls(pages, model).collect())


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.filter_urls(pages, (0.0, [0.0] * (2 * urls.BUCKETS))).count() == 0


def test_no_label_is_taken_from_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = [r[0] for r in pages.select(urls.url_parts(F.col("url"))["host"]).distinct().collect()]
    parts = {p for h in hosts for p in h.split(".")} - {"www", "blog", "m", "example", "com", "net", "org"}
    assert parts and not parts & {*urls.BLOCKED_NAMES, *urls.ALLOWED_NAMES}


def test_hosts_that_were_held_out(spark):
    """Whole host names that the model has not seen, under all domains and paths."""
    labelled = urls.labelled_urls(spark)
    name = F.regexp_extract("url", r"://(?:www\.|blog\.|m\.)?([a-z-]+)\.example", 1)
    unseen = F.pmod(F.xxhash64(name), F.lit(5)) == 0
    model = urls.fit(labelled.where(~unseen))
    judged = urls.filter_urls(labelled.where(unseen), model, rules=()).collect()
    right = sum((r["verdict"] == "block") == (r["blocked"] == 1) for r in judged)
    assert len(judged) > 100 and right / len(judged) > 0.95


def test_scores_against_a_plain_sum(spark):
    import math

    rng = random.Random(2)
    weights = [rng.uniform(-9, 9) for _ in range(2 * urls.BUCKETS)]
    df = spark.createDataFrame([(u,) for u in URLS[5:16]], "url string")
    rows = urls.filter_urls(df, (0.3, weights)).select("*", urls.gram_buckets(F.col("host")).alias("h"),
                                                       urls.gram_buckets(F.col("path")).alias("p")).collect()
    for r in rows:
        marked = f"^{r['host']}$"
        assert len(r["h"]) == sum(max(0, len(marked) - n + 1) for n in urls.GRAM_SIZES)
        logit = 0.3 + sum(sum(weights[b + k] for b in g) / len(g) if g else 0.0 for g, k in ((r["h"], 0), (r["p"], urls.BUCKETS)))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-logit)), rel_tol=1e-9)
