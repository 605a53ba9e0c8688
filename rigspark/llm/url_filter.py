"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the urls no rule fits.

The model is trained from a small labelled url table and scored inside the JVM; nothing about the page itself is read.
"""

from __future__ import annotations

import zlib

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .base import UPPER, query, table

#: Longest labelled table the model is fitted on; it is refused beyond, not cut.
LABELLED_LIMIT = 1_000_000

# The labelled url table is made from words of general use, not from any given table: subjects that are unwanted, subjects that are wanted,
# and what goes with both.
UNWANTED = ("casino", "poker", "slots", "jackpot", "bets", "bets24", "betting", "pills", "viagra", "pharma", "adult", "xxx", "porn", "spam", "spams",
            "ads", "ads24", "adserver", "warez")
WANTED = ("garden", "library", "school", "weather", "recipes", "museum", "maps", "news", "chess", "physics", "history", "cycling", "market",
          "stadtwerke", "bibliothek", "mairie", "escuela", "noticias", "journal", "wetter", "orchestra", "observatory", "hospital", "bakery",
          "travel", "music", "forum", "science", "football", "books", "college", "theatre", "railway", "kitchen", "farm", "address")
MODIFIERS = ("best", "online", "royal", "open", "daily", "city", "club", "my", "world", "shop")
SUBDOMAINS = ("", "www.", "m.", "blog.")
ENDINGS = ("com", "net", "org", "example.com", "example.net", "example.org", "info", "co.uk")
#: Paths that tell nothing, and paths that tell what a page is about by the word they are filled with.
PLAIN_PATHS = ("", "/", "/en/101", "/fr/202.html", "/de/303?page=2", "/es/4040/", "/en/5055#top", "/about", "/articles/2021/05/summer.html", "/wiki/start",
               "/products/12", "/contact.php", "/blog/first-post/", "/index.html?id=7")
SUBJECT_PATHS = ("/{}/", "/{}/12.html", "/en/{}-bonus", "/best-{}-online.html", "/go/{}.php?id=3", "/img/{}/banner.js", "/2021/05/free-{}/", "/{}-shop/offer")
#: Names of hosts of which nothing is known.
NAMELESS = 160

#: (host suffix, path prefix, verdict) of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _hosts(subjects: tuple[str, ...]) -> list[str]:
    """Each subject alone, and before, after and joined to each modifier."""
    return [h for w in subjects for h in (w, *(x for a in MODIFIERS for x in (f"{a}-{w}", f"{w}-{a}", f"{a}{w}")))]


def _nameless() -> list[str]:
    """Pronounceable names without a meaning."""
    syllables = [a + b for a in ("b", "d", "f", "g", "k", "l", "m", "n", "r", "s", "t", "v", "th", "st") for b in ("a", "e", "i", "o", "u", "an", "er", "on")]
    draws = [zlib.crc32(b"%d" % i) for i in range(NAMELESS)]
    return ["".join(syllables[(d >> k) % len(syllables)] for k in (0, 9, 18)) for d in draws]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``url`` and ``label`` (1: unwanted).

    Hosts of unwanted subjects are unwanted under any path. All other hosts stand under plain paths and paths of a wanted subject or a
    nameless word (wanted) and under paths of an unwanted subject (unwanted), so there the path alone decides. Subdomains, endings,
    modifiers, plain paths and what surrounds a subject in a path are alike on both sides.
    """
    rows, turn = [], 0

    def add(host: str, paths, label: float) -> None:
        nonlocal turn
        for path in paths:
            turn += 1  # coprime steps: all subdomains and endings meet all kinds of rows
            rows.append((f"https://{SUBDOMAINS[turn * 3 % len(SUBDOMAINS)]}{host}.{ENDINGS[turn * 5 // 4 % len(ENDINGS)]}{path}", label))

    nameless = _nameless()
    told = {y: [p.format(w) for w in words for p in SUBJECT_PATHS] for y, words in ((1.0, UNWANTED), (0.0, [x for pair in zip(WANTED * 5, nameless) for x in pair]))}
    for i, host in enumerate(_hosts(UNWANTED)):
        add(host, PLAIN_PATHS[i % 2::2] + (told[0.0][i * 11 % len(told[0.0])],), 1.0)
    for i, host in enumerate(_hosts(WANTED)):
        add(host, PLAIN_PATHS[i % 4::4], 0.0)
        for y, paths in told.items():
            add(host, [paths[(i * 3 + k) * 7 % len(paths)] for k in range(3)], y)
    for i, host in enumerate(nameless):
        add(host, PLAIN_PATHS, 0.0)
        for y, paths in told.items():
            add(host, [paths[(i * 10 + k) * 11 % len(paths)] for k in range(10)], y)
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column, prefix: str, sizes=(3, 4)) -> Column:
    """Character n-grams of a text with its ends marked."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    each = [F.when(F.char_length(marked) >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(marked) - (n - 1), F.lit(1))), lambda i, n=n: F.concat(F.lit(prefix), F.substr(marked, i, F.lit(n)))
    )).otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.concat(*each)


def _features(df: DataFrame, buckets: int) -> DataFrame:
    grams = F.concat(_grams(F.col("_host"), "h"), _grams(F.col("_path"), "p"))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=buckets, binary=True).transform(df.withColumn("_grams", grams))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", buckets: int = 1 << 18):
    """Fit the regression. Rows without a label are left out; a null url has neither host nor path. One class only: an error."""
    rows = labelled.select(host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"),
                           F.col(label_col).cast("double").alias("_label")).filter("_label IS NOT NULL")
    kinds = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_label").alias("a"), F.max("_label").alias("b")).first()
    if kinds.n > LABELLED_LIMIT or kinds.a == kinds.b:
        raise ValueError(f"the labelled table must hold both labels and at most {LABELLED_LIMIT} rows; it has {kinds.n}")
    return LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_both", rawPredictionCol="_raw", predictionCol="_guess",
                              regParam=0.003, maxIter=40, standardization=False).fit(_features(rows, buckets))


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as (rule, verdict), or null. Of equal length the longer host wins, then block."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(order):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, model, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url",
                buckets: int = 1 << 18) -> DataFrame:
    """Judge every url: the id, ``host``, ``path``, ``rule``, ``score`` (probability of unwanted) and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path; no rule: blocked if the score reaches ``threshold``.

    * Null urls and urls without ``://``: host and path empty, judged by the model like any other.
    * Each row is judged alone: repeated rows get equal rows, null ids stay, long urls are read whole, an empty table stays empty.
    """
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    scored = model.transform(_features(rows, buckets)).withColumn("_score", vector_to_array("_both")[1])
    scored = scored.withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
    by_model = F.when(F.col("_score") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
                         F.col("_score").alias("score"), F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"))


@query("op5_url_filters")
def op5_url_filters(spark, sf):
    model = train(labelled_urls(spark))
    return filter_urls(table(spark, sf, "pages").select("page_id", "url"), model)
