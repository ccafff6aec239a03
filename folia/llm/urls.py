"""URL verdicts: rules first, then gradient-boosted trees on lexical features.

The trees learn from urls that a rule decides, and judge the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.common import stage

# Fixed values of the contract: verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Labelled rows that the trees learn from, at most about so many.
SAMPLE = 20_000
TREES, DEPTH = 10, 3
FEATURES = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "suffix_rate", "domain_rate", "path_rate")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path; a null url, or one without ``://``, has both empty."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    out = pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
    out = out.withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    out = out.withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), "^[^?#]*", 0))
    return out.withColumn("host", F.translate("__host", UPPER, LOWER)).drop("__rest", "__host")


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def _by_rule(value: int | str, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Of the longest rule that fits: its name, or the member ``value``."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        chosen = F.when(_fits(rule[1], rule[2]), F.lit(rule[1] + rule[2] if value == "name" else rule[value])).otherwise(chosen)
    return chosen


def _lexical(rows: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    rows = rows.withColumn("__url", url)
    share = "(length(__url) - length(replace(__url, c, ''))) / length(__url)"
    entropy = f"if(length(__url) = 0, 0D, aggregate(transform(array_distinct(split(__url, '')), c -> {share}), 0D, (s, p) -> s - if(p > 0, p * log2(p), 0D)))"
    return rows.select(
        *rows.columns,
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(F.split("host", "[.]")).cast("double").alias("labels"),
        F.expr("CAST(length(path) - length(replace(path, '/', '')) AS DOUBLE)").alias("depth"),
        F.expr("if(length(__url) = 0, 0D, (length(__url) - length(regexp_replace(__url, '[0-9]', ''))) / length(__url))").alias("digits"),
        F.expr(entropy).alias("entropy"),
        F.expr("CAST(length(__url) - length(regexp_replace(__url, '[?&]', '')) AS DOUBLE)").alias("parameters"),
        F.expr("CAST(length(host) - length(replace(host, '-', '')) AS DOUBLE)").alias("hyphens"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.substring_index("host", ".", -2).alias("domain"),
        F.substring_index("path", "/", 2).alias("head"),
    ).drop("__url")


@dataclass
class Filter:
    """A trained filter: block rates by suffix, domain and first path segment, and the trees over all features."""

    rates: dict[str, DataFrame]
    rate: float
    trees: object | None

    def features(self, rows: DataFrame) -> DataFrame:
        for name, column in (("suffix_rate", "suffix"), ("domain_rate", "domain"), ("path_rate", "head")):
            rows = rows.join(self.rates[column], column, "left").withColumn(name, F.coalesce("__rate", F.lit(self.rate))).drop("__rate")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds score, the probability that a url is to be blocked."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.rate))
        scored = self.trees.transform(self.features(rows))
        return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Filter:
    """Learns from rows of _lexical() with a label of 0 or 1.

    Block rates are counted over all of them. The trees learn from about ``sample`` rows: each url stands for
    its share of the rows, rounded up or down by its hash, and that number is its weight.
    With labels of one kind only there are no trees and the rate decides; with none urls are allowed.
    """
    counted = stage(labelled.groupBy(*labelled.columns).agg(F.count("*").alias("__n")), "url-counts")
    total = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("label") * F.col("__n")), F.lit(0.0)).alias("blocked")).first()
    rate = (F.sum(F.col("label") * F.col("__n")) + 1.0) / (F.sum("__n") + 2.0)
    rates = {c: stage(counted.where(F.col(c).isNotNull()).groupBy(c).agg(rate.alias("__rate")), f"url-rates-{c}") for c in ("suffix", "domain", "head")}
    found = Filter(rates, float(total["blocked"] / total["n"]) if total["n"] else 0.0, None)
    taken = stage(weighed(counted, sample / max(total["n"], 1)), "url-sample")
    if taken.select("label").distinct().count() == 2:
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, maxBins=32, featuresCol="features", labelCol="label", weightCol="weight")
        found.trees = trees.fit(found.features(taken).select("features", "label", "weight"))
    return found


def weighed(counted: DataFrame, share: float) -> DataFrame:
    """The urls that stand for this share of the rows, with the number of rows that each stands for."""
    weight = F.floor(F.col("__n") * min(1.0, share) + F.expr("pmod(xxhash64(url), 1000000L) / 1000000D"))
    return counted.withColumn("weight", weight.cast("double")).where("weight > 0").drop("__n")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """pages (page_id, url) with host, path, rule (null where none fits), verdict and score.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest counts. Null
    and broken urls have empty host and path and are judged by the trees like any other. Further columns
    are not read; repeated rows are judged alike.
    """
    rows = with_parts(pages.select("page_id", "url")).withColumn("rule", _by_rule("name", rules)).withColumn("__verdict", _by_rule(0, rules))
    rows = _lexical(rows)
    labelled = rows.where("__verdict IS NOT NULL").withColumn("label", F.when(F.col("__verdict") == "block", 1.0).otherwise(0.0))
    trained = fit(labelled.select("url", "suffix", "domain", "head", "label", *(f for f in FEATURES if not f.endswith("_rate"))), sample)
    verdict = F.coalesce("__verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return trained.score(rows.drop("url")).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op9_url_filter(pages: DataFrame) -> DataFrame:
    return judge(pages)
