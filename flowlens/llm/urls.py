"""URL filter: fixed rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict, host, path of the rules of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Lengths of the n-grams, hash space, and labelled URLs that the model is fitted on (about).
GRAMS, SPACE, FIT_ROWS = (3, 4, 5), 1 << 16, 20_000


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_rule(rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits columns ``host`` and ``path``; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def grams() -> Column:
    """Character n-grams of host and path, each marked with its part."""
    parts = []
    for mark, column in (("h", "host"), ("p", "path")):
        framed = f"concat('^', {column}, '$')"
        parts += [
            F.expr(f"transform(sequence(1, greatest(1, length({framed}) - {n - 1})), i -> concat('{mark}', substring({framed}, i, {n})))")
            for n in GRAMS
        ]
    return F.concat(*parts)


def train(labelled: DataFrame, iterations: int = 50, strength: float = 1e-3):
    """Fit on a small table of host, path, label (1.0 blocks); None if it does not hold both labels."""
    seen = {r["label"] for r in labelled.select("label").distinct().collect()}
    if seen != {0.0, 1.0}:
        return None, (seen.pop() if seen else 0.0)
    hashed = HashingTF(numFeatures=SPACE, inputCol="grams", outputCol="features", binary=True)
    rows = hashed.transform(labelled.withColumn("grams", grams())).select("features", "label")
    return LogisticRegression(maxIter=iterations, regParam=strength).fit(rows), None


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (chance of a block by the model) of every url.

    ``labelled`` (url, label 1 blocks) is a small table; without it the URLs that a rule decides are the labelled
    table, about ``fit_rows`` different ones of them chosen by a hash. With one label only, the method gives that
    verdict everywhere, with none it allows. Null urls and urls without ``://`` have an empty host and path and
    are judged by the method; repeated rows give repeated results; other columns are not read.
    """
    host, path = split(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(rules)
    ruled = parts.withColumn("rule", rule).withColumn("_verdict", verdict)
    if labelled is None:
        known = ruled.where("_verdict is not null").select("host", "path", (F.col("_verdict") == "block").cast("double").alias("label")).distinct()
        share = min(1.0, fit_rows / max(1, known.count()))
        known = known.where(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    else:
        host, path = split(F.col("url"))
        known = labelled.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    model, only = train(known.where("label is not null"))
    if model is None:
        scored = ruled.withColumn("score", F.lit(only))
    else:
        hashed = HashingTF(numFeatures=SPACE, inputCol="grams", outputCol="features", binary=True)
        scored = model.transform(hashed.transform(ruled.withColumn("grams", grams())))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    decided = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_verdict", decided).alias("verdict"), "score")
