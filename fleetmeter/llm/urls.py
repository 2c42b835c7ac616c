"""URL filtering: host and path rules, and logistic regression on hashed character n-grams where no rule fits.

The model is fitted on a small labelled table of URLs and scores every other URL where it lies, without a shuffle. All of it
is DataFrame functions and Spark's own estimators; no Python runs on the executors.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Hashed features, and the lengths of the character n-grams.
DIMENSIONS, GRAMS = 1 << 14, (3, 4)
#: Most labelled URLs that the model is fitted on.
SAMPLE = 2000
#: From this probability on a URL is blocked.
THRESHOLD = 0.5
ROUNDS, REGULARISATION = 25, 0.01


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _first_fit(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, or null. The list of rules is a short policy, not data."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(str(r))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, told apart; repeats included."""

    def of(text: Column, mark: str, n: int) -> Column:
        framed = F.concat(F.lit(mark), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}:"), F.substring(framed, i, F.lit(n))))

    return F.flatten(F.array(*[of(text, mark, n) for text, mark in ((host, "@"), (path, "/")) for n in GRAMS]))


def judged(urls: DataFrame, rules: list[Rule], url: str = "url", out: str = "_judged") -> DataFrame:
    """``urls`` with a struct ``out`` of host, path, rule and verdict (null where no rule fits)."""
    host, path = host_and_path(F.col(url))
    parts = urls.withColumn("_parts", F.struct(host.alias("host"), path.alias("path")))
    host, path = F.col("_parts.host"), F.col("_parts.path")
    value = F.struct(
        host.alias("host"), path.alias("path"), _first_fit(rules, host, path, str).alias("rule"),
        _first_fit(rules, host, path, lambda r: r.verdict).alias("verdict"),
    )
    return parts.withColumn(out, value).drop("_parts")


def labelled_by_rules(urls: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """A small labelled table: at most SAMPLE different (host, path) that a rule decides, those with the least hashes."""
    found = judged(urls.select(F.col(url).alias("url")), rules)
    decided = found.where("_judged.verdict is not null").select("_judged.host", "_judged.path", "_judged.verdict").distinct()
    return decided.orderBy(F.xxhash64("host", "path"), "host", "path").limit(SAMPLE)


def _vectors(df: DataFrame, host: Column, path: Column) -> DataFrame:
    hashed = HashingTF(numFeatures=DIMENSIONS, inputCol="_grams", outputCol="_vector")
    return hashed.transform(df.withColumn("_grams", grams(host, path))).drop("_grams")


def fit(labelled: DataFrame) -> LogisticRegressionModel | str:
    """The model of a labelled table (``host``, ``path``, ``verdict``), or a verdict for all where there is nothing to learn.

    Only verdicts ``block`` and ``allow`` count. Without rows everything is allowed; with rows of one verdict that one holds. Of
    more than SAMPLE rows those with the least hashes are taken, so that the same table gives the same model.
    """
    usable = labelled.where(F.col("verdict").isin("block", "allow"))
    table = usable.orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(SAMPLE)
    table = checkpointed(table.select("host", "path", (F.col("verdict") == "block").cast("double").alias("label")))
    kinds = [r[0] for r in table.select("label").distinct().collect()]
    if len(kinds) < 2:
        return "block" if kinds == [1.0] else "allow"
    learner = LogisticRegression(
        featuresCol="_vector", labelCol="label", maxIter=ROUNDS, regParam=REGULARISATION, standardization=False
    )
    return learner.fit(_vectors(table, F.col("host"), F.col("path")))


def verdicts(pages: DataFrame, rules: list[Rule], model: LogisticRegressionModel | str, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``p_block``.

    The longest rule that fits decides, else the model. A null URL, or one without ``://``, has an empty host and path, which no
    rule fits; the model judges it by its intercept and the frame of the empty text. ``p_block`` is null where a rule decides.
    """
    rows = judged(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), rules).drop("url")
    found = [F.col("_judged")[c].alias(c) for c in ("host", "path", "rule")]
    if isinstance(model, str):
        return rows.select("page_id", *found, F.coalesce("_judged.verdict", F.lit(model)).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    scored = model.transform(_vectors(rows, F.col("_judged.host"), F.col("_judged.path")))
    p = vector_to_array("probability")[1]
    by_model = F.when(p >= THRESHOLD, "block").otherwise("allow")
    return scored.select(
        "page_id", *found, F.coalesce("_judged.verdict", by_model).alias("verdict"),
        F.when(F.col("_judged.verdict").isNull(), p).alias("p_block"),
    )
