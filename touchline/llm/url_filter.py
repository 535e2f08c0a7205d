"""URL filter: allow and block rules, and gradient-boosted trees for all other URLs.

The trees see lexical features only: lengths, depth, digit and symbol ratios,
character entropy, parameter counts and statistics of the host's suffix. They are
trained from labelled URLs. Everything runs as DataFrame expressions and Spark's own
tree learner.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1000
FEATURES = [
    "_tl_length", "_tl_host_length", "_tl_path_length", "_tl_depth", "_tl_params", "_tl_labels",
    "_tl_hyphens", "_tl_longest_label", "_tl_digits", "_tl_symbols", "_tl_host_digits", "_tl_entropy",
    "_tl_host_entropy", "_tl_suffix_bad", "_tl_suffix_seen",
]


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or the end. Both are empty for a null URL and
    for one without ``://``."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.when(F.contains(text, F.lit("://")), F.substring(text, F.instr(text, "://") + 3, F.length(text)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matching_rule(host: str, path: str, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of ``rule`` (host and path written together) and ``action`` of the longest
    rule that fits; null where none does. A rule is (action, host, path); it fits its
    host and all subdomains if the path starts with the rule's. Of equally long rules
    the last in alphabetical order wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; join them as a table above {MAX_RULES}")
    fits = [
        F.when(
            ((F.col(host) == h) | F.endswith(F.col(host), F.lit(f".{h}"))) & F.startswith(F.col(path), F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,action:string>")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    drop = lambda c: size - F.length(F.replace(text, c, F.lit("")))
    parts = F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0), lambda sum_, c: sum_ + drop(c) * F.log2(drop(c).cast("double"))
    )
    return F.when(size > 0, F.log2(size.cast("double")) - parts / size).otherwise(0.0)


def with_features(urls: DataFrame, url_col: str, suffixes: DataFrame | None) -> DataFrame:
    """The rows with the columns of ``FEATURES``; ``suffixes`` has the ``_tl_suffix``
    statistics, of at most as many rows as the training sample had."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(url)
    size = F.greatest(F.length(url), F.lit(1))
    labels = F.split(F.col("_tl_host"), "\\.")
    count = lambda text, chars: F.length(F.regexp_replace(text, f"[^{chars}]", "")).cast("double")
    out = urls.withColumns({"_tl_host": host, "_tl_path": path}).withColumns(
        {
            "_tl_length": F.length(url).cast("double"),
            "_tl_host_length": F.length("_tl_host").cast("double"),
            "_tl_path_length": F.length("_tl_path").cast("double"),
            "_tl_depth": count(F.col("_tl_path"), "/"),
            "_tl_params": count(url, "=&"),
            "_tl_labels": F.size(labels).cast("double"),
            "_tl_hyphens": count(F.col("_tl_host"), "\\-"),
            "_tl_longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "_tl_digits": count(url, "0-9") / size,
            "_tl_symbols": F.length(F.regexp_replace(url, "[A-Za-z0-9]", "")) / size,
            "_tl_host_digits": count(F.col("_tl_host"), "0-9"),
            "_tl_entropy": _entropy(url),
            "_tl_host_entropy": _entropy(F.col("_tl_host")),
            "_tl_suffix": F.element_at(labels, -1),
        }
    )
    if suffixes is None:
        return out
    return out.join(F.broadcast(suffixes), "_tl_suffix", "left").fillna(
        {"_tl_suffix_bad": 0.5, "_tl_suffix_seen": 0.0}
    )


class UrlModel:
    """Trained trees with the suffix statistics they were trained on."""

    def __init__(self, trees: GBTClassificationModel, suffixes: DataFrame):
        self.trees, self.suffixes = trees, suffixes

    def block(self, urls: DataFrame, url_col: str) -> DataFrame:
        """The rows with a boolean ``_tl_block``."""
        rows = with_features(urls, url_col, self.suffixes)
        made = VectorAssembler(inputCols=FEATURES, outputCol="_tl_vector").transform(rows)
        return self.trees.transform(made).withColumn("_tl_block", F.col("_tl_prediction") == 1.0)


def train(labelled: DataFrame, max_rows: int = 20_000, trees: int = 10, depth: int = 4) -> UrlModel | None:
    """Boosted trees from (``url``, ``bad`` boolean) rows, at most ``max_rows`` different
    URLs chosen by hash. Null URLs and labels are left out; a URL with both labels counts
    as bad. None if only one label is left, since there is nothing to learn."""
    sample = (
        labelled.filter("url is not null and bad is not null")
        .groupBy("url")
        .agg(F.max("bad").alias("bad"))
        .orderBy(F.xxhash64("url"), "url")
        .limit(max_rows)
        .select("url", F.col("bad").cast("double").alias("label"))
        .cache()
    )
    try:
        if sample.select("label").distinct().count() < 2:
            return None
        host, _ = host_and_path("url")
        stats = (
            sample.groupBy(F.element_at(F.split(host, "\\."), -1).alias("_tl_suffix"))
            .agg(
                ((F.sum("label") + 1) / (F.count("*") + 2)).alias("_tl_suffix_bad"),
                F.log2(F.count("*") + 1.0).alias("_tl_suffix_seen"),
            )
            .collect()
        )
        spark = labelled.sparkSession
        table = ", ".join(
            f"named_struct('_tl_suffix', {_quoted(r[0])}, '_tl_suffix_bad', {r[1]!r}D, '_tl_suffix_seen', {r[2]!r}D)"
            for r in stats
        )
        suffixes = spark.range(1).selectExpr(f"inline(array({table}))")
        rows = VectorAssembler(inputCols=FEATURES, outputCol="_tl_vector").transform(
            with_features(sample, "url", suffixes)
        )
        learner = GBTClassifier(
            featuresCol="_tl_vector", labelCol="label", predictionCol="_tl_prediction",
            maxIter=trees, maxDepth=depth, seed=1, checkpointInterval=-1,
        ).setRawPredictionCol("_tl_raw").setProbabilityCol("_tl_probability")
        return UrlModel(learner.fit(rows.select("_tl_vector", "label").coalesce(2)), suffixes)
    finally:
        sample.unpersist()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def judged(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    model: UrlModel | None,
    url_col: str = "url",
) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block): the
    longest fitting rule's, else that of the trees, else (no model) allow.

    A null URL and one without ``://`` have an empty host and path, fit no rule and are
    judged by the trees as an empty text. Columns of the input named like the new ones
    are replaced. Repeated rows are judged alike; an empty table gives an empty result.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    rows = pages.select(*[F.col(f"`{c}`") for c in columns], url.alias("_tl_url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_tl_rule", matching_rule("host", "path", rules))
    rows = model.block(rows, "_tl_url") if model else rows.withColumn("_tl_block", F.lit(False))
    return rows.select(
        *[F.col(f"`{c}`") for c in columns],
        "host",
        "path",
        F.col("_tl_rule.rule").alias("rule"),
        F.coalesce(F.col("_tl_rule.action"), F.when(F.col("_tl_block"), "block").otherwise("allow")).alias("verdict"),
    )
