"""URL filters: rules on hosts and paths, and boosted trees for the rest.

All on DataFrame and SQL functions: the trees are fitted by Spark ML on a
bounded sample and then become one SQL expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwatch.llm.common import materialize

#: At most this many labelled URLs are learnt from, chosen by hash of the URL.
SAMPLE = 20_000
#: Suffix statistics of up to so many bytes are broadcast; of more, each row of
#: a URL meets one of so many copies.
BROADCAST_BYTES, SALTS = 8 << 20, 32
TREES, DEPTH, SEED = 8, 4, 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_host_length", "f_depth", "f_digit_ratio", "f_entropy", "f_params", "f_labels", "f_suffix_rate", "f_suffix_count"]


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host and path, as ``example.com/en/7``; ``verdict`` allow or block."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(rules: list[Rule], host: Column, path: Column) -> Column:
    """Pattern of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with its path.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.pattern)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def with_features(df: DataFrame, url: str, suffixes: DataFrame | None, prior: float = 0.5) -> DataFrame:
    """Add the lexical features of ``url`` and its host's suffix statistics."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    out = df.withColumns(
        {
            "f_length": F.length(u).cast("double"),
            "f_host_length": F.length(host).cast("double"),
            "f_depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
            "f_digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1)),
            "f_entropy": _entropy(u),
            "f_params": F.when(F.instr(u, "?") > 0, F.length(u) - F.length(F.replace(u, F.lit("&"), F.lit(""))) + 1).otherwise(0).cast("double"),
            "f_labels": (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).cast("double"),
            "_suffix": F.substring_index(host, ".", -1),
        }
    )
    if suffixes is None:
        return out
    if "_salt" in suffixes.columns:
        out = out.withColumn("_salt", F.monotonically_increasing_id() % SALTS)
        joined = out.join(suffixes, ["_suffix", "_salt"], "left").drop("_salt")
    else:
        joined = out.join(suffixes, "_suffix", "left")
    return joined.withColumns({"f_suffix_rate": F.coalesce("s_rate", F.lit(prior)), "f_suffix_count": F.coalesce("s_count", F.lit(0.0))}).drop("s_rate", "s_count")


def _tree_column(lines: list[str]) -> Column:
    """A tree as nested CASE expressions, from Spark's printed form."""
    line = lines.pop(0).strip()
    if leaf := re.match(r"Predict: (\S+)", line):
        return F.lit(float(leaf[1]))
    feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree_column(lines)
    lines.pop(0)  # the Else line
    high = _tree_column(lines)
    return F.when(F.col(FEATURES[int(feature)]) <= float(threshold), low).otherwise(high)


@dataclass
class UrlModel:
    suffixes: DataFrame | None
    prior: float
    margin: Column
    #: the fitted trees that ``margin`` spells out
    trees: GBTClassificationModel | None = None


def train(labelled: DataFrame, url: str = "url", label: str = "label", *, sample: int = SAMPLE) -> UrlModel:
    """Fit boosted trees on URLs labelled 1 (block) or 0 (allow).

    The rates and counts of suffixes are of all distinct labelled URLs. The
    trees are fitted on a bounded sample: the ``sample`` distinct labelled
    URLs with the smallest hashes. If it lacks one of the labels, the model answers
    the label that is there, or allow when there is none. Null URLs or
    labels are left out.
    """
    distinct = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.max(F.col(label).cast("int")).alias("label"))
    suffix = F.substring_index(host_of(F.col("url")), ".", -1).alias("_suffix")
    counts = materialize(distinct.groupBy(suffix).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")), "suffixes")
    every = counts.agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.octet_length("_suffix") + 64).alias("bytes")).first()
    picked = distinct.orderBy(F.xxhash64("url"), "url").limit(sample).coalesce(1).cache()
    totals = picked.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    if not totals["n"] or totals["p"] in (0, totals["n"]):
        picked.unpersist()
        return UrlModel(None, 0.5, F.lit(1.0 if totals["p"] else -1.0))
    prior = every["p"] / every["n"]
    suffixes = counts.select("_suffix", ((F.col("p") + prior) / (F.col("n") + 1.0)).alias("s_rate"), F.col("n").cast("double").alias("s_count"))
    if every["bytes"] <= BROADCAST_BYTES:
        suffixes = F.broadcast(suffixes)
    else:
        suffixes = suffixes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(picked, "url", suffixes, prior)).select("features", F.col("label").cast("double").alias("label")).coalesce(1).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxMemoryInMB=64).fit(ready)
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        margin = margin + _tree_column(tree.toDebugString.splitlines()[1:]) * float(weight)
    ready.unpersist()
    picked.unpersist()
    return UrlModel(suffixes, prior, margin, model)


def judge(df: DataFrame, rules: list[Rule], url: str = "url", *, sample: int = SAMPLE) -> DataFrame:
    """Add ``host, path, rule, verdict, block_margin`` to every row.

    The URLs that a rule decides are the labelled ones the trees learn from;
    the trees decide the others (block if ``block_margin`` is above 0). Null
    URLs and those without ``://`` have an empty host and path and are
    judged by their features alone. Repeated rows are judged alike; a
    clashing column is replaced; an empty table stays empty.
    """
    new = ["host", "path", "rule", "verdict", "block_margin"]
    # the row travels as one column, so that its names meet none of the names below
    rows = df.select(F.struct(*[c for c in df.columns]).alias("row"), F.col(url).alias("url"))
    judged = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumn("rule", rule_column(rules, F.col("host"), F.col("path")))
    told = F.lit(None).cast("string")
    for rule in rules:
        told = F.when(F.col("rule") == rule.pattern, F.lit(rule.verdict)).otherwise(told)
    judged = judged.withColumn("told", told)
    model = train(judged.where(F.col("told").isNotNull()).select("url", (F.col("told") == "block").cast("int").alias("label")), sample=sample)
    scored = with_features(judged, "url", model.suffixes, model.prior).withColumn("block_margin", model.margin)
    verdict = F.coalesce("told", F.when(F.col("block_margin") > 0, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*[F.col("row")[c].alias(c) for c in df.columns if c not in new], *new)
