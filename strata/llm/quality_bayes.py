"""Quality classification by hierarchical empirical Bayes.

A logistic classifier on text statistics, trained on a bounded sample of labelled rows, gives each document's
evidence, a probability of good quality. Evidence is summed by host and by path of a host over all documents. Each
level's rate has a Beta prior around the level above: the mean of all documents for hosts, the host's posterior for
its paths. How strongly a level is held to its prior follows from how much rates differ within it beyond what their
sizes explain (method of moments), so sparse sites shrink to what is known of larger ones. A document's score puts
its own log odds and those of its path's posterior relative to the global mean together; its own evidence is left out
of both levels, so it counts once.

A host is the part of ``site`` before its first slash; the path level is its next part together with the ``section``
column. The tables here have names without a slash as ``source``, so ``lang`` as the section is all that a path adds to
its host there. Rows are joined with their path in parts where one path has a large share of them. Defined results: a null text is an empty one; a null site or section is a site or section of its
own; without labels of both kinds all evidence is 0.5; of an id with both labels the larger counts; repeated rows are
learned from once, and count each in their site; a site of one document has its prior; an empty table gives an empty
result; texts of any length are read whole; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, hot_salted, ready, steps, utf8, written
from strata.llm.langid import labelled_sample
from strata.llm.quality_rules import CLASSES, base_stats

FEATURES = 8 + len(CLASSES)


def features(texts: list[bytes]) -> np.ndarray:
    """Text statistics, none of which grows with the length but its logarithm."""
    parts = []
    for a, b in steps(texts):
        stats, chars, words = base_stats(texts[a:b])
        n, size = np.maximum(stats.n_words.to_numpy(), 1), np.maximum(chars.sum(1), 1)
        root = 1 / np.sqrt(n)
        shares = chars / size[:, None]
        common = words[:, 1:]
        own = [np.log1p(n), stats.word_chars / n / 10, stats.n_repeat_words / n, stats.n_dup_lines / n, root, common.sum(1) / n, (common > 0).sum(1) * root, shares[:, CLASSES.index("symbol")] > 0.02]
        parts.append(np.column_stack([*(np.asarray(x, float) for x in own), shares]))
    return np.vstack(parts) if parts else np.zeros((0, FEATURES))


class Classifier:
    """Logistic regression by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        z = self.rows(x)
        self.beta, penalty = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge
        penalty[0, 0] = 0
        for _ in range(25):
            p = self.of(z)
            slope = z.T @ (weights * (y - p)) - penalty @ self.beta
            step = np.linalg.solve((z * (weights * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(slope)), slope)
            self.beta += np.clip(step, -2, 2)

    def rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.ones(len(z)), z])

    def of(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.of(self.rows(x)) if len(x) else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train_docs: int = 2000, max_train_chars: int = 20_000) -> Classifier | None:
    """A classifier from about ``max_train_docs`` labelled rows of each kind, or None without both."""
    found = labelled_sample(docs, labels, doc_id, text, label, max_train_docs, max_train_chars)
    if found is None:
        return None
    counts, rows = found[1], sorted((r["key"], r["text"].encode(), r["label"]) for r in found[0].collect())
    y = np.array([r[2] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    weights = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return Classifier(features([r[1] for r in rows]), y, weights / weights.mean())


def evidence(docs: DataFrame, model: Classifier | None, text: str = "text", into: str = "evidence") -> DataFrame:
    """``docs`` with the classifier's probability of good quality."""
    held = ready(docs.sparkSession).sparkContext.broadcast(model)

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.full(len(texts), 0.5) if held.value is None else held.value.predict(features(texts.tolist())))

    return docs.withColumn(into, F.pandas_udf(of, "double")(utf8(column(docs, text))))


def strength(groups: DataFrame, prior: str) -> float:
    """The pseudo-count of a level's prior: from the spread of its rates around their priors beyond binomial noise.

    ``groups`` has n, good and the prior mean of each group. Groups that differ no more than chance explains are held
    to the prior with the largest strength.
    """
    p, n = F.col(prior), F.col("n")
    rate = F.col("good") / n
    row = groups.agg(F.sum(n * (rate - p) * (rate - p)).alias("spread"), F.sum(p * (1 - p)).alias("noise"), F.sum(n * p * (1 - p)).alias("scale"), F.count("*").alias("k")).first()
    if not row["k"] or not row["scale"]:
        return 1e4
    between = max(0.0, row["spread"] - row["noise"]) / row["scale"]
    return float(np.clip(1 / between - 1 if between > 0 else 1e4, 1.0, 1e4))


def logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", section: str = "lang", min_score: float = 0.3, **options) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, score, kept) for each row of ``docs``."""
    model = train(docs, labels, doc_id, text, **options)
    address = column(docs, site).cast("string")
    own = docs.select(
        column(docs, doc_id).alias("doc_id"),
        column(docs, text).alias("text"),
        F.coalesce(F.substring_index(address, "/", 1), F.lit("")).alias("host"),
        F.concat_ws("/", F.coalesce(F.substring_index(address, "/", 2), F.lit("")), F.coalesce(column(docs, section).cast("string"), F.lit(""))).alias("path"),
    )
    held = written(evidence(own, model).select("doc_id", "host", "path", "evidence"), "evidence")
    mean = held.agg(F.avg("evidence")).first()[0]
    mean = 0.5 if mean is None else float(mean)
    paths = held.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    host_k = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good"), F.lit(mean).alias("prior")), "prior")
    posterior = lambda good, n, k, prior: (good + k * prior) / (n + k)
    paths = written(paths.join(hosts, "host").withColumn("prior", posterior(F.col("host_good"), F.col("host_n"), host_k, F.lit(mean))), "paths")
    path_k = strength(paths, "prior")
    # a path's name holds its host's; one may have any share of the rows
    found = hot_salted(paths.drop("host", "prior"), held, "path", "doc_id", "n", keep=True)
    host = posterior(F.col("host_good") - F.col("evidence"), F.col("host_n") - 1, host_k, F.lit(mean))
    found = found.withColumn("host_posterior", host)
    path = posterior(F.col("good") - F.col("evidence"), F.col("n") - 1, path_k, F.col("host_posterior"))
    found = found.withColumn("path_posterior", path)
    odds = logit(F.col("evidence")) + logit(F.col("path_posterior")) - F.lit(float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))))
    return found.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", (1 / (1 + F.exp(-odds))).alias("score")).withColumn("kept", F.col("score") >= min_score)
