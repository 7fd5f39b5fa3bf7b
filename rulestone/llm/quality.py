"""Quality by hierarchical empirical Bayes.

A classifier gives each document's own evidence. Its chances are summed by host and by path of a host; the host's rate of
good documents is shrunk toward the rate of all, the path's toward its host's, the more so the fewer documents a site has,
and the final chance is the document's evidence with its site's rate in the place of the overall rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, held_out, text_or_empty

#: Most labelled documents that the classifier is fitted on: those of least hash of doc_id. Sites' rates take all.
SAMPLE = 20_000
#: Chances below it are rejected.
THRESHOLD = 0.5
#: Bounds of the number of documents that a prior counts for.
WEAKEST, STRONGEST = 2.0, 10_000.0
#: A site moves a document's log odds by at most so much: sites hint, texts decide.
SITE_CLIP = 1.5
#: Tables of at most so many sites are broadcast; larger ones are joined by a shuffle.
SMALL_ROWS = 100_000


def evidence() -> dict[str, Column]:
    """What the classifier sees of a text; all by functions of the engine over the whole text."""
    text = text_or_empty()
    n = F.length(text).cast("double")

    def count(characters: str) -> Column:
        return n - F.length(F.translate(text, characters, ""))

    words, lines = F.split(text, " ", -1), F.split(text, "\n", -1)
    counts = {
        "signs": count("%*&$#"),
        "shouts": count("!"),
        "bars": count("|"),
        "capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÙÛÜ"),
        "digits": count("0123456789"),
        "stops": count(".,;:"),
    }
    found = {"length": F.log1p(n)}
    for name, c in counts.items():
        found[f"{name}_share"] = F.sqrt(c / (n + 1))
        found[f"{name}_number"] = F.log1p(c)
    found["words_again"] = 1 - F.size(F.array_distinct(words)) / F.size(words)
    found["words_again_long"] = found["words_again"] * F.log1p(F.size(words))
    found["lines_again"] = 1 - F.size(F.array_distinct(lines)) / F.size(lines)
    found["word_length"] = F.log1p(n / F.size(words))
    return found


@dataclass
class Classifier:
    """Logistic regression; weights of standardised evidence and the overall share of good documents."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def log_odds(self) -> Column:
        total = F.lit(self.bias)
        for column, mean, scale, weight in zip(evidence().values(), self.mean, self.scale, self.weights, strict=True):
            total = total + (column - mean) / scale * weight
        return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), total))


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> Classifier:
    """By Newton steps. Without labels of both kinds everything is as good as the share of good labels."""
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 1.5)
        k = rows.shape[1]
        return Classifier([0.0] * k, [1.0] * k, [0.0] * k, float(np.log(share / (1 - share))))
    mean, scale = rows.mean(0), np.maximum(rows.std(0), 1e-6)
    x = np.c_[(rows - mean) / scale, np.ones(len(rows))]
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (labels - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """labels: doc_id, quality. Rows that held_out() marks are never learnt from. What comes to the driver is the
    evidence (numbers) of at most sample rows, those of least hash of id and text, however many share an id; rows alike
    in both count once."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    picked = known.select(F.col("doc_id").cast("long").alias("_of"), F.col("quality").cast("double").alias("_quality"))
    picked = F.broadcast(checkpoint(picked.orderBy(F.xxhash64("_of"), "_of", "_quality").limit(sample)))  # sample rows at most
    found = evidence()
    key = F.xxhash64(picked["_of"], text_or_empty(), picked["_quality"]).alias("_row")
    rows = docs.join(picked, docs["doc_id"] == picked["_of"]).select(key, picked["_quality"], *[c.cast("double").alias(k) for k, c in found.items()])
    rows = rows.dropDuplicates(["_row"]).orderBy("_row").limit(sample).drop("_row")
    values = np.array([tuple(r) for r in rows.toLocalIterator()], float).reshape(-1, len(found) + 1)
    return fit(values[:, 1:], values[:, 0])


def _strength(groups: DataFrame, rate: Column, overall: Column) -> Column:
    """Documents that a prior counts for, by the moments of the groups' rates: overall variance of one document's chance
    over the variance between groups beyond chance."""
    within = F.sum(F.col("squares") - F.col("good") * rate) / F.greatest(F.sum("n") - F.count("*"), F.lit(1.0))
    between = F.sum(F.col("n") * (rate - overall) * (rate - overall)) / F.greatest(F.count("*") - 1, F.lit(1.0))
    size = (F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")) / F.greatest(F.count("*") - 1, F.lit(1.0))
    extra = (between - within) / F.greatest(size, F.lit(1.0))
    return F.when(extra <= 0, STRONGEST).otherwise(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), within / extra)))


def sites(scored: DataFrame) -> DataFrame:
    """scored: host, path, chance. Returns _host, _path, host_rate, path_rate and overall: shrunk rates by site."""
    paths = checkpoint(
        scored.groupBy("host", "path").agg(
            F.count("*").cast("double").alias("n"), F.sum("chance").alias("good"), F.sum(F.col("chance") * F.col("chance")).alias("squares")
        )
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("squares").alias("squares"))
    rate = F.col("good") / F.col("n")
    overall = (paths.agg(F.sum("good") / F.sum("n")).first() or [None])[0]
    overall = 0.5 if overall is None else float(overall)
    by_host = hosts.agg(_strength(hosts, rate, F.lit(overall))).first()[0] or STRONGEST
    by_path = paths.agg(_strength(paths, rate, F.lit(overall))).first()[0] or STRONGEST
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("good") + by_host * overall) / (F.col("n") + by_host)).alias("host_rate"))
    return (
        paths.join(hosts, F.col("host") == F.col("_host"))
        .withColumn("path_rate", (F.col("good") + by_path * F.col("host_rate")) / (F.col("n") + by_path))
        .select("_host", F.col("path").alias("_path"), "host_rate", "path_rate", F.lit(overall).alias("overall"))
    )


def _named(host: Column, path: Column, docs: DataFrame) -> DataFrame:
    return docs.withColumns({"host": F.coalesce(host.cast("string"), F.lit("")), "path": F.coalesce(path.cast("string"), F.lit(""))})


def assess(docs: DataFrame, classifier: Classifier, host: Column | None = None, path: Column | None = None, keys: list[Column] | None = None) -> DataFrame:
    """Per document: doc_id, evidence (chance by its text alone), host_rate, path_rate, quality (final chance), good (int,
    1 from the threshold on), and keys (columns of docs, none by default).

    By default documents' source is the host and their language within it the path. A null host or path is a site of its
    own; a null text is empty, and a very long one is one row of numbers like any other; repeated rows count as often as
    they stand; other columns are not looked at; an empty
    table gives an empty one. Texts are read once and not shuffled; sites are pre-aggregated and joined to numbers only;
    a host of very many documents is split by Spark's skew handling, or its table is small and broadcast.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    own = docs.select(
        *(keys or []),
        F.col("doc_id").cast("long"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        classifier.log_odds().alias("odds"),
    )
    named = own.columns[: len(keys or [])]
    scored = checkpoint(own.withColumn("chance", 1 / (1 + F.exp(-F.col("odds")))))
    rates = checkpoint(sites(scored))
    rates = F.broadcast(rates) if rates.count() <= SMALL_ROWS else rates

    def logit(p: str) -> Column:
        bounded = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(p)))
        return F.log(bounded / (1 - bounded))

    shift = F.greatest(F.lit(-SITE_CLIP), F.least(F.lit(SITE_CLIP), logit("path_rate") - logit("overall")))
    quality = 1 / (1 + F.exp(-(F.col("odds") + shift)))
    return scored.join(rates, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))).select(
        *named,
        "doc_id",
        F.col("chance").alias("evidence"),
        "host_rate",
        "path_rate",
        quality.alias("quality"),
        (quality >= THRESHOLD).cast("int").alias("good"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that reach the threshold, columns as given. Each row is judged by its own text and site, whatever its doc_id:
    rows are told apart by doc_id, text, source and language."""

    def row() -> list[Column]:
        return [F.xxhash64(text_or_empty()), F.xxhash64(F.lit(7), text_or_empty()), F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))]

    judged = assess(docs, train(docs, labels), keys=[c.alias(f"_key{i}") for i, c in enumerate(row())])
    stay = judged.filter(F.col("quality") >= threshold).select(F.col("doc_id").alias("_stay"), *[f"_key{i}" for i in range(4)]).distinct()
    same = docs["doc_id"].eqNullSafe(stay["_stay"])
    for i, c in enumerate(row()):
        same = same & (c == stay[f"_key{i}"])
    return docs.join(stay, same, "left_semi")
