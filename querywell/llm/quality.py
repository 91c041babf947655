"""Quality by hierarchical empirical Bayes over document, site and path.

A logistic classifier on features of the text gives each document's evidence.
Labelled documents give good and bad counts of sites and of paths within sites.
A site's rate is shrunk toward the global rate, a path's toward its site's, by
strengths estimated from the spread of the rates (method of moments), so sparse
sites stay near what is above them. The path's posterior replaces the global
prior in the document's log odds. Counts are grouped sums; the models are a few
numbers, but the posteriors stay distributed tables.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn_if, durable

#: About the most labelled documents that the classifier is fitted on.
TRAIN_DOCS = 20_000
NAMES = ("bias", "log_words", "word_length", "upper", "marks", "bars", "digits", "stutter", "variety", "line_words", "letters")
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"#$%&*!?=<>{}[]^~_\\/")] = True
_PIECE = 1 << 20


def features(text: str | None) -> list[float]:
    """Numbers of a whole text, most of them shares between 0 and 1."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    words = (text or "").split()
    n, size = max(1, len(words)), max(1, len(raw))
    upper = marks = bars = digits = letters = 0
    for at in range(0, len(raw), _PIECE):
        b = raw[at : at + _PIECE]
        lower = b | 32
        letters += int(((lower >= 97) & (lower <= 122) | (b >= 128)).sum())
        upper += int(((b >= 65) & (b <= 90)).sum())
        marks += int(_MARKS[b].sum())
        bars += int((b == 124).sum())
        digits += int(((b >= 48) & (b <= 57)).sum())
    stutter = sum(map(str.__eq__, words, words[1:]))
    lines = 1 + (text or "").count("\n")
    return [1.0, np.log1p(len(words)) / 10, min(2.0, size / n / 10), upper / size, min(1.0, marks / n), min(1.0, bars / n), digits / size, stutter / n, len(set(words)) / n, min(2.0, n / lines / 50), letters / size]


def fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method; y is the good share of n labels."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
    return w


def _strength(rates: DataFrame, above: str) -> float:
    """How many labels a group's parent is worth: from the spread of the rates beyond chance, between 1 and 1000."""
    m, n, good = F.col(above), F.col("n"), F.col("good")
    chance, spread = n * m * (1 - m), (good - n * m) ** 2 - n * m * (1 - m)
    row = rates.agg(F.sum(chance).alias("c"), F.sum(spread).alias("s"), F.sum(n * (n - 1) * m * (1 - m)).alias("v")).first()
    if not row["c"] or not row["v"]:
        return 1000.0
    rho = row["s"] / row["v"]  # correlation of labels within a group
    return float(min(1000.0, max(1.0, (1 - rho) / rho))) if rho > 0 else 1000.0


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def quality(docs: DataFrame, labels: DataFrame, site: Column | None = None, path: Column | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """docs (doc_id, text, source, lang) and labels (doc_id, quality 0/1) -> one row per row of docs.

    Returns doc_id, p_doc (classifier alone), p_site, p_path (posterior rates),
    score (all combined), keep (score >= 0.5) and trained. ``site`` and ``path`` are
    columns of docs, by default source and, within it, lang (documents have no
    address). A labelled document's own labels count neither in its site's nor in
    its path's posterior nor in the prior it is given; ``trained`` tells whether the
    classifier was fitted on it. Null sites or paths are groups of their own. Labels
    that are null or belong to no document are ignored; a document with several
    labels counts each in its groups. Without any label every score is 0.5 and kept. Null texts
    count as empty. Other columns are ignored; an empty table gives no rows.
    """
    site = F.col("source") if site is None else site
    path = F.col("lang") if path is None else path

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    own = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("label_id")).agg(F.sum(F.col("quality").cast("long")).alias("own_good"), F.count(F.lit(1)).alias("own_n"))
    rows = docs.select("doc_id", site.cast("string").alias("site"), path.cast("string").alias("path"), measured("text").alias("x"))
    rows = durable(rows.join(own, rows["doc_id"] == own["label_id"], "left").select("doc_id", "site", "path", "x", F.coalesce("own_good", F.lit(0)).alias("own_good"), F.coalesce("own_n", F.lit(0)).alias("own_n")))
    labelled = rows.where("own_n > 0")
    counts = durable(labelled.groupBy("site", "path").agg(F.sum("own_good").alias("good"), F.sum("own_n").alias("n")))
    total = counts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    if not total["n"]:
        half = [F.lit(0.5).alias(c) for c in ("p_doc", "p_site", "p_path", "score")]
        return rows.select("doc_id", *half, F.lit(True).alias("keep"), F.lit(False).alias("trained"))
    chosen = drawn_if(labelled, train_docs, "doc_id")
    sample = labelled.where(chosen).select("x", (F.col("own_good") / F.col("own_n")).alias("y"), "own_n").collect()
    weights = fitted(np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample], dtype=float), np.array([r["own_n"] for r in sample], dtype=float))

    prior = (total["good"] + 1) / (total["n"] + 2)
    sites = counts.groupBy("site").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    k = _strength(sites.withColumn("above", F.lit(prior)), "above")
    sites = durable(sites.select(F.col("site").alias("s"), F.col("good").alias("site_good"), F.col("n").alias("site_n")))
    rated = counts.join(sites, F.col("site").eqNullSafe(F.col("s"))).withColumn("above", (F.col("site_good") + k * prior) / (F.col("site_n") + k))
    j = _strength(rated, "above")
    paths = counts.select(F.col("site").alias("ps"), F.col("path").alias("pp"), F.col("good").alias("path_good"), F.col("n").alias("path_n"))

    logit = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = rows.select("doc_id", "site", "path", "own_good", "own_n", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit)).alias("logit"), (chosen & (F.col("own_n") > 0)).alias("trained"))
    out = out.join(sites, F.col("site").eqNullSafe(F.col("s")), "left").join(paths, F.col("site").eqNullSafe(F.col("ps")) & F.col("path").eqNullSafe(F.col("pp")), "left")
    # A path without labels but one's own has its site's rate, a site without any the prior.
    others = lambda c, mine: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.when(F.col(c).isNotNull(), F.col(mine)), F.lit(0))
    out = out.withColumn("prior", (F.lit(total["good"]) - F.col("own_good") + 1) / (F.lit(total["n"]) - F.col("own_n") + 2))
    out = out.withColumn("p_site", (others("site_good", "own_good") + k * F.col("prior")) / (others("site_n", "own_n") + k))
    out = out.withColumn("p_path", (others("path_good", "own_good") + j * F.col("p_site")) / (others("path_n", "own_n") + j))
    score = 1 / (1 + F.exp(-(F.col("logit") + _logit(F.col("p_path")) - _logit(F.col("prior")))))
    out = out.select("doc_id", (1 / (1 + F.exp(-F.col("logit")))).alias("p_doc"), "p_site", "p_path", score.alias("score"), "trained")
    return out.select("doc_id", "p_doc", "p_site", "p_path", "score", (F.col("score") >= 0.5).alias("keep"), "trained")
