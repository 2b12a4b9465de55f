"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts, whatever their label, are the unlabelled
mixture. The negative risk is the mixture's risk less the class prior times the positives' risk,
and never counts below zero. Several linear classifiers over word presence are trained with it in
numpy on bounded samples; scoring needs only their weighted words and runs inside tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.shared import stage_table

POSITIVES = 2000  # most confirmed toxic texts to train on, by hash of their id
UNLABELLED = 6000  # most unlabelled texts, likewise
VOCABULARY = 2048
LEAST_POSITIVES = 3  # texts that a word must occur in
DOUBT = 4.0  # a word lifted by x standard errors counts x^2 / (x^2 + DOUBT): chance words weigh little, rare evidence stays
CLASSIFIERS = 3
CUT = 0.3
TOKEN = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


@dataclass(frozen=True)
class Model:
    weights: tuple[dict[str, float], ...]
    biases: tuple[float, ...]

    def score(self, text: str | None) -> float:
        """Mean probability of the classifiers."""
        if not self.weights:
            return 0.0
        found = words(text)
        margins = [b + sum(w[x] for x in w.keys() & found) for w, b in zip(self.weights, self.biases)]
        return float(np.mean([1 / (1 + np.exp(-np.clip(m, -30, 30))) for m in margins]))


def fit_classifier(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, epochs: int = 60, batch: int = 512, decay: float = 3e-4, rate: float = 0.02):
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam on batches."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(positive.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    step, rounds = 0, max(1, len(unlabelled) // batch)
    for _ in range(epochs):
        for mixed in np.array_split(rng.permutation(len(unlabelled)), rounds):
            p, u = positive[rng.integers(0, len(positive), min(batch, len(positive)))], unlabelled[mixed]
            zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
            extend = lambda x, g: np.append(g @ x, g.sum()) / len(g)
            as_positive = prior * extend(p, sigmoid(zp) - 1)
            as_negative = extend(u, sigmoid(zu)) - prior * extend(p, sigmoid(zp))
            risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gradient = as_positive + as_negative if risk >= 0 else -as_negative  # climb out of a negative risk
            gradient[:-1] += decay * theta[:-1]
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def chosen_words(sample: DataFrame, n: int, m: int, most: int = VOCABULARY) -> dict[str, float]:
    """Words whose share among the n positives exceeds that among the m unlabelled texts most clearly, each with its trust.

    Trust grows from 0 to 1 with the lift in standard errors. It is the value of the word's feature, so a word
    that may be lifted by chance needs a larger weight, which decay holds back, to count as much.
    """
    one = F.explode("words").alias("word")
    counts = sample.select(one, "positive").groupBy("word").agg(
        F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b")
    )
    pooled = (F.col("a") + F.col("b")) / (n + m)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m) + F.lit(1e-12))
    lifted = counts.select("word", "a", ((F.col("a") / n - F.col("b") / m) / error).alias("lift"))
    clear = lifted.where((F.col("a") >= min(LEAST_POSITIVES, n)) & (F.col("lift") > 0))
    best = clear.orderBy(F.desc("lift"), "word").limit(most).collect()
    return {r["word"]: r["lift"] ** 2 / (r["lift"] ** 2 + DOUBT) for r in best}


def train(positive: list, unlabelled: list, chosen: dict[str, float], prior: float, classifiers: int = CLASSIFIERS) -> Model:
    """Fits on the chosen words of every text; without positives or a prior there is no classifier."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model((), ())
    place = {w: i for i, w in enumerate(chosen)}

    def matrix(texts):
        out = np.zeros((len(texts), len(chosen)), np.float32)
        trust = np.array(list(chosen.values()), np.float32)
        for i, found in enumerate(texts):
            at = [place[w] for w in found]
            out[i, at] = trust[at]
        return out

    p, u = matrix(positive), matrix(unlabelled)
    fits = [fit_classifier(p, u, prior, seed) for seed in range(classifiers)]
    return Model(tuple({w: float(x) * t for (w, t), x in zip(chosen.items(), theta) if x} for theta, _ in fits), tuple(b for _, b in fits))


def _word_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, words) of the texts with these ids (a bounded list); of repeated ids the first set in order."""

    def run(batches):
        for batch in batches:
            found = [sorted(words(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "words"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = slim.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, words array<string>")
    return found.groupBy("doc_id").agg(F.min("words").alias("words"))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, divisor: int = 4, held: int = 2) -> Model:
    """Learns from rows whose id is not held out; the prior is their share of toxic labels.

    The samples are the first ids by hash, so that reruns and other partitions agree;
    their sizes are the two bounds and do not depend on the table's size.
    """
    learn = F.col("doc_id").isNotNull() & (remainder("doc_id", divisor) != held)
    order = [F.xxhash64(F.col("doc_id").cast("long")), F.col("doc_id")]
    known = labels.where(learn & F.col("toxic").isNotNull())
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    toxic = known.where("toxic = 1").select(F.col("doc_id").cast("long")).distinct().orderBy(*order).limit(positives)
    mixed = docs.where(learn).select(F.col("doc_id").cast("long")).distinct().orderBy(*order).limit(unlabelled)
    sample = _word_sets(docs, toxic).withColumn("positive", F.lit(True))
    sample = stage_table(sample.unionByName(_word_sets(docs, mixed).withColumn("positive", F.lit(False))))
    size = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model((), ())
    chosen = chosen_words(sample, size[True], size[False])
    known = F.array(*[F.lit(w) for w in chosen]).cast("array<string>")
    # Only chosen words reach the driver: at most VOCABULARY for each text of the bounded sample.
    rows = sample.select("doc_id", "positive", F.array_intersect("words", known).alias("found")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    sides = [[r["found"] for r in rows if r["positive"] == side] for side in (True, False)]
    return train(*sides, chosen, float(prior))


def score(docs: DataFrame, model: Model, divisor: int = 4, held: int = 2, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null or empty text is scored as one without words; a null doc_id is not held out;
    repeated rows are scored each for itself; other columns are ignored; an empty table gives
    no rows; without positives to learn from every score is 0.
    """

    def run(batches):
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(remainder("doc_id", divisor) == held, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows whose score is below the cut, with all their columns."""
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for batch in batches:
            keep = [model.score(t.as_py()) < cut for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
