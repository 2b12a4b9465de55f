"""Quality scores from a sparse rule ensemble.

Shallow trees on resampled rows give conjunctions of thresholds over text statistics (every path
from the root), a lasso logistic regression weighs them, and the rules that keep a
weight become one column expression. Only the bounded labelled sample is fitted on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.statistics import features, labelled, measures

ROWS = 10_000  # most labelled texts to fit on
TREES = 24
DEPTH = 3
LEAST_ROWS = 8
PENALTY = 0.002
CUT = 0.3

Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold): x > t if above, else x <= t


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def best_cut(x: np.ndarray, y: np.ndarray, columns: np.ndarray, least: int):
    """(feature, threshold) of the largest fall in squared error, or None."""
    best, found = 1e-9, None
    for f in columns:
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(v))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least)
        if not ok.any():
            continue
        gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(v) - n) - s[-1] ** 2 / len(v)
        i = int(np.argmax(np.where(ok, gain, -1)))
        if gain[i] > best:
            best, found = gain[i], (int(f), float((v[i] + v[i + 1]) / 2))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray, rng, depth: int = DEPTH, least: int = LEAST_ROWS) -> list[Rule]:
    """Every path of a tree, inner ones included."""
    out: list[Rule] = []

    def grow(rows, path):
        if path:
            out.append(path)
        if len(path) == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return
        columns = rng.permutation(x.shape[1])[: max(1, 2 * x.shape[1] // 3)]
        cut = best_cut(x[rows], y[rows], columns, least)
        if cut:
            above = x[rows, cut[0]] > cut[1]
            for side in (False, True):
                grow(rows[above == side], (*path, (cut[0], side, cut[1])))

    grow(np.arange(len(y)), ())
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600):
    """Weights and bias by accelerated proximal steps; the bias is not penalised."""
    n = len(y)
    wide = np.column_stack([a, np.ones(n)])
    rate = 4 * n / (np.linalg.norm(wide, 2) ** 2 + 1e-12)
    w = look = np.zeros(wide.shape[1])
    speed = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(wide @ look, -30, 30)))
        new = look - rate * (wide.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        look = new + (speed - 1) / faster * (new - w)
        w, speed = new, faster
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x)))

    def column(self, named: dict[str, Column]) -> Column:
        """The probability as a Spark expression over the statistics."""
        values = list(named.values())
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            tests = [values[f] > t if above else values[f] <= t for f, above, t in rule]
            whole = tests[0]
            for test in tests[1:]:
                whole = whole & test
            total = total + F.when(whole, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, penalty: float = PENALTY, seed: int = 3) -> Ensemble:
    """Without rows the score is one half; with one label alone it is near that label."""
    if not len(y):
        return Ensemble((), 0.0)
    if y.min() == y.max():
        return Ensemble((), 4.0 if y[0] else -4.0)
    rng = np.random.default_rng(seed)
    rules: dict[Rule, np.ndarray] = {}
    seen = set()
    for _ in range(trees):
        rows = rng.choice(len(y), max(2, 7 * len(y) // 10), replace=False)
        for rule in tree_rules(x[rows], y[rows], rng):
            hit = holds(rule, x)
            if 0 < hit.sum() < len(y) and hit.tobytes() not in seen:
                seen.update((hit.tobytes(), (~hit).tobytes()))
                rules[rule] = hit
    if not rules:
        return Ensemble((), float(np.log(y.mean() / (1 - y.mean()))))
    weights, bias = lasso_logistic(np.column_stack(list(rules.values())).astype(float), y, penalty)
    return Ensemble(tuple((r, float(w)) for r, w in zip(rules, weights) if w), bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, where: Column | None = None) -> Ensemble:
    found = labelled(docs, labels, label, rows, where)
    return train(np.array([x for x, _ in found], float), np.array([y for _, y in found], float))


def score(docs: DataFrame, model: Ensemble, divisor: int = 5, held: int = 0, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null texts are empty; a null doc_id is not held out; repeated rows are scored each for
    itself; other columns are ignored; an empty table gives no rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == held
    scored = measures(docs, "doc_id").select("doc_id", model.column(features()).alias("score"))
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
