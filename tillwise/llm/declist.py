"""Quality rules as a learned decision list.

Sequential covering: a conjunction of thresholds on text statistics is grown on two thirds of
the labelled rows still uncovered, pruned on the other third, and appended; the rows it covers leave.
The list becomes ordered conditional expressions. Only a bounded labelled sample is fitted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.statistics import features, labelled, measures

ROWS = 10_000  # most labelled texts to fit on
LEAST_WORDS = 50
MOST_CONDITIONS = 3
MOST_RULES = 12
LEAST_PRECISION = 0.8  # of a rule that rejects, on the rows kept for pruning
CUTS = 24  # thresholds tried for each statistic

Condition = tuple[int, bool, float]


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def grow(x: np.ndarray, bad: np.ndarray, most: int = MOST_CONDITIONS) -> tuple[Condition, ...]:
    """Adds the condition of the largest information gain over covered bad rows until no good row is covered."""
    rule: tuple[Condition, ...] = ()
    covered = np.ones(len(x), bool)
    while len(rule) < most and bad[covered].any() and not bad[covered].all():
        share = np.log2(bad[covered].mean())
        best, found = 1e-9, None
        for f in range(x.shape[1]):
            for t in np.unique(np.quantile(x[covered, f], np.linspace(0, 1, CUTS))):
                for above in (False, True):
                    hit = covered & ((x[:, f] > t) == above)
                    n = bad[hit].sum()
                    gain = n * (np.log2(n / hit.sum()) - share) if n else 0
                    if gain > best:
                        best, found = gain, (f, above, float(t))
        if found is None:
            break
        rule = (*rule, found)
        covered = holds(rule, x)
    return rule


def worth(rule: tuple[Condition, ...], x: np.ndarray, bad: np.ndarray) -> float:
    hit = holds(rule, x)
    return (bad[hit].sum() - (~bad[hit]).sum()) / hit.sum() if hit.any() else -1.0


def prune(rule: tuple[Condition, ...], x: np.ndarray, bad: np.ndarray) -> tuple[Condition, ...]:
    """The leading conditions that do best on rows the rule was not grown on."""
    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (worth(r, x, bad), -len(r)))


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in order; what none of them covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejects(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= holds(rule, x)
        return out

    def columns(self, named: dict[str, Column]) -> tuple[Column, Column]:
        """(kept, number of the rule that decided, null if none) as ordered conditions."""
        values = list(named.values())
        kept, rule_number = None, None
        for k, rule in enumerate(self.rules):
            whole = F.lit(True)
            for f, above, t in rule:
                whole = whole & (values[f] > t if above else values[f] <= t)
            kept = F.when(whole, F.lit(False)) if kept is None else kept.when(whole, F.lit(False))
            rule_number = F.when(whole, F.lit(k)) if rule_number is None else rule_number.when(whole, F.lit(k))
        if kept is None:
            return F.lit(True), F.lit(None).cast("int")
        return kept.otherwise(F.lit(True)), rule_number


def train(x: np.ndarray, bad: np.ndarray, seed: int = 5) -> DecisionList:
    rng = np.random.default_rng(seed)
    left = np.arange(len(bad))
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MOST_RULES and len(left) >= 12 and bad[left].any():
        mixed = rng.permutation(left)
        growing, pruning = mixed[: 2 * len(left) // 3], mixed[2 * len(left) // 3 :]
        rule = grow(x[growing], bad[growing])
        if not rule:
            break
        rule = prune(rule, x[pruning], bad[pruning])
        hit = holds(rule, x[pruning])
        if not hit.any() or bad[pruning][hit].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left = left[~holds(rule, x[left])]
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> DecisionList:
    found = labelled(docs, labels, label, rows)
    return train(np.array([x for x, _ in found], float).reshape(len(found), -1), np.array([y == 0 for _, y in found], bool))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the deciding rule of every row.

    A null text has no words and fails the base rules; repeated rows are judged each for
    itself; other columns are ignored; an empty table gives no rows.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept, rule = rules.columns(features())
    out = measures(docs, "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("_kept"), rule.alias("rule")
    )
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_kept")).drop("_kept")
