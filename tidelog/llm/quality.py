"""Quality classifier: a sparse ensemble of rules, compiled to column expressions.

Statistics of a text are column expressions of built-in functions.  Boosted
regression trees over these statistics of labelled rows give the rules: each
path from a root to a node is a conjunction of comparisons.  A logistic
regression with an L1 penalty weighs the rules, most of which get weight zero,
and the rest is compiled into one column expression.  Scoring therefore runs
inside the JVM, reads each text once and shuffles nothing.

Learned from a bounded sample of the labelled rows, ``MAX_LABELLED`` of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows to learn from, at most; those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
TREES, DEPTH, LEAF, BINS, RATE = 60, 3, 20, 32, 0.2
#: Rules of the ensemble, at most: the penalty is the smallest of these that leaves no more.
MAX_RULES = 48
PENALTIES = (1e-3, 2e-3, 4e-3, 8e-3, 1.6e-2, 3.2e-2)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; all are finite for every text, the empty one included."""
    n = F.greatest(F.length(text), F.lit(1))
    words = F.split(F.btrim(text, F.lit(common.SPACE)), "[ \\n\\t\\r\\x0b\\f]+")
    lines = F.split(text, "\n", -1)
    n_words = F.greatest(F.size(words), F.lit(1))
    share = lambda chars: _count(text, chars) / n
    found = {
        "chars": F.length(text).cast("double"),
        "words": n_words.cast("double"),
        "word_length": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "lines_per_word": F.size(lines) / n_words,
        "upper": share(common.UPPER),
        "digits": share("0123456789"),
        "stops": share(".?"),
        "commas": share(",;"),
        "exclamations": share("!"),
        "symbols": share("#*$%&<>{}[]=+~^_\\"),
        "bars": share("|"),
        "quotes": share("\"'()"),
        "links": share("/@:"),
        "hyphens": share("-"),
    }
    return {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in found.items()}



@dataclass(frozen=True)
class Rule:
    """All comparisons hold: ``(statistic, above, threshold)``, where above means greater than."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.tests:
            out = out & (F.col(name) > t if above else F.col(name) <= t)
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, t in self.tests:
            v = x[:, names.index(name)]
            out &= v > t if above else v <= t
        return out

    def simple(self) -> Rule:
        """Without comparisons that another one implies."""
        best: dict[tuple[str, bool], float] = {}
        for name, above, t in self.tests:
            old = best.get((name, above))
            best[name, above] = t if old is None else max(old, t) if above else min(old, t)
        return Rule(tuple(sorted((n, a, t) for (n, a), t in best.items())))


def _trees(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """Paths of boosted trees for the logistic loss over binned statistics."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin b: cuts[b-1] < value <= cuts[b]
    rules: dict[Rule, None] = {}
    margin = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        part = (np.arange(len(y)) * 2654435761 + tree * 40503) % 4 != 0  # three in four rows, other ones each time
        nodes = [(np.flatnonzero(part), np.arange(len(y)), ())]
        for _ in range(DEPTH):
            after = []
            for rows, all_rows, tests in nodes:
                g, h, best = grad[rows].sum(), hess[rows].sum(), (1e-6, None)
                for j in range(x.shape[1]):
                    b = binned[rows, j]
                    m = len(cuts[j]) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (grad[rows], hess[rows], None))
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), (j, int(gain.argmax())))
                if best[1] is None:
                    margin[all_rows] += RATE * g / (h + 1)
                    continue
                j, k = best[1]
                for above in (False, True):
                    path = (*tests, (names[j], above, float(cuts[j][k])))
                    rules[Rule(path).simple()] = None
                    after.append((rows[(binned[rows, j] > k) == above], all_rows[(binned[all_rows, j] > k) == above], path))
            nodes = after
        for rows, all_rows, _ in nodes:
            margin[all_rows] += RATE * grad[rows].sum() / (hess[rows].sum() + 1)
    return list(rules)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient steps; columns are 0 or 1, the constant is free."""
    n = len(y)
    z = np.concatenate([z.astype(np.float32), np.ones((n, 1), np.float32)], 1)
    y = y.astype(np.float32)
    v = np.random.default_rng(0).normal(size=z.shape[1]).astype(np.float32)
    for _ in range(30):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(z @ v) ** 2 / n * 1.05)
    w = np.zeros(z.shape[1], np.float32)
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    at, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
        new = (at - np.float32(rate / n) * (z.T @ (p - y))).astype(np.float32)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at, w, last = new + np.float32((old - 1) / t) * (new - w), new, w
        if np.abs(w - last).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


class RuleEnsemble:
    """Rules with weights, and a constant."""

    def __init__(self, rules: list[tuple[Rule, float]], constant: float):
        self.rules, self.constant = rules, constant

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, names: list[str], max_rules: int = MAX_RULES) -> RuleEnsemble:
        """With fewer than ten rows of a class, the ensemble is a constant."""
        if min(y.sum(), len(y) - y.sum()) < 10:
            return cls([], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
        rules = _trees(x, y, names)
        z = np.stack([r.holds(x, names) for r in rules], 1)
        for penalty in (*PENALTIES, *(PENALTIES[-1] * 2.0**k for k in range(1, 30))):  # the penalty grows until the weights leave few rules
            w, constant = _lasso(z, y, penalty)
            kept = np.flatnonzero(np.abs(w) > 1e-6)
            if len(kept) <= max_rules:
                break
        return cls([(rules[k], float(w[k])) for k in kept.tolist()], constant)

    def margin(self) -> Column:
        out = F.lit(self.constant)
        for rule, weight in self.rules:
            out = out + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return out

    def score(self) -> Column:
        """A probability, of the statistics' columns."""
        return 1.0 / (1.0 + F.exp(-self.margin()))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        m = self.constant + sum((w * r.holds(x, names) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-m))


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, text's statistics...)``."""
    return common.texts(docs).select("doc_id", *[c.alias(k) for k, c in statistics(F.col("text")).items()])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> RuleEnsemble:
    """Learns from the labelled rows given, at most ``max_labelled`` of them, of which a few numbers each reach the driver.

    Null labels don't count; a row with several labels has the largest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = common.texts(docs).join(F.broadcast(sample), "doc_id")  # a bounded number of short rows
    names = list(statistics(F.lit("")))
    pdf = chosen.select("doc_id", "label", *[c.alias(k) for k, c in statistics(F.col("text")).items()]).toPandas().sort_values(["doc_id", *names])
    return RuleEnsemble.fit(pdf[names].to_numpy(float), (pdf["label"].to_numpy() > 0).astype(float), names)


def held_out(modulus: int = 5, remainder: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``(doc_id, score)`` of every row; null texts count as empty."""
    return measured(docs).select("doc_id", model.score().alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; learns from the labels that aren't held out."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
