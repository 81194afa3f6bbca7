"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Shallow trees, each fitted to what the ones before it leave unexplained, propose rules: the
conjunction of conditions on the way to every node.  A logistic regression with an L1 penalty
weighs the rules and drops most of them, and the rest becomes one Spark expression.

Null texts have the statistics of empty ones.  Rows without a label teach nothing; an id labelled
twice teaches its larger label; with no labels, or one kind only, every score is that of a model
without rules.  Repeated rows are scored each; other columns of the table are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents teach the ensemble; they are those with the smallest hashes.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, MIN_LEAF = 30, 3, 32, 20
PENALTY = 0.002


def statistics(text: Column) -> dict[str, Column]:
    """What the rules may ask about a text, as built-in expressions over the whole of it."""
    known = F.coalesce(text, F.lit(""))
    words = F.split(F.trim(known), r"\s+", -1)
    chars = F.greatest(F.length(known), F.lit(1)).cast("double")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    left = lambda pattern: F.length(F.regexp_replace(known, pattern, ""))
    return {
        "chars": F.length(known).cast("double"),
        "word_chars": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "symbols": (F.length(known) - F.length(F.translate(known, "|#$%&*<>{}[]=~^_@/\\+", ""))) / chars,
        "marks": (F.length(known) - F.length(F.translate(known, "!?;:\"()", ""))) / chars,
        "stops": (F.length(known) - F.length(F.translate(known, ".,", ""))) / chars,
        "capitals": (chars - left(r"\p{Lu}+")) / chars,
        "digits": (F.length(known) - F.length(F.translate(known, "0123456789", ""))) / chars,
        "lines": (F.length(known) - F.length(F.translate(known, "\n", ""))) / chars,
    }


STATISTICS = tuple(
    ("chars", "word_chars", "distinct_words", "symbols", "marks", "stops", "capitals", "digits", "lines"))


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the statistic is above (or not above) the bound."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        found = True
        for name, above, bound in self.conditions:
            found &= (values[name] > bound) if above else (values[name] <= bound)
        return found


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...] = field(default=())

    def score(self, text: Column) -> Column:
        """The probability of label 1 as a Spark expression.

        The statistics are the one element of an array, so that no optimisation writes their
        expressions once for every condition.
        """

        def total(found: Column) -> Column:
            logit = F.lit(self.bias)
            for rule in self.rules:
                holds = F.lit(True)
                for name, above, bound in rule.conditions:
                    holds = holds & ((found[name] > bound) if above else (found[name] <= bound))
                logit = logit + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
            return 1 / (1 + F.exp(-logit))

        found = F.array(F.struct(*[c.alias(n) for n, c in statistics(text).items()]))
        return F.element_at(F.transform(found, total), 1)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None, rows: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents; ``learn`` says which ids of ``labels`` may be used.

    Only ids that ``docs`` has count towards the bound.  The bounded list of ids and labels is
    broadcast, so texts stay in their scan.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    usable = (usable if learn is None else usable.where(learn)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    usable = usable.join(docs.select(F.col(doc_id).alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_id")
    return docs.join(F.broadcast(chosen), docs[doc_id] == F.col("_id")).select(
        F.col("_id").alias("doc_id"), docs[text].alias("text"), F.col("_label").alias("label"))


def _grow(codes: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, rng) -> np.ndarray:
    """Split ``rows`` where the squared error of the residual falls most; collects the paths, returns fitted steps."""
    step = np.zeros(len(residual))
    step[rows] = residual[rows].mean() if len(rows) else 0.0
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return step
    best, total, n = (1e-9, None, None), residual[rows].sum(), len(rows)
    for feature in rng.permutation(codes.shape[1])[: max(2, codes.shape[1] * 2 // 3)]:
        count = np.bincount(codes[rows, feature], minlength=BINS)
        summed = np.bincount(codes[rows, feature], weights=residual[rows], minlength=BINS)
        below, weight = np.cumsum(count)[:-1], np.cumsum(summed)[:-1]
        fits = (below >= MIN_LEAF) & (n - below >= MIN_LEAF)
        gain = np.where(fits, weight**2 / np.maximum(below, 1) + (total - weight) ** 2 / np.maximum(n - below, 1) - total**2 / n, 0)
        if gain.max() > best[0]:
            best = (gain.max(), feature, int(gain.argmax()))
    _, feature, cut = best
    if feature is None:
        return step
    under = codes[rows, feature] <= cut
    for above, part in ((False, rows[under]), (True, rows[~under])):
        here = (*path, (int(feature), above, cut))
        out.append(here)
        step[part] = _grow(codes, residual, part, depth - 1, here, out, rng)[part]
    return step


def _sparse_weights(matrix: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal steps."""
    n, m = matrix.shape
    x = np.ones((n, m + 1), np.float32)
    scale = np.maximum(matrix.std(axis=0), 0.05)
    np.divide(matrix, scale, out=x[:, :-1], casting="unsafe")
    stride = 4 * n / max(np.linalg.norm((x.T @ x).astype(float), 2), 1e-9)
    w = v = np.zeros(m + 1)
    momentum = 1.0
    for _ in range(rounds):
        gradient = (x.T @ (1 / (1 + np.exp(-(x @ v.astype(np.float32)))) - y).astype(np.float32) / n).astype(float)
        new = v - stride * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - stride * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return float(w[-1]), w[:-1] / scale


def fit_rules(values: dict[str, np.ndarray], y: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    """Rules and weights from statistics and labels (0 or 1) of a bounded sample."""
    positive = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(positive / (1 - positive)))
    if len(y) < 2 * MIN_LEAF or len(set(y.tolist())) < 2:
        return RuleEnsemble(bias)
    names = list(values)
    edges = [np.unique(np.quantile(values[n], np.linspace(0, 1, BINS + 1)[1:-1])) for n in names]
    codes = np.column_stack([np.searchsorted(e, values[n], side="left") for n, e in zip(names, edges, strict=True)])
    rng, logit, paths = np.random.default_rng(7), np.full(len(y), bias), []
    for _ in range(TREES):
        rows = rng.permutation(len(y))[: max(2 * MIN_LEAF, len(y) // 2)]
        grown: list = []
        p = 1 / (1 + np.exp(-logit))
        residual = y - p
        _grow(codes, residual, rows, DEPTH, (), grown, rng)
        paths += grown
        step = np.zeros(len(y))
        leaves = [g for g in grown if not any(h[: len(g)] == g and len(h) > len(g) for h in grown)]
        for leaf in leaves:
            inside = np.ones(len(y), bool)
            for feature, above, cut in leaf:
                inside &= (codes[:, feature] > cut) == above
            step[inside] = residual[inside].sum() / max((p * (1 - p))[inside].sum(), 1e-3)
        logit = logit + 0.3 * np.clip(step, -4, 4)
    unique, columns = [], {}
    for path in paths:
        inside = np.ones(len(y), bool)
        for feature, above, cut in path:
            inside &= (codes[:, feature] > cut) == above
        if 0 < inside.sum() < len(y) and columns.setdefault(inside.tobytes(), path) is path:
            unique.append((path, inside))
    if not unique:
        return RuleEnsemble(bias)
    bias, weights = _sparse_weights(np.column_stack([i for _, i in unique]).astype(np.float32), y.astype(float), penalty)
    rules = [
        Rule(tuple((names[f], above, float(edges[f][cut])) for f, above, cut in path), float(w))
        for (path, _), w in zip(unique, weights, strict=True) if abs(w) > 1e-6]
    return RuleEnsemble(bias, tuple(rules))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None,
                  rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> RuleEnsemble:
    """Fit on the statistics, nine numbers a document, of a bounded sample."""
    sample = sample_labelled(docs, labels, label, learn, rows, doc_id, text)
    found = sample.select("doc_id", "label", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    frame = found.orderBy(F.xxhash64("doc_id"), "doc_id", "chars", "symbols").limit(rows).toPandas()
    return fit_rules({n: frame[n].to_numpy(float) for n in STATISTICS}, frame["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleEnsemble, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), model.score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
