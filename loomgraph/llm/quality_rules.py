"""Text quality by a sparse rule ensemble.

Small trees are grown over text statistics on a bounded sample of labelled rows; every path from a
root is a conjunctive rule; a lasso logistic fit keeps few of them; the kept rules are compiled into
one Spark column expression, so all texts are scored without leaving the JVM.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows the rules are fitted on, at most (chosen by a hash of the identifier).
SAMPLE_ROWS = 20_000


class Rule(NamedTuple):
    """A conjunction of (statistic, is above, threshold), and its weight."""
    parts: tuple[tuple[str, bool, float], ...]
    weight: float


class RuleModel(NamedTuple):
    rules: tuple[Rule, ...]
    bias: float


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a whole text; all are defined for null and empty texts."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    words, lines = F.split(F.trim(text), r"\s+"), F.split(text, "\n")
    n_words, n_lines = F.size(words), F.size(lines)

    def without(*marks: str) -> Column:
        left = text
        for mark in marks:
            left = F.replace(left, F.lit(mark), F.lit(""))
        return (size - F.length(left)) / (size + 1)

    return {
        "log_chars": F.log1p(size.cast("double")),
        "word_length": size / (n_words + 1),
        "distinct_words": F.size(F.array_distinct(words)) / (n_words + 1),
        "distinct_lines": F.size(F.array_distinct(lines)) / (n_lines + 1),
        "line_length": F.log1p(size / n_lines),
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / (size + 1),
        "digits": F.regexp_count(text, F.lit(r"[0-9]")) / (size + 1),
        "marks": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / (size + 1),
        "shouts": without("!"),
        "bars": without("|"),
        "stops": without(".", ","),
        "symbols": without("#", "$", "%", "&", "*"),
        "braces": without("{", "}", "<", ">", "=", ";"),
    }


def with_statistics(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.struct(*[c.cast("double").alias(n) for n, c in
                                       statistics(F.col("text")).items()]).alias("stats"))


def _paths(x, y, weight, names, rng, depth):
    """Grow one tree on the gradient ``y`` and return its paths with the rows they hold."""
    found = []

    def split(rows, parts, left):
        if left == 0 or len(rows) < 20:
            return
        best = None
        for j in rng.choice(len(names), max(2, len(names) // 2), replace=False):
            values = x[rows, j]
            for cut in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 13))):
                above = values > cut
                n = weight[rows][above].sum(), weight[rows][~above].sum()
                if min(n) <= 0:
                    continue
                s = (weight[rows] * y[rows])[above].sum(), (weight[rows] * y[rows])[~above].sum()
                gain = s[0] ** 2 / n[0] + s[1] ** 2 / n[1]
                if best is None or gain > best[0] + 1e-12:
                    best = gain, j, float(cut), above
        if best is None:
            return
        for side in (True, False):
            inner = parts + ((names[best[1]], side, best[2]),)
            held = rows[best[3] == side]
            found.append(inner)
            split(held, inner, left - 1)

    split(np.arange(len(y)), (), depth)
    return found


def _holds(parts, columns):
    out = np.ones(len(next(iter(columns.values()))), bool)
    for name, above, cut in parts:
        out &= (columns[name] > cut) == above
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3,
        penalty: float = 0.002, steps: int = 600, seed: int = 7) -> RuleModel:
    """Rules and lasso logistic weights for (rows x statistics, 0/1 labels); classes weigh alike.

    With no rows, or one class only, there are no rules and the bias is the smoothed share of 1.
    """
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel((), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    columns = dict(zip(names, x.T))
    paths, margin = [], np.zeros(len(y))
    for _ in range(trees):
        pick = rng.random(len(y)) < 0.5
        residual = y - 1 / (1 + np.exp(-margin))
        grown = _paths(x[pick], residual[pick], weight[pick], names, rng, depth)
        for parts in (p for p in grown if not any(p == q[:-1] for q in grown)):
            held = _holds(parts, columns)
            total = weight[held].sum()
            if total > 0:
                margin += 0.3 * held * np.clip(4 * (weight[held] * residual[held]).sum() / total, -4, 4)
        paths += grown
    paths = sorted(set(paths))
    z = np.stack([_holds(p, columns) for p in paths], 1).astype(np.float64)
    scale = np.maximum(np.sqrt((weight[:, None] * (z - weight @ z) ** 2).sum(0)), 1e-3)
    z /= scale
    # proximal gradient with momentum; the bias is not penalised
    coef, bias, ahead, ahead_bias, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    rate = 4 / max(1e-9, float(np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1]) + 1)
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-(z @ ahead + ahead_bias))) - y)
        moved = ahead - rate * (z.T @ error)
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        new_bias = ahead_bias - rate * error.sum()
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / grown * (new - coef)
        ahead_bias = new_bias + (t - 1) / grown * (new_bias - bias)
        coef, bias, t = new, new_bias, grown
    keep = np.flatnonzero(coef)
    return RuleModel(tuple(Rule(paths[i], float(coef[i] / scale[i])) for i in keep), float(bias))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS, **options) -> RuleModel:
    """Fit on at most ``max_rows`` of the (doc_id, quality) labels; others than 0 and 1 are ignored."""
    chosen = (labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows))
    rows = (with_statistics(docs.select("doc_id", "text").join(chosen, "doc_id"))
            .select("doc_id", "quality", "stats.*").orderBy("doc_id", "quality", "log_chars").limit(max_rows)
            .toPandas())
    names = list(rows.columns[2:])
    return fit(rows[names].to_numpy(float), rows["quality"].to_numpy(float), names, **options)


def compiled(model: RuleModel, stats: str = "stats") -> Column:
    """The model's probability as a column expression over the statistics."""
    total = F.lit(model.bias)
    for rule in model.rules:
        holds = F.lit(True)
        for name, above, cut in rule.parts:
            value = F.col(f"{stats}.{name}")
            holds = holds & (value > cut if above else value <= cut)
        total = total + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is likelier good) and ``predicted`` (0 or 1).

    Null counts as empty, and empty texts are scored too.  Columns of the added names are replaced,
    others pass through; repeated rows get equal scores; no rows give no rows.
    """
    rows = with_statistics(docs.drop("score", "predicted", "stats")).withColumn("score", compiled(model))
    return rows.drop("stats").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
