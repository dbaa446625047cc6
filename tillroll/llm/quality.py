"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics of the whole text are Spark expressions. A small random forest on
labelled rows proposes rules: each path from a root to a node is a conjunction
of threshold tests on statistics. A lasso logistic regression over the rules'
truth values keeps few of them. The kept rules compile to one Spark column, so
scoring is a projection over the scan: no shuffle and no Python.

Bounds: at most about ``max_train`` labelled texts, chosen by a hash of the id,
train the forest and the weights; only their statistics are kept.

Edge cases. Null and empty texts have all statistics 0 and get the score the
rules give those. Labels of one kind only: the constant 0 or 1 of that kind; no
labels: 0.5. Several label rows for an id: the largest. Repeated documents: each
row has its score. Very long texts are read whole. Empty tables: no rows, or the
constant 0.5. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut
from tillroll.llm.toxicity import training_sample

#: Fixed character sets of the statistics.
CHARACTER_SETS = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÁÍÓÚ",
    "digit": "0123456789",
    "symbol": "#$%&*|@^~<>{}[]()=+_\\/`",
    "mark": ".,;:!?",
    "shout": "!",
}
STATISTICS = ("chars", "words", "word_length", "distinct_words", "lines", "distinct_lines", *CHARACTER_SETS)


def statistics(text) -> dict[str, Column]:
    """Named statistics of a text column, all doubles and never null."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n = F.length(t)
    words, lines = F.split(t, "[ \n]+"), F.split(t, "\n")
    out = {
        "chars": F.log1p(n.cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": n / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "lines": F.size(lines) / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }
    for name, chars in CHARACTER_SETS.items():
        out[name] = (n - F.length(F.translate(t, chars, ""))) / F.greatest(n, F.lit(1))
    return out


@dataclass(frozen=True)
class Rule:
    """Conjunction of tests (statistic, is_greater, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s) > t if greater else F.col(s) <= t for s, greater, t in self.tests])

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>' if g else '<='} {t:.6g}" for s, g, t in self.tests)


@dataclass
class RuleModel:
    """Weighted rules and a bias; without rules the score is the constant."""

    rules: list[tuple[Rule, float]]
    bias: float
    constant: float | None = None

    def score_column(self) -> Column:
        """Score from the statistics' columns."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(tree) -> set[Rule]:
    """All root-to-node paths of a fitted Spark decision tree, one test per statistic and side."""
    found: set[Rule] = set()

    def walk(node, tests: dict) -> None:
        if tests:
            found.add(Rule(tuple((s, g, t) for (s, g), t in sorted(tests.items()))))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, at = STATISTICS[split.featureIndex()], float(split.threshold())
        left, right = (name, False), (name, True)
        walk(node.leftChild(), tests | {left: min(at, tests.get(left, math.inf))})
        walk(node.rightChild(), tests | {right: max(at, tests.get(right, -math.inf))})

    walk(tree._call_java("rootNode"), {})
    return found


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 10_000, trees: int = 10, depth: int = 3,
          lasso: float = 0.002, seed: int = 7) -> RuleModel:
    """Rules and weights from the labelled documents outside the held-out fold."""
    sample = training_sample(docs, labels, label, max_train)
    stats = statistics("text")
    rows = cut(sample.select(F.col("y").cast("double").alias("label"), *[c.alias(k) for k, c in stats.items()]).repartition(8))
    kinds = [r.label for r in rows.select("label").distinct().limit(3).collect()]
    if len(kinds) != 2:
        return RuleModel([], 0.0, kinds[0] if kinds else 0.5)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.6", seed=seed)
    fitted = forest.fit(rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("x")))
    rules = sorted(set().union(*(tree_rules(t) for t in fitted.trees)), key=str)
    truth = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("x"))
    lr = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(truth)
    kept = [(r, w) for r, w in zip(rules, lr.coefficients.toArray().tolist()) if w]
    return RuleModel(kept, lr.intercept)


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in statistics("text").items()])
    return stats.select("doc_id", model.score_column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
