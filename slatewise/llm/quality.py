"""Operator 7: a sparse rule ensemble for text quality, compiled into Spark column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, as column expressions over the column given."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.split(text, r"\s+"), F.split(text, "\n")

    def share(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / n

    def plain(mark: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / n

    return {
        "log_length": F.log1p(n),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+"),
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"[0-9]+"),
        "bars": plain("|"),
        "exclamations": plain("!"),
        "stops": plain("."),
        "commas": plain(","),
        "breaks": plain("\n"),
        "word_length": n / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: (statistic, is it an upper bound, value)."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        held = F.lit(True)
        for name, upper, value in self.bounds:
            held = held & (of(name) <= value if upper else of(name) > value)
        return held


@dataclass
class RuleEnsemble:
    """Weighted rules behind a logistic link."""

    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self, of: Callable[[str], Column] = F.col) -> Column:
        """The score as an expression over the statistics that `of` gives by the names that `statistics` uses."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(rule.column(of), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(told: str, names: list[str]) -> list[Rule]:
    """Every path from a root to a node below it, read from the forest's description."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in told.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if line.lstrip().startswith("Tree "):
                path = []
            continue
        depth = len(m[1])
        path = [(d, b) for d, b in path if d < depth]
        path.append((depth, (names[int(m[2])], m[3] == "<=", float(m[4]))))
        tight: dict[tuple[str, bool], float] = {}
        for _, (name, upper, value) in path:
            old = tight.get((name, upper))
            tight[name, upper] = value if old is None else (min if upper else max)(old, value)
        rules[Rule(tuple(sorted((n, u, v) for (n, u), v in tight.items())))] = None
    return list(rules)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_rules(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, trees: int = 16, depth: int = 4, penalty: float = 0.002, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleEnsemble:
    """Fit on the labelled rows that aren't held out, at most `max_rows` of them in hash order.

    The forest's paths become rules over the statistics of the text alone, and a lasso logistic
    fit keeps the few that matter. Rows with a null id, text or label aren't learned from. Without labels
    the score is 1/2; with labels of one kind it is near that kind.
    """
    own = F.col(id_col).cast("long")
    taught = labels.select(own.alias("_id"), F.col(label_col).cast("double").alias("label")).filter("_id is not null and label is not null")
    taught = taught.filter(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "label").limit(max_rows)
    texts = docs.select(own.alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    rows = texts.join(F.broadcast(taught), "_id")  # at most max_rows ids and labels
    stats = statistics(F.col("_text"))
    rows = rows.repartition(8).select("label", *[c.alias(n) for n, c in stats.items()]).persist()
    try:
        kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(kinds) < 2:
            return RuleEnsemble(0.0 if not kinds else 4.0 if kinds.get(1.0) else -4.0)
        ready = VectorAssembler(inputCols=list(stats), outputCol="features").transform(rows)
        forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, seed=seed).fit(ready)
        rules = tree_rules(forest.toDebugString, list(stats))
        marks = rows.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        marks = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(marks).select("label", "features").persist()
        try:
            lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(marks)
        finally:
            marks.unpersist()
        return RuleEnsemble(float(lasso.intercept), {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w})
    finally:
        rows.unpersist()


def quality_scores(docs: DataFrame, model: RuleEnsemble, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row by compiled rules; no shuffle, no Python.

    A null text is scored as an empty one. Repeated rows and null ids are scored row by row (a null
    id isn't held out). Further columns of `docs` are ignored. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stats = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in statistics(text).items()])
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: RuleEnsemble, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, columns unchanged, whose text scores at least `threshold`.

    A null text is scored as an empty one. Repeated rows and null ids are judged row by row, alike. An empty table stays empty.
    The statistics are one array's only element: a filter on plain columns would have each made anew for every rule.
    """
    stats = F.array(F.struct(*[c.alias(n) for n, c in statistics(F.coalesce(F.col(text_col), F.lit(""))).items()]))
    return docs.filter(F.exists(stats, lambda s: model.score(s.getField) >= threshold))
