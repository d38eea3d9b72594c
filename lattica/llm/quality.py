"""Document quality by a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table

#: Labelled rows that a model is fitted on at most, about; chosen by a hash of doc_id.
MAX_TRAIN = 20_000
#: Rows whose crc32 of the doc_id's text leaves this remainder are never learnt from.
HELD_OUT, FOLDS = 0, 5

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "!#$%&*+<=>@[]^_{|}~\\/"


def statistics(text: Column | str) -> dict[str, Column]:
    """Statistics of a whole text, null counting as empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    lines = F.split(t, "\n")

    def share(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))) / n

    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "word_length": F.length(t) / F.greatest(words, F.lit(1)),
        "upper": share(UPPER),
        "symbols": share(SYMBOLS),
        "digits": share("0123456789"),
        "stops": share(".,;:?"),
        "own_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.length(t) / F.size(lines),
    }


@dataclass(frozen=True)
class Rules:
    """Rules as conjunctions of (statistic, at most?, bound), their weights, and the intercept."""

    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over statistics columns."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            if w:
                z = z + F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    out = F.lit(True)
    for name, at_most, bound in rule:
        out = out & (F.col(name) <= bound if at_most else F.col(name) > bound)
    return out


_STEP = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_paths(debug: str, names: list[str]) -> set[tuple[tuple[str, bool, float], ...]]:
    """Paths from the root to every node of printed trees, as sorted conjunctions."""
    found, path = set(), []
    for line in debug.splitlines():
        if m := _STEP.match(line):
            depth = len(m[1])
            path = [x for x in path if x[0] < depth] + [(depth, (names[int(m[3])], m[4] == "<=", float(m[5])))]
            found.add(tuple(sorted({x[1] for x in path})))
        elif "Tree" in line:
            path = []
    return found


def fit(train: DataFrame, names: list[str], trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> Rules:
    """Rules from the paths of a random forest, weighted by a lasso logistic regression.

    train: the statistics and a double column label of 0 and 1.  One class only, or no row at all,
    gives no rule and a constant score of the smoothed share of label 1.
    """
    table = Table(train)
    try:
        return _fitted(table, names, trees, depth, penalty, seed)
    finally:
        table.drop()


def _fitted(table: Table, names: list[str], trees: int, depth: int, penalty: float, seed: int) -> Rules:
    n, ones = table.df.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    base = (ones + 0.5) / (n + 1)
    constant = Rules((), (), math.log(base / (1 - base)))
    if not 0 < ones < n:
        return constant
    data = VectorAssembler(inputCols=names, outputCol="features").transform(table.df).select("features", "label", *names)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(data)
    rules = sorted(set().union(*(tree_paths(t.toDebugString, names) for t in forest.trees)))
    if not rules:
        return constant
    flags = table.df.select("label", F.array(*(holds(r).cast("double") for r in rules)).alias("a"))
    from pyspark.ml.functions import array_to_vector

    flags = flags.select("label", array_to_vector("a").alias("features")).repartition(8).persist()
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(flags)
    flags.unpersist()
    kept = [(r, w) for r, w in zip(rules, model.coefficients.toArray().tolist()) if w != 0]
    return Rules(tuple(r for r, _ in kept), tuple(w for _, w in kept), model.intercept)


def held_out(doc_id: Column | str) -> Column:
    """Whether a row is kept from learning; a null doc_id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """Statistics and label of a bounded sample of the labelled documents outside the held-out fold.

    Only the sample's ids, whose number is checked, are broadcast; the statistics are computed for
    their documents alone.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    total = known.count()
    share = min(1.0, max_rows / max(total, 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = Table(sample).df
    if sample.count() <= 2 * max_rows:
        sample = F.broadcast(sample)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(sample, "doc_id")
    return rows.select("label", *(c.cast("double").alias(k) for k, c in statistics("text").items()))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_TRAIN) -> DataFrame:
    """Quality of every document as labels.quality marks it.

    docs: doc_id long, text string; labels: doc_id, quality 0/1; other columns are ignored.
    Returns doc_id, held_out, score (0 to 1, higher: label 1 is likelier), predicted.  A random
    forest's tree paths over text statistics become conjunctive rules, a lasso logistic regression
    weighs them, and the rules left are one Spark expression; it is evaluated over whole texts.

    Null text counts as empty and gets the score of an empty text.  Null doc_id: scored, held out.
    Labels that are null, or of unknown documents, are ignored; of contradicting ones the lower
    counts.  Without labels of both values every score is the same.  Texts are read whole, however
    long.  Repeated rows are documents each; rows that tie get the same score.  Empty documents: no
    rows.
    """
    rules = fit(training_rows(docs, labels, max_rows), list(statistics("text")))
    return scored(docs, rules, threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs, with their columns, whose score reaches the threshold.

    Each row is judged by its own text, so a null doc_id and repeated ids are rows like others.  Rows
    are written with their scores before they are filtered: a filter on the scores would else be
    pushed into the expression, and the statistics be computed again for every rule.
    """
    rules = fit(training_rows(docs, labels, max_rows), list(statistics("text")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *(c.cast("double").alias(k) for k, c in statistics("text").items()))
    judged = Table(rows.select("_row", (rules.score() >= threshold).alias("_good"))).df
    return judged.where("_good").select("_row.*")


def scored(docs: DataFrame, rules: Rules, threshold: float = 0.3) -> DataFrame:
    """The rules' score of every document, as one Spark expression over its statistics."""
    rows = docs.select(F.col("doc_id").cast("long"), *(c.cast("double").alias(k) for k, c in statistics("text").items()))
    rows = rows.select("doc_id", held_out("doc_id").alias("held_out"), rules.score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
