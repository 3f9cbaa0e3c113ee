"""Quality by a sparse rule ensemble over text statistics, as Spark column expressions.

Short trees are grown on statistics of labelled texts; every path from a root to a
node becomes a rule, a conjunction of comparisons. A lasso logistic regression over
the rules keeps a few with weights. The kept rules are compiled into one expression,
so scoring is a scan with built-in functions only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._labelled import remainder, sample
from tidewater.llm._store import stored

#: At most this many labelled rows of each class are fitted on, drawn by their id's hash.
TRAIN_ROWS = 5_000
TREES, DEPTH, SEED = 16, 3, 7
#: Strength of the lasso; more keeps fewer rules.
LASSO = 0.002
#: Documents at or above this score are kept.
THRESHOLD = 0.3

Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class Model:
    """score = logistic(bias + the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _holds(rule: Rule) -> Column:
    test = F.lit(True)
    for name, sign, bound in rule:
        test = test & ((F.col(name) <= bound) if sign == "<=" else (F.col(name) > bound))
    return test


#: Counts in the whole text, each a pattern of Java regular expressions.
COUNTS = {
    "lines": r"[^\n]+",
    "letter_runs": r"\p{L}+",
    "capital_runs": r"\p{Lu}{2,}",
    "digit_runs": r"\p{Nd}+",
    "mark_runs": r"[^\p{L}\p{N}\s]{2,}",
    "odd_marks": r"[^\p{L}\p{N}\s.,;:'\"?!()-]+",
    "lone_marks": r"(?<=\s)[^\p{L}\p{N}\s](?=\s)",
    "sentences": r"[.?!](?=\s)",
    "repeats": r"(?<!\S)(\S++)(?=\s+\1(?!\S))",
}


def with_statistics(documents: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """Add statistics of whole texts (null counts as empty); also their names.

    Rates are per word, so that length alone doesn't decide; all are 0 without words.
    Beside the counts there are the shares of words and of lines that differ.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = lambda pattern: F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), pattern)
    rows = documents.withColumns({"_parts": parts(r"\s+"), "_unlike": F.size(F.array_distinct(parts(r"\n+")))})
    words = F.when(F.get("_parts", F.lit(0)) == "", 0).otherwise(F.size("_parts"))
    counts = {f"_{k}": F.regexp_count(text, F.lit(p)) for k, p in COUNTS.items()}
    rows = rows.withColumns(counts | {"_words": words, "_distinct": F.size(F.array_distinct("_parts")), "_chars": F.char_length(text)})
    per = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    rates = {f"q_{k}": per(f"_{k}", "_words") for k in COUNTS} | {"q_length": per("_chars", "_words"), "q_words": F.log1p("_words"), "q_distinct": per("_distinct", "_words"), "q_unlike": per("_unlike", "_lines")}
    return rows.withColumns(rates).drop("_chars", "_words", "_parts", "_distinct", "_unlike", *[f"_{k}" for k in COUNTS]), list(rates)


def _paths(forest: str, names: list[str]) -> list[Rule]:
    """The rules of a forest: the conditions on the way to every node, each rule once.

    Reads Spark's own description of the trees: nested If and Else lines.
    """
    line = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)")
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, str, float]]] = []
    for found in filter(None, map(line.match, forest.splitlines())):
        depth = len(found[1])
        path = [p for p in path if p[0] < depth] + [(depth, (names[int(found[2])], found[3], float(found[4])))]
        rules[tuple(c for _, c in path)] = None
    return list(rules)


def train(documents: DataFrame, labels: DataFrame, held_out: Column, each: int = TRAIN_ROWS) -> Model:
    """Fit on at most `each` labelled documents of each class that aren't held out.

    Without texts of both classes every text scores what the labels there say, or 0.5.
    """
    rows, names = with_statistics(sample(documents, labels, "quality", ~held_out, each))
    rows = stored(rows.select("_id", F.col("label").cast("double"), *names).orderBy("_id").coalesce(1))
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Model({frozenset(): 0.0, frozenset({1.0}): 30.0, frozenset({0.0}): -30.0}[frozenset(seen)], ())
    # Both classes weigh the same while trees are grown; the curve is fitted as the labels are.
    even = F.when(F.col("label") == 1, 0.5 / seen[1.0]).otherwise(0.5 / seen[0.0]) * sum(seen.values())
    table = VectorAssembler(inputCols=names, outputCol="_features").transform(rows.withColumn("_weight", even))
    forest = RandomForestClassifier(labelCol="label", featuresCol="_features", weightCol="_weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(table)
    rules = _paths(forest.toDebugString, names)
    if not rules:
        return Model(math.log(seen[1.0] / seen[0.0]), ())
    fired = rows.select("label", *[_holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_rules").transform(fired)
    lasso = LogisticRegression(labelCol="label", featuresCol="_rules", regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=60).fit(fired)
    weights = lasso.coefficients.toArray()
    return Model(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1: keep) of every document.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out from fitting. Null texts
    count as empty; null ids and repeated rows give rows too; an empty table gives
    none; columns besides doc_id and text are ignored.
    """
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = train(documents, labels, held_out)
    rows, names = with_statistics(documents.select("doc_id", "text"))
    scored = rows.select("doc_id", held_out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
