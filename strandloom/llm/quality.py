"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics of every whole text are computed once, by a map without a shuffle, and written as a narrow table. Shallow
forest trees are fitted on the labelled rows' statistics; every path from a root becomes a conjunctive rule. A lasso
logistic regression weights the rules, most weights become 0, and what is left is compiled into one Spark
column expression, so scoring is a projection over the statistics. Both fits are distributed.

The statistics are shares and means, bounded whatever a text's length. Defined cases: null and empty texts have all
statistics 0 and get the score of those; without labelled rows of both kinds every score is the share of good labels
(one half without any). Labels repeated for a doc_id count as their mean, rounded up from one half.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.llm.language_id import held_out
from strandloom.session import materialise, ship

STATS = [
    "log_words", "word_length", "upper", "digits", "symbols", "spaces", "beyond_ascii", "lines_per_word", "words_per_line", "distinct_words", "distinct_pairs",
    "short_words", "long_words", "capital_words", "shouted_words", "words_with_symbols", "pipes", "repeated_signs", "commonest_word", "sentence_ends",
]


def _runs(sorted_rows: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, length) of each run of equal (row, key)."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = (sorted_rows[1:] != sorted_rows[:-1]) | (sorted_keys[1:] != sorted_keys[:-1])
    at = np.flatnonzero(new)
    return sorted_rows[at], np.diff(np.append(at, len(sorted_keys)))


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x STATS."""
    n = len(off) - 1
    out = np.zeros((n, len(STATS)))
    byte = np.arange(256)
    upper, digit = (byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57)
    letter = upper | (byte >= 97) & (byte <= 122) | (byte >= 128)
    space = (byte == 32) | (byte >= 9) & (byte <= 13)
    symbol = ~(letter | digit | space)
    odd = symbol & ~np.isin(byte, [ord(c) for c in ".,;:'\"-()?!"])
    ends = np.isin(byte, [ord(c) for c in ".?!"])
    for row, last, rows, s, e, h in W.word_blocks(data, off, W.NONSPACE):
        lo, hi, k = int(off[row]), int(off[last]), last - row
        part, size = data[lo:hi], np.maximum(np.diff(off[row : last + 1]), 1).astype(float)
        edges = off[row : last + 1] - lo

        def share(mask, part=part, edges=edges, size=size):
            total = np.concatenate(([0], np.cumsum(mask)))
            return (total[edges[1:]] - total[edges[:-1]]) / size

        own = rows - row
        words = np.bincount(own, minlength=k).astype(float)
        w1 = np.maximum(words, 1)
        length = e - s
        per = lambda mask: np.bincount(own, weights=mask, minlength=k) / w1
        sums = lambda table: np.concatenate(([0], np.cumsum(table[part])))
        in_word = lambda table: (lambda t: t[e - lo] - t[s - lo])(sums(table))
        order = np.lexsort((h, own))
        r, c = _runs(own[order], h[order])
        distinct = np.bincount(r, minlength=k) / w1
        commonest = np.zeros(k)
        np.maximum.at(commonest, r, c)
        first, pair = W.windows(own, h, 2)
        order = np.lexsort((pair, own[first]))
        r, _ = _runs(own[first][order], pair[order])
        pairs = np.bincount(own[first], minlength=k)
        lines = share(part == 10) * size + (words > 0)
        same = np.zeros(len(part), bool)
        same[1:] = (part[1:] == part[:-1]) & symbol[part[1:]]
        n_upper, n_letter = in_word(upper), in_word(letter)
        out[row:last] = np.stack([
            np.log1p(words), np.bincount(own, weights=length, minlength=k) / w1, share(upper[part]), share(digit[part]), share(symbol[part]), share(space[part]), share(part >= 128),
            lines / w1 * (words > 0), words / np.maximum(lines, 1), distinct, np.where(pairs > 0, np.bincount(r, minlength=k) / np.maximum(pairs, 1), 1.0 * (words > 0)),
            per(length <= 3), per(length >= 12), per(upper[data[s]] if len(s) else np.zeros(0)), per((n_upper == n_letter) & (n_letter > 1)), per(in_word(odd) > 0), share(part == 124), share(same), commonest / w1, share(ends[part]) * size / w1,
        ], 1)
    return out


def _stats(batches):
    for b in batches:
        x = statistics(*W.raw(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(x[:, i]) for i in range(len(STATS))]], names=["id", *STATS])


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and STATS."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_stats, f"id {kind}, " + ", ".join(f"{c} double" for c in STATS)).withColumnRenamed("id", id_col)


Rule = tuple[tuple[int, str, float], ...]


def rules_of(forest) -> list[Rule]:
    """Every distinct path from a root, inner nodes too, as tests (statistic, '<=' or '>', bound)."""
    found: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            found.setdefault(tuple(sorted(path)))
        if node.numDescendants() > 0:
            split = node.split()
            i, bound = split.featureIndex(), split.threshold()
            walk(node.leftChild(), (*path, (i, "<=", bound)))
            walk(node.rightChild(), (*path, (i, ">", bound)))

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def holds(rule: Rule) -> Column:
    tests = [(F.col(STATS[i]) <= bound) if sign == "<=" else (F.col(STATS[i]) > bound) for i, sign, bound in rule]
    return functools.reduce(operator.and_, tests)


def fit(labelled: DataFrame, trees: int = 20, depth: int = 3, lasso: float = 0.0005, seed: int = 11) -> tuple[list[tuple[Rule, float]], float]:
    """labelled: STATS and y (0 or 1). Returns the rules with their weights, and the intercept."""
    size = dict(labelled.groupBy("y").count().collect())
    if not size.get(0) or not size.get(1):
        return [], float("inf") if size.get(1) else float("-inf") if size.get(0) else 0.0
    both = VectorAssembler(inputCols=STATS, outputCol="x").transform(labelled)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed).fit(both)
    rules = rules_of(forest)
    if not rules:
        p = size[1] / (size[0] + size[1])
        return [], float(np.log(p / (1 - p)))
    cells = labelled.select(F.array(*[holds(r).cast("double") for r in rules]).alias("cells"), "y")
    cells = cells.groupBy("cells", "y").count()  # equal rows of zeros and ones count once, with a weight
    from pyspark.ml.functions import array_to_vector

    lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="count", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60, tol=1e-5)
    model = lr.fit(cells.select(array_to_vector("cells").alias("x"), F.col("y").cast("double"), F.col("count").cast("double")))
    return [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-9], float(model.intercept)


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The score as a column expression over STATS."""
    if np.isinf(intercept):
        return F.lit(float(intercept > 0))
    terms = [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in rules]
    total = functools.reduce(operator.add, terms, F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns per document; rows whose crc32(doc_id) mod 3 is 1 aren't learned from."""
    rows = docs.select(F.struct("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out")).alias("row"), "text")
    all_stats = materialise(stats(rows, "row").select("row.doc_id", "row.held_out", *STATS), "stats")
    y = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    labelled = materialise(all_stats.where("not held_out").join(y, "doc_id").select("y", *STATS), "labelled")
    score = compiled(*fit(labelled))
    return all_stats.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
