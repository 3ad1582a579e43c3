"""Quality classifier as a sparse rule ensemble.

Trees are grown on text statistics; each path from a root to a node is a rule, the conjunction of its splits. A lasso
logistic fit gives the rules weights, most of them zero; what remains is compiled into one column expression over the
statistics, so scoring is a scan without any join.

The fit takes a bounded sample of the labelled rows (`most`, a parameter); statistics and scores cover all rows.
Defined results: null and empty texts have all statistics zero and get the score of those; without labels of both kinds every
score is the share of label 1, or one half without labels; repeated labels of a document count once each if they agree and
not at all if they differ; null labels are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

STATISTICS = ("n_chars", "n_words", "mean_word", "punctuation", "symbols", "bangs", "capitals", "digits", "line_ends", "repeated_words", "repeated_lines")
MOST = 20_000


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the statistics as columns of doubles, all of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines, n = F.filter(F.split(t, r"\s+"), lambda w: w != ""), F.split(t, "\n"), F.greatest(F.char_length(t), F.lit(1))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    repeated = lambda x: F.lit(1.0) - F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1))
    found = {
        "n_chars": F.char_length(t), "n_words": F.size(words), "mean_word": F.char_length(t) / F.greatest(F.size(words), F.lit(1)),
        "punctuation": share(r"[!-/:-@\[-`{-~]"), "symbols": share(r"[#$%&*|]"), "bangs": share("!"), "capitals": share("[A-Z]"), "digits": share("[0-9]"), "line_ends": share("\n"),
        "repeated_words": F.when(F.size(words) > 0, repeated(words)).otherwise(0.0), "repeated_lines": repeated(lines),
    }
    return docs.withColumns({k: found[k].cast("double") for k in STATISTICS})


#: A rule: (statistic, whether above, bound), all of which must hold.
Rule = tuple[tuple[str, bool, float], ...]


class Ensemble(NamedTuple):
    bias: float
    rules: tuple[tuple[Rule, float], ...]


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) > bound if above else F.col(c) <= bound for c, above, bound in rule])


def paths(tree_text: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The rules of trees as the fitted model prints them: one for each node below a root, tightest bounds only, each once."""
    found: dict[Rule, None] = {}
    above: dict[int, tuple[str, bool, float]] = {}
    for line in tree_text.splitlines():
        if m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line):
            depth = len(m[1])
            above = {k: v for k, v in above.items() if k < depth} | {depth: (names[int(m[3])], m[4] == ">", float(m[5]))}
            tight: dict[tuple[str, bool], float] = {}
            for c, over, bound in above.values():
                tight[c, over] = (max if over else min)(bound, tight.get((c, over), bound))
            found[tuple(sorted((c, over, bound) for (c, over), bound in tight.items()))] = None
        elif re.match(r" *Tree ", line):
            above = {}
    return list(found)


def fit(labelled: DataFrame, label: str = "label", most: int = MOST, trees: int = 24, depth: int = 3, penalty: float = 0.003, seed: int = 7) -> Ensemble:
    """labelled: the statistics and a label of 0 or 1; about `most` of its rows are drawn, at random with a fixed seed."""
    rows = written(labelled.select(*STATISTICS, F.col(label).cast("double").alias("label")), "labelled")
    n = rows.count()
    sample = written(rows.sample(most / n, seed=seed) if n > most else rows, "sample").repartition(4)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = counts.get(1.0, 0) / max(1, sum(counts.values())) if counts else 0.5
        return Ensemble(20.0 * (2 * share - 1), ())
    vector = array_to_vector(F.array(*STATISTICS)).alias("x")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, maxBins=64).fit(sample.select(vector, "label"))
    rules = paths(model.toDebugString)
    if not rules:
        return Ensemble(0.0, ())
    terms = written(sample.select(F.array(*[_holds(r).cast("double") for r in rules]).alias("holds"), "label"), "rules").select(array_to_vector("holds").alias("x"), "label")
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(terms)
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def score(ensemble: Ensemble) -> Column:
    """The compiled ensemble: a probability from the statistics."""
    total = reduce(lambda a, b: a + b, [F.when(_holds(r), F.lit(w)).otherwise(0.0) for r, w in ensemble.rules], F.lit(ensemble.bias))
    return 1 / (1 + F.exp(-total))


def agreed(labels: DataFrame, id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(id, label): one row per labelled document whose labels agree."""
    rows = labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    return rows.filter("label = _most").select("id", "label")
