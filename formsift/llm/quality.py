"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on labelled documents; every path from a root is a rule, a conjunction
of bounds on statistics. A lasso logistic regression over all rules keeps the few that matter.
What is left is compiled into one Spark column expression, so scoring a corpus is a projection.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift.llm.common import WORD, settled
from formsift.operators.stages import computed

#: Stop words of the corpus' languages, as a sign of running prose.
STOP_WORDS = ("a", "and", "are", "as", "avec", "de", "der", "des", "die", "el", "en", "est", "et", "for", "in", "ist", "la", "le", "les", "los", "mit", "of", "que", "the", "to", "und", "von", "with", "y", "zu")


def statistics() -> dict[str, Column]:
    """Statistics of ``words``, ``lines`` and ``text``; 0 for empty texts."""
    words, lines, text = F.col("words"), F.col("lines"), F.col("text")
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / chars
    some = F.greatest(F.size(lines), F.lit(1))
    # Equal neighbours show up without sorting a long text's words.
    repeats = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.element_at(words, F.greatest(i, F.lit(1))))))
    stop = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
    ended = F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"[.!?]$")))
    return {
        "n_words": F.log1p(F.size(words)),
        "word_chars": chars / n,
        "upper": share(r"[^\p{Lu}]+"),
        "digits": share(r"[^\p{Nd}]+"),
        "marks": share(r"[\p{L}\p{Nd}\s.,]+"),
        "periods": share(r"[^.]+"),
        "distinct": F.size(F.array_distinct(words)) / n,
        "repeats": repeats / n,
        "stop_words": stop / n,
        "lines": F.size(lines) / n,
        "ended_lines": ended / some,
        "distinct_lines": F.size(F.array_distinct(lines)) / some,
    }


NAMES = ("n_words", "word_chars", "upper", "digits", "marks", "periods", "distinct", "repeats", "stop_words", "lines", "ended_lines", "distinct_lines")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``stats``, computed once, whatever number of rules reads it."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    parts = F.struct(text.alias("text"), words.alias("words"), F.filter(F.split(text, "\n", -1), lambda x: x != "").alias("lines"))
    stats = F.inline(F.transform(F.array(parts), lambda p: p))
    staged = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)], stats)
    values = F.struct(*[v.cast("double").alias(k) for k, v in statistics().items()])
    staged = staged.select(*[f"_{i}" for i in range(len(docs.columns))], F.inline(F.array(values)))
    return staged.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)], F.struct(*NAMES).alias("stats"))


#: A condition: (statistic, is upper bound, value). A rule: a tuple of them.
Rule = tuple[tuple[str, bool, float], ...]


def tree_rules(dump: str) -> set[Rule]:
    """Every path from a root to a node of the trees in a model's text form."""
    rules, path = set(), []
    for line in dump.splitlines():
        depth = len(line) - len(line.lstrip())
        if m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line):
            path = [x for x in path if x[0] < depth]
            path.append((depth, (NAMES[int(m[1])], m[2] == "<=", float(m[3]))))
            rules.add(simplified(tuple(c for _, c in path)))
        elif line.strip().startswith("Tree"):
            path = []
    return rules


def simplified(rule: Rule) -> Rule:
    """The tightest bound of each statistic and direction."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, upper, value in rule:
        old = bounds.get((name, upper), value)
        bounds[name, upper] = min(old, value) if upper else max(old, value)
    return tuple(sorted((name, upper, value) for (name, upper), value in bounds.items()))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, upper, value in rule:
        stat = F.col(f"stats.{name}")
        out = out & ((stat <= value) if upper else (stat > value))
    return out


@dataclass(frozen=True)
class RuleModel:
    """Rules with their weights, and the intercept."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1, from the struct ``stats``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_rules(labelled: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on ``text`` and ``label`` (1 or 0); the table must be bounded, see ``sample_labels``.

    A table whose labels are all alike, or that is empty, gives a model without rules that
    returns the smoothed share of label 1.
    """
    data = settled(with_statistics(labelled.select("text", F.col("label").cast("double").alias("label"))).select(
        "label", "stats"), "labelled")
    n, ones = data.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    base = math.log((ones + 1) / (n - ones + 1))
    if ones in (0, n):
        return RuleModel(base, ())
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(data.select("label", "stats.*"))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.6", seed=seed, minInstancesPerNode=5).fit(vectors)
    rules = sorted(tree_rules(forest.toDebugString))
    if not rules:
        return RuleModel(base, ())
    fires = data.select("label", F.array(*[condition(r).cast("double") for r in rules]).alias("fires"))
    from pyspark.ml.functions import array_to_vector
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(
        fires.select("label", array_to_vector("fires").alias("features")))
    weights = zip(rules, lasso.coefficients.toArray().tolist())
    return RuleModel(float(lasso.intercept), tuple((r, w) for r, w in weights if abs(w) > 1e-9))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the identifier's text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample_labels(docs: DataFrame, labels: DataFrame, bound: int = 8000) -> DataFrame:
    """``text, label`` of at most ``bound`` labelled documents outside the held-out part.

    Those with the smallest hash of the identifier are taken, so reruns agree. Labels that are
    null, or that contradict each other for one identifier, are not learned from.
    """
    usable = labels.filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    usable = usable.filter("label = other").select("doc_id", "label")
    taken = settled(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "label-sample")
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "label")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = 8000) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    ``labels`` has ``doc_id`` and ``label``. The score reads the text alone. Null and empty texts
    have all statistics 0 and are scored like any other. Repeated rows are scored alike. Other
    columns are passed through; columns of the added names are replaced. Without labels every
    document gets the score 0.5. An empty table gives an empty one.
    """
    model = fit_rules(sample_labels(docs, labels, bound))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "stats")]
    # Staged, so that what reads the score does not carry all rules along.
    scored = computed(with_statistics(docs.select(*kept)), {"score": model.score()})
    return scored.select(*kept, held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
