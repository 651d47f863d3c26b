"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics are Spark columns of the whole text (lengths, character shares,
repetition of words and lines).  A random forest of shallow trees is grown on
the labelled rows' statistics; every path from a root to a node is a rule, a
conjunction of one interval for each statistic on it.  A logistic regression
with an L1 penalty weighs the rules, which leaves few of them; those are compiled into one Spark column, the
logistic of the sum of the weights of the rules that hold.

All labelled rows are learnt from (their statistics are some 20 doubles a row;
both learners run on the executors); the model is at most TREES * 2**(DEPTH + 1)
rules, whatever the input.

Defined cases: null and empty texts have statistics 0 and are scored like any
other; without a labelled row every score is 0.5, with one label only it is
that label; ids that are null learn nothing, ids with two labels learn the
larger one for each of their texts; repeated rows keep their own score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import cut

TREES, DEPTH, BINS, SEED = 40, 3, 64, 17
PENALTY, ITERATIONS = 0.001, 100
OWN = "_stat_"
BALANCE = 0.5  # share of the forest's weight that each label gets


def _matched(text: Column, pattern: str) -> Column:
    """Number of characters of the runs that a pattern of single characters matches."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def statistics(text: Column) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """Base counts of a text, and the statistics made of them (columns of the bases' names)."""
    t = F.coalesce(text, F.lit(""))
    word_list = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    base = [
        ("chars", F.char_length(t)), ("blanks", _matched(t, r"\s+")), ("letters", _matched(t, r"\p{L}+")), ("uppers", _matched(t, r"\p{Lu}+")),
        ("digits", _matched(t, r"\p{Nd}+")), ("stops", _matched(t, r"[.,;:!?'\"()-]+")), ("marks", F.char_length(F.regexp_replace(t, r"[^!?*#$%&|@<>=+_~^\\{}\[\]/]+", ""))),
        ("ends", F.size(F.split(t, r"[.!?](?=\s|$)")) - 1), ("words", F.size(word_list)), ("kinds", F.size(F.array_distinct(word_list))),
        ("short", F.size(F.filter(word_list, lambda w: F.char_length(w) <= 3))), ("lines", F.size(lines)), ("line_kinds", F.size(F.array_distinct(lines))),
        ("pure", F.size(F.filter(word_list, lambda w: w.rlike(r"^\p{L}+[.,;:!?]?$")))),
    ]

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    made = [
        ("log_chars", F.log1p(F.col("chars").cast("double"))), ("log_words", F.log1p(F.col("words").cast("double"))),
        ("word_length", (F.col("chars") - F.col("blanks")) / F.greatest(F.col("words"), F.lit(1))), ("blank_share", share("blanks", "chars")),
        ("letter_share", share("letters", "chars")), ("upper_share", share("uppers", "letters")), ("digit_share", share("digits", "chars")),
        ("stop_share", share("stops", "chars")), ("mark_share", share("marks", "chars")), ("end_share", share("ends", "words")),
        ("kind_share", share("kinds", "words")), ("short_share", share("short", "words")), ("line_words", share("words", "lines")),
        ("line_share", share("line_kinds", "lines")), ("pure_share", share("pure", "words")),
        ("other_share", F.greatest(F.col("chars") - F.col("blanks") - F.col("letters") - F.col("digits") - F.col("stops"), F.lit(0)) / F.greatest(F.col("chars"), F.lit(1))),
    ]
    return base, [(n, c.cast("double")) for n, c in made]


NAMES = ["log_chars", "log_words", "word_length", "blank_share", "letter_share", "upper_share", "digit_share", "stop_share", "mark_share",
         "end_share", "kind_share", "short_share", "line_words", "line_share", "pure_share", "other_share"]


@dataclass(frozen=True)
class Rule:
    """lower < statistic <= upper for every statistic named."""
    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self, prefix: str = "") -> Column:
        parts = []
        for name, low, high in self.bounds:
            x = F.col(f"`{prefix}{name}`")
            parts += ([x > low] if low is not None else []) + ([x <= high] if high is not None else [])
        return reduce(lambda a, b: a & b, parts)

    def __str__(self) -> str:
        return " and ".join((f"{low!r} < " if low is not None else "") + name + (f" <= {high!r}" if high is not None else "") for name, low, high in self.bounds)


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    constant: float | None = None  # the score where nothing can be told apart

    def score(self, prefix: str = "") -> Column:
        """Probability of label 1 as one column over the statistics."""
        if self.constant is not None:
            return F.lit(self.constant)
        total = reduce(lambda a, r: a + F.when(r[0].column(prefix), r[1]).otherwise(0.0), self.rules, F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


_NODE = re.compile(r"^( *)(?:(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)|Predict: .*)$")


def tree_rules(text: str, names: list[str]) -> list[Rule]:
    """Rules of every node below the root, from a tree's printed form."""
    path: list[tuple[int, str, str, float]] = []
    out = []
    for line in text.splitlines():
        m = _NODE.match(line)
        if not m or m[2] is None:
            continue
        depth = len(m[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, names[int(m[3])], m[4], float(m[5])))
        out.append(conjunction([(n, o, v) for _, n, o, v in path]))
    return out


def conjunction(conditions: list[tuple[str, str, float]]) -> Rule:
    """One interval for each statistic."""
    low: dict[str, float] = {}
    high: dict[str, float] = {}
    for name, op, value in conditions:
        if op == "<=":
            high[name] = min(value, high.get(name, value))
        else:
            low[name] = max(value, low.get(name, value))
    return Rule(tuple((n, low.get(n), high.get(n)) for n in sorted({*low, *high})))


def described(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` without its text but with the text's statistics, their names after OWN; written, so each text is read once."""
    base, made = statistics(F.col("_text"))
    keep = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    inner = df.select(F.struct(F.lit(0).alias("_"), *keep).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    inner = inner.select("_row", *[c.alias(n) for n, c in base]).select("_row", *[c.alias(n) for n, c in made])
    return cut(inner.select(*[F.col(f"_row.`{c}`") for c in df.columns if c != text_col], *[F.col(n).alias(OWN + n) for n in NAMES]), "text-statistics")


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from the described rows that ``labels`` name (the caller leaves out what must be held out)."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) == 1).cast("double")).alias("y")))
    data = rows.select(F.col(id_col).alias("_id"), *[F.col(OWN + n).alias(n) for n in NAMES]).join(known, "_id").drop("_id")
    data = cut(data, "labelled-statistics")
    sizes = {r.y: r.n for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(0.0, [], next(iter(sizes), 0.5))
    total = sum(sizes.values())
    balance = F.when(F.col("y") == 1, BALANCE * total / sizes[1.0]).otherwise((1 - BALANCE) * total / sizes[0.0])
    vectors = VectorAssembler(inputCols=NAMES, outputCol="x").transform(data.withColumn("w", balance))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED,
                                    featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString, NAMES)}, key=str)
    if not rules:
        return Model(0.0, [], sizes[1.0] / total)
    held = data.select("y", array_to_vector(F.array(*[F.when(r.column(), 1.0).otherwise(0.0) for r in rules])).alias("r"))
    lasso = LogisticRegression(featuresCol="r", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, maxIter=ITERATIONS,
                               standardization=False).fit(cut(held, "rules-held"))
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return Model(float(lasso.intercept), kept)


def score(rows: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """The described rows with score and rules (the weighed rules that hold), their names after ``prefix``, for the statistics."""
    names = F.array(*[F.when(r.column(OWN), F.lit(str(r))) for r, _ in model.rules]).cast("array<string>")
    kept = [F.col(f"`{c}`") for c in rows.columns if not c.startswith(OWN)]
    return rows.select(*kept, model.score(OWN).cast("double").alias(prefix + "score"), F.filter(names, lambda x: x.isNotNull()).alias(prefix + "rules"))
