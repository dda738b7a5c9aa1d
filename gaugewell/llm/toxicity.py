"""Toxicity by a classifier chain: categories one after the other, each fed the probabilities of those before.

The chain is fitted on a bounded, documented sample of labelled documents (``SAMPLE``, by the hash of the id; equal
texts count once). Words that tell a category best in the sample are the vocabulary. For each category in order, a
logistic regression over these words and the earlier categories' probabilities is fitted; what it learns from are
out-of-fold probabilities, by models that have not seen the document, so that later links do not trust earlier ones
more than they may when they score new documents. Scoring is a projection over all documents: no shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.session import cut

CATEGORIES = ("quality", "toxic")
SAMPLE = 20_000
FOLDS = 3
VOCABULARY = 1000
#: Documents of the sample that must hold a word of the vocabulary.
SUPPORT = 5
#: Least log-likelihood ratio (half of G squared) of a word of the vocabulary: about one chance word in ten thousand.
LEAST_RATIO = 7.5
THRESHOLD = 0.5
#: Partitions of the sample, whose sums are added in one order.
PARTITIONS = 8


class Chain(NamedTuple):
    """Fitted links in order, and their vocabulary; without links every probability is 0."""

    categories: tuple[str, ...]
    vocabulary: list[str]
    links: list[LogisticRegressionModel]


def letter_words(text: Column) -> Column:
    """Distinct lower-case runs of letters; null counts as empty."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))


def _telling_words(rows: DataFrame, categories: tuple[str, ...], most: int) -> list[str]:
    """The words with the largest log-likelihood ratio against any category, from :data:`LEAST_RATIO` on."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    held = rows.select(F.explode("words").alias("word"), *categories).where("word != ''").groupBy("word")
    counts = held.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).where(F.col("n") >= SUPPORT)

    def ratio(c: str) -> Column:
        n, k = F.col("n").cast("double"), F.col(c).cast("double")
        cells = ((k, n * total[c] / total.n), (n - k, n * (total.n - total[c]) / total.n))
        rest = ((total[c] - k, (total.n - n) * total[c] / total.n), ((total.n - total[c]) - (n - k), (total.n - n) * (total.n - total[c]) / total.n))
        return sum((F.when((seen > 0) & (due > 0), seen * F.log(seen / due)).otherwise(F.lit(0.0)) for seen, due in (*cells, *rest)), F.lit(0.0))

    best = F.greatest(*[ratio(c) for c in categories]) if len(categories) > 1 else ratio(categories[0])
    found = counts.select("word", best.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    return sorted(row.word for row in found.orderBy(F.desc("ratio"), "word").limit(most).select("word").collect())


def _vectors(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(vocabulary or ["\u0000"], "_words", "_held").setBinary(True)
    return model.transform(rows)


def _inputs(rows: DataFrame, earlier: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=["_held", *earlier], outputCol="_inputs").transform(rows)


def _regression(label: str) -> LogisticRegression:
    return LogisticRegression(featuresCol="_inputs", labelCol=label, predictionCol="_said", rawPredictionCol="_raw", probabilityCol="_probability", regParam=0.002, maxIter=40)


def _probability(model: LogisticRegressionModel, rows: DataFrame, name: str) -> DataFrame:
    scored = model.transform(rows).withColumn(name, vector_to_array("_probability")[1])
    return scored.drop("_inputs", "_raw", "_probability", "_said")


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """A chain fitted on at most about ``sample`` of the documents that ``labels`` (``doc_id``, 0/1 categories) covers.

    Labels that are null leave their row out; of repeated labels of one document the largest counts. Without
    labelled documents the chain has no links; a category with one value only is predicted to have it.
    """
    known = labels.select("doc_id", *[F.col(c).cast("double").alias(c) for c in categories]).dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    total = known.count()
    mark = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000))
    chosen = known.where(mark < int(1_000_000 * min(1.0, sample / max(total, 1))))
    texts = docs.select(F.col("doc_id").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most about `sample` small rows
    # Of equal texts the largest labels and the smallest id: what is fitted does not depend on how rows are dealt.
    texts = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in categories])
    texts = texts.select("doc_id", letter_words(F.col("text")).alias("words"), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(folds)).alias("_fold"), *categories)
    texts = cut(texts.repartition(PARTITIONS, "doc_id").sortWithinPartitions("doc_id").drop("doc_id").coalesce(PARTITIONS))
    if texts.isEmpty():
        return Chain(categories, [], [])
    vocabulary = _telling_words(texts, categories, VOCABULARY)
    rows = cut(_vectors(texts.withColumnRenamed("words", "_words"), vocabulary).drop("_words"))
    links, earlier = [], []
    for number, category in enumerate(categories):
        rows = _inputs(rows, earlier)
        links.append(_regression(category).fit(rows))
        if number + 1 < len(categories):
            parts = [_probability(_regression(category).fit(rows.where(F.col("_fold") != k)), rows.where(F.col("_fold") == k), f"_p_{category}") for k in range(folds)]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            rows = cut(whole)
            earlier.append(f"_p_{category}")
    return Chain(categories, vocabulary, links)


def score(docs: DataFrame, chain: Chain, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, ``p_<category>`` and ``<category>`` as predicted (0 or 1).

    A null text counts as empty and gets the probabilities of a text without known words. Rows are neither joined
    nor shuffled, so nulls and repeats of the id are kept as they are. ``keep`` must not name an added column.
    """
    rows = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], letter_words(F.col(text_col)).alias("_words"))
    rows, earlier = _vectors(rows, chain.vocabulary).drop("_words"), []
    for category, link in zip(chain.categories, chain.links, strict=False):
        rows = _probability(link, _inputs(rows, earlier), f"_p_{category}")
        earlier.append(f"_p_{category}")
    p = {c: F.col(f"_p_{c}") if chain.links else F.lit(0.0) for c in chain.categories}
    added = [p[c].alias(f"p_{c}") for c in chain.categories] + [(p[c] >= THRESHOLD).cast("int").alias(c) for c in chain.categories]
    return rows.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], *added)
