"""Text classifier, topic model and vocabulary on MLlib."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, PCA, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import fixed
from presswork.operators.tables import top_n


def fit_classifier(train: DataFrame, body: str, label: str, weight: str | None = None, features: int = 1 << 14) -> PipelineModel:
    """Bag-of-words logistic regression; two or more classes, optional row weights."""
    lr = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=30, regParam=0.01)
    if weight:
        lr = lr.setWeightCol(weight)
    stages = [
        RegexTokenizer(inputCol=body, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_x", minDocFreq=2), lr,
    ]
    return Pipeline(stages=stages).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with ``probs`` (an array), ``p`` of class 1 and ``pred``."""
    out = model.transform(df).withColumn("probs", vector_to_array("probability"))
    return out.select(*df.columns, "probs", F.col("probs")[1].alias("p"), F.col("prediction").cast("int").alias("pred"))


def fit_topics(df: DataFrame, vector: str, k: int, seed: int = 42) -> PipelineModel:
    """k-means over unit vectors: the clusters play the topics."""
    return Pipeline(stages=[Normalizer(inputCol="v", outputCol="u"), KMeans(featuresCol="u", predictionCol="topic_id", k=k, seed=seed)]).fit(
        df.withColumn("v", array_to_vector(F.col(vector).cast("array<double>"))))


def assign_topics(model: PipelineModel, df: DataFrame, vector: str, noise_below: float) -> DataFrame:
    """topic_id with the cosine to its centre as topic_prob; below the bound the topic is -1, noise."""
    centres = [[float(x) for x in c] for c in model.stages[-1].clusterCenters()]
    out = model.transform(df.withColumn("v", array_to_vector(F.col(vector).cast("array<double>"))))
    u = vector_to_array("u")
    c = F.element_at(F.array(*[F.array(*[F.lit(x) for x in row]) for row in centres]), F.col("topic_id") + 1)
    dot = F.aggregate(F.zip_with(u, c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    p = F.coalesce(F.try_divide(dot, norm), F.lit(0.0))
    return out.select(*df.columns, F.when(p < noise_below, -1).otherwise(F.col("topic_id")).alias("topic_id"), p.alias("topic_prob"))


def project_plane(df: DataFrame, vector: str) -> DataFrame:
    """Two principal components, for maps."""
    v = df.withColumn("v", array_to_vector(F.col(vector).cast("array<double>")))
    m = PCA(k=2, inputCol="v", outputCol="xy").fit(v)
    xy = vector_to_array("xy")
    return m.transform(v).select(*df.columns, xy[0].alias("x"), xy[1].alias("y"))


def english_stop_words() -> list[str]:
    """Common English words and those of page furniture, united."""
    return sorted({*fixed.ENGLISH_STOP, *fixed.TOPIC_STOP})


def term_arrays(df: DataFrame, body: str, stop: list[str] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``terms``: 1- to 3-grams of lower-case words, without the stop words and the extra ones."""
    banned = sorted({*(stop if stop is not None else StopWordsRemover.loadDefaultStopWords("english")), *extra})
    words = F.filter(F.split(F.lower(F.col(body)), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*banned))
    grams = lambda w, n: F.when(F.size(w) >= n, F.transform(
        F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    # bound once, so that a text is cut a single time
    return df.withColumn("terms", F.transform(F.array(words), lambda w: F.concat(w, grams(w, 2), grams(w, 3)))[0])


def ngram_vocabulary(df: DataFrame, body: str, min_df: int, max_df: float, stop: list[str] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(term, n): 1- to 3-grams and the documents they stand in, at least ``min_df`` and at most the share ``max_df`` of all.

    A distributed count with no bound on the vocabulary. Null texts are no documents.
    """
    d = df.where(F.col(body).isNotNull())
    most = d.agg(F.count(F.lit(1)) * max_df).scalar()
    each = term_arrays(d, body, stop, extra).select(F.explode(F.array_distinct("terms")).alias("term"))
    n = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return n.where((F.col("n") >= min_df) & (F.col("n") <= most))


def class_terms(df: DataFrame, topic: str, body: str, top: int = 10, stop: list[str] | None = None) -> DataFrame:
    """(topic, term, weight, rank): the terms that tell a topic from the others.

    Weight is a term's share of its topic's terms times log(1 + mean terms a topic / uses
    of the term in all topics).
    """
    each = term_arrays(df.where(F.col(body).isNotNull() & F.col(topic).isNotNull()), body, stop).select(topic, F.explode("terms").alias("term"))
    n = each.groupBy(topic, "term").agg(F.count(F.lit(1)).alias("n"))
    per_topic = n.groupBy(topic).agg(F.sum("n").alias("all"))
    per_term = n.groupBy("term").agg(F.sum("n").alias("uses"))
    mean = per_topic.agg(F.avg("all")).scalar()
    w = n.join(per_topic, topic).join(per_term, "term").select(
        topic, "term", (F.col("n") / F.col("all") * F.log(1 + mean / F.col("uses"))).alias("weight"))
    return top_n(w, [topic], [F.desc(F.round("weight", 12)), F.col("term")], top, "rank")


def density_noise(df: DataFrame, key: str, vector: str, topic: str, least: int = 10, reach: float = 0.35, seed: int = 42, planes: int = 12) -> DataFrame:
    """The rows with ``dense``: whether at least ``least`` rows of their topic lie in the same or a next cell.

    Cells are signs of random planes of the unit vector (fixed by ``seed``); a row counts
    the rows of its own cell and of the cells beyond the one plane it lies nearest to, if
    within ``reach``. Counted per cell, so no topic is gathered.
    """
    size = df.select(F.size(vector).alias("n")).where("n > 0").limit(1).collect()
    if not size:
        return df.withColumn("dense", F.lit(False))
    rng = random.Random(seed)
    axes = [[rng.gauss(0, 1) for _ in range(size[0]["n"])] for _ in range(planes)]
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda a: F.try_divide(F.aggregate(F.zip_with(v, F.array(*[F.lit(x) for x in a]), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x), norm)
    d = df.withColumn("_d", F.array(*[dot(a) for a in axes]))
    bits = lambda a: F.aggregate(F.transform(a, lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x).cast("long")
    near = F.array_position(F.transform("_d", F.abs), F.array_min(F.transform("_d", F.abs))) - 1
    d = d.withColumns({"_cell": bits(F.col("_d")), "_next": F.when(F.array_min(F.transform("_d", F.abs)) <= reach, near)})
    cells = d.groupBy(topic, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    flip = F.col("_cell").bitwiseXOR(F.expr("shiftleft(1L, cast(_next as int))"))
    out = d.withColumn("_other", flip)
    other = cells.select(F.col(topic).alias("_t"), F.col("_cell").alias("_c"), F.col("_n").alias("_m"))
    out = out.join(cells, [topic, "_cell"]).join(other, (F.col(topic) == F.col("_t")) & (F.col("_other") == F.col("_c")), "left")
    return out.withColumn("dense", F.col("_n") + F.coalesce("_m", F.lit(0)) > least).select(*df.columns, "dense")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_embedder(df: DataFrame, body: str, size: int = 64) -> PipelineModel:
    """Unit document vectors: hashed, idf-weighted words projected on principal components."""
    stages = [
        RegexTokenizer(inputCol=body, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=1 << 10),
        IDF(inputCol="_tf", outputCol="_x"), PCA(k=size, inputCol="_x", outputCol="_p"), Normalizer(inputCol="_p", outputCol="embedding"),
    ]
    return Pipeline(stages=stages).fit(df)
