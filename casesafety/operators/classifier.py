"""TF-IDF and balanced, L2-regularised logistic regression over response texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import vocabulary_of_texts, with_terms


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): weight = rows / (classes * rows of the class)."""
    per = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return per.join(F.broadcast(whole)).select("label", "n", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))


def fit_guard(df: DataFrame, label: str = "label") -> None:
    """Refuses to train without labels or with one class only."""
    if df.where(F.col(label).isNotNull()).agg(F.count_distinct(label)).first()[0] < 2:
        raise ValueError("training needs expert labels of at least two classes")


@dataclass(frozen=True)
class SafetyClassifier:
    words: CountVectorizerModel
    idf: ElementwiseProduct
    model: LogisticRegressionModel

    def features(self, df: DataFrame, text: str = "text") -> DataFrame:
        counted = self.words.transform(with_terms(df, text))
        return Normalizer(inputCol="weighted", outputCol="features", p=2.0).transform(self.idf.transform(counted)).drop("terms", "counts", "weighted")

    def save(self, path: str) -> None:
        """Writes the three fitted parts below ``path``, over what is there."""
        for name, part in (("words", self.words), ("idf", self.idf), ("regression", self.model)):
            part.write().overwrite().save(f"{path}/{name}")

    @staticmethod
    def load(path: str) -> SafetyClassifier:
        return SafetyClassifier(CountVectorizerModel.load(f"{path}/words"), ElementwiseProduct.load(f"{path}/idf"), LogisticRegressionModel.load(f"{path}/regression"))


def fit_safety_classifier(df: DataFrame, text: str = "text", label: str = "label", id_col: str = "response_id", min_df: int = 2, max_features: int = 30000, max_iter: int = 3000, tol: float = 1e-5) -> SafetyClassifier:
    """Fits on the labelled rows. Only the vocabulary, of at most ``max_features`` terms, passes through the driver."""
    fit_guard(df, label)
    rows = df.where(F.col(label).isNotNull())
    terms = [r["term"] for r in vocabulary_of_texts(rows, id_col, text, min_df=min_df, max_features=max_features).orderBy("idx").select("term").collect()]
    words = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="counts")
    # Counted once, for the document frequencies and the fit; the weighted rows are small, so few partitions do.
    counted = words.transform(with_terms(rows, text)).select(F.col(label).alias("label"), "counts").persist()
    smooth = IDF(inputCol="counts", outputCol="idf").fit(counted).idf.toArray() + 1.0
    idf = ElementwiseProduct(scalingVec=Vectors.dense(smooth), inputCol="counts", outputCol="weighted")
    scaled = Normalizer(inputCol="weighted", outputCol="features", p=2.0).transform(idf.transform(counted))
    weighted = scaled.join(F.broadcast(class_weights(rows, label).withColumnRenamed("label", "class")), F.col("label") == F.col("class")).select(F.col("label").cast("double").alias("label"), "features", "weight")
    n = counted.count()
    weighted = weighted.coalesce(max(1, min(weighted.rdd.getNumPartitions(), n // 500))).persist()
    lr = LogisticRegression(maxIter=max_iter, tol=tol, weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, standardization=False)
    model = lr.fit(weighted)
    weighted.unpersist()
    counted.unpersist()
    return SafetyClassifier(words, idf, model)


def predict_safety(fitted: SafetyClassifier, df: DataFrame, text: str = "text", id_col: str = "response_id") -> DataFrame:
    """(id, predicted, probability) with the probability of class 1."""
    out = fitted.model.transform(fitted.features(df, text))
    return out.select(id_col, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("probability"))


def out_of_fold(df: DataFrame, cluster: str, folds: int = 5, text: str = "text", label: str = "label", id_col: str = "response_id", **fit) -> DataFrame:
    """(id, fold, label, probability, calibrated) of the labelled rows, each from a fit that saw no row of its cluster.

    A cluster is in one fold, by a hash of it; rows without a cluster go by their id. ``calibrated`` is the isotonic curve of label by probability, fitted over the rows of
    the other folds. A fold whose other rows have one class only is an error (``fit_guard``).
    """
    key = F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("id "), F.col(id_col).cast("string")))
    rows = df.where(F.col(label).isNotNull()).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")).persist()
    scored = None
    for k in range(folds):
        held = rows.where(F.col("fold") == k)
        if held.isEmpty():
            continue
        fitted = fit_safety_classifier(rows.where(F.col("fold") != k), text, label, id_col, **fit)
        mine = predict_safety(fitted, held, text, id_col).join(held.select(id_col, "fold", F.col(label).cast("double").alias("label")), id_col)
        scored = mine if scored is None else scored.unionByName(mine)
    scored = scored.persist()
    out = None
    for k in [r[0] for r in scored.select("fold").distinct().orderBy("fold").collect()]:
        curve = IsotonicRegression(featuresCol="probability", labelCol="label", predictionCol="calibrated").fit(scored.where(F.col("fold") != k))
        mine = curve.transform(scored.where(F.col("fold") == k)).select(id_col, "fold", F.col("label").cast("int").alias("label"), "probability", "calibrated")
        out = mine if out is None else out.unionByName(mine)
    rows.unpersist()
    return out
