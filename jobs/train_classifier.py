"""spark-submit jobs/train_classifier.py RESPONSES OUT_DIR: fits on the labelled responses (Parquet: response_id, text, label) and scores all. The model is at OUT_DIR/model (``SafetyClassifier.load``)."""

import sys

from pyspark.sql import SparkSession

from casesafety.operators import classifier


def main(path: str, out: str) -> None:
    spark = SparkSession.builder.appName("train_classifier").getOrCreate()
    responses = spark.read.parquet(path)
    fitted = classifier.fit_safety_classifier(responses)
    fitted.save(f"{out}/model")
    classifier.predict_safety(fitted, responses).write.parquet(f"{out}/predictions")


if __name__ == "__main__":
    main(*sys.argv[1:])
