"""Crowd estimation and the two forest models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.score import clip

FEATURES = ["month", "day_of_week", "weekend", "signal_known"]
#: Trees of a forest, and the seed of its draws.
TREES, SEED = 200, 42
#: Share of the rows that are held out.
HELD_OUT = 0.2


def estimate(places: DataFrame, days: DataFrame, festivals: DataFrame, by_category: dict[str, float], peak_months: list[int]) -> DataFrame:
    """Crowd level in 0..1 of each place on each of a few days.

    A festival on the day counts more than one in the month. Festivals join by district and day, and by district
    and month, after being reduced to one row per key; statewide ones join by day or month alone.
    """
    grid = places.join(F.broadcast(days), how="cross").withColumn("month_no", F.month("day").cast("long"))
    local, wide = festivals.where("district IS NOT NULL"), festivals.where("district IS NULL")
    flags = []
    for name, rows, source, target in (
        ("on_day", local, ["district", "start_date"], ["district", "day"]),
        ("wide_day", wide, ["start_date"], ["day"]),
        ("in_month", local, ["district", "month"], ["district", "month_no"]),
        ("wide_month", wide, ["month"], ["month_no"]),
    ):
        keys = rows.select(*[F.col(s).alias(t) for s, t in zip(source, target, strict=True)]).where(F.col(target[-1]).isNotNull()).distinct().withColumn(name, F.lit(True))
        grid = grid.join(keys, target, "left")
        flags.append(name)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    festive = F.when(yes("on_day") | yes("wide_day"), 0.25).when(yes("in_month") | yes("wide_month"), 0.10).otherwise(0.0)
    category = F.lit(0.0)
    for name, weight in by_category.items():
        category = F.when(F.col("category_name") == name, weight).otherwise(category)
    level = 0.15 + F.when(F.weekday("day") >= 5, 0.25).otherwise(0.0) + F.when(F.col("month_no").isin(peak_months), 0.15).otherwise(0.0) + festive + category
    return grid.withColumn("crowd_level", clip(level, 0.0, 1.0)).drop(*flags)


def features(log: DataFrame) -> DataFrame:
    """Calendar features of status rows; missing signals count as zero."""
    day = F.weekday("checked_at")
    return log.select(
        "status_id", F.month("checked_at").alias("month"), day.alias("day_of_week"), (day >= 5).alias("is_weekend"), (day >= 5).cast("double").alias("weekend"),
        F.coalesce(F.col("suitability_score"), F.lit(0.0)).alias("signal"), F.col("suitability_score").isNotNull().cast("double").alias("signal_known"),
    )


def train(df: DataFrame) -> PipelineModel:
    """A random forest with class weights against imbalance; ``df`` has the features and ``label``."""
    known = df.dropna(subset=[*FEATURES, "label"])
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    weights = counts.join(total, how="cross").select("label", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))
    rows = known.join(F.broadcast(weights), "label")  # a row per class
    indexer = StringIndexer(inputCol="label", outputCol="label_no", stringOrderType="alphabetAsc", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label_no", weightCol="weight", numTrees=TREES, seed=SEED)
    indexed = indexer.fit(rows)
    back = IndexToString(inputCol="prediction", outputCol="prediction_label", labels=indexed.labels)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), indexed, forest, back]).fit(rows)


def split(df: DataFrame, key: str, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and rows held out, by a hash of ``key``, so that any run splits alike.

    With a ``label`` each class is split in the order of the hash, so that all have their share on either side.
    """
    h = F.xxhash64(F.lit(SEED), key)
    if label is None:
        marked = df.withColumn("_held", F.pmod(h, F.lit(1000)) < int(1000 * HELD_OUT))
    else:
        bounds = df.groupBy(label).agg(F.percentile_approx(h, HELD_OUT, 10_000).alias("_bound"))
        marked = df.join(F.broadcast(bounds), label, "left").withColumn("_held", F.coalesce(h <= F.col("_bound"), F.lit(False))).drop("_bound")
    return marked.where("NOT _held").drop("_held"), marked.where("_held").drop("_held")


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted class, its probability to four places, and the probability of every class."""
    out = model.transform(df)
    labels = model.stages[1].labels
    all_of = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.transform(F.slice(vector_to_array("probability"), 1, len(labels)), lambda p: F.round(p, 4)))
    return out.withColumn("confidence", F.round(F.array_max(vector_to_array("probability")), 4)).withColumn("probabilities", all_of)


def regress(train: DataFrame, test: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``test`` with the prediction of a forest that was fitted on ``train``."""
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=TREES, seed=SEED)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), forest]).fit(train.dropna(subset=[*columns, target]))
    return model.transform(test.dropna(subset=[*columns, target]))


def regression_report(guessed: DataFrame, target: str) -> DataFrame:
    """Mean absolute error and share of the variance explained, in one row."""
    off = F.col(target) - F.col("prediction")
    return guessed.agg(F.round(F.avg(F.abs(off)), 4).alias("mae"), F.round(1 - F.sum(off * off) / F.nullif(F.var_pop(target) * F.count(target), F.lit(0.0)), 4).alias("r2"))


def report(guesses: DataFrame) -> DataFrame:
    """``truth, guess, n`` for each pair that occurs, with the accuracy and the mean F1 of all classes."""
    pairs = guesses.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    both = evaluate(guesses)
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    total = both.agg(F.round(F.avg(f1), 4).alias("f1"))
    hits = pairs.agg(F.round(F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("accuracy"))
    return pairs.join(F.broadcast(hits), how="cross").join(F.broadcast(total), how="cross")  # a row each


def evaluate(guesses: DataFrame) -> DataFrame:
    """Support, precision and recall of each class from ``truth, guess``; one pass over counts of pairs."""
    pairs = guesses.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array_distinct(F.array("truth", "guess"))).alias("label"), "truth", "guess", "n")
    hit = F.when((F.col("label") == F.col("truth")) & (F.col("label") == F.col("guess")), F.col("n")).otherwise(0)
    of = lambda c: F.sum(F.when(F.col("label") == F.col(c), F.col("n")).otherwise(0))
    ratio = lambda c: F.round(F.coalesce(F.sum(hit) / F.nullif(of(c), F.lit(0)), F.lit(0.0)), 4)
    return sides.groupBy("label").agg(of("truth").alias("support"), ratio("guess").alias("precision"), ratio("truth").alias("recall"))
