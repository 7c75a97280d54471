"""Object detections: decode, unnest, filter, best score and name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.once import computed_once

# Payload layout, score threshold, and the 80 class names by class number.
PAYLOAD_SCHEMA = (
    "struct<fragmentMetaData: string, frameMetaData: string, streamName: string, sageMakerOutput: string>"
)
PREDICTION_SCHEMA = "struct<prediction: array<array<double>>>"
SCORE_THRESHOLD = 0.15
OBJECT_NAMES = (
    "person", "bicycle", "car", "motorbike", "aeroplane", "bus", "train", "truck", "boat",
    "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat",
    "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack",
    "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball",
    "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket",
    "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair",
    "sofa", "pottedplant", "bed", "diningtable", "toilet", "tvmonitor", "laptop", "mouse",
    "remote", "keyboard", "cell phone", "microwave", "oven", "toaster", "sink",
    "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier",
    "toothbrush",
)


def base64_text(text: Column) -> Column:
    """Text in base64, null if it is not base64 of UTF-8."""
    return F.try_validate_utf8(F.try_to_binary(text, F.lit("base64")).cast("string"))


def decode_payload(df: DataFrame, col: str = "payload", keep_payload: bool = False) -> DataFrame:
    """Replace a base64 payload by ``fragment, frame, stream_name, prediction``; other columns are kept.

    A payload that does not decode gives nulls. ``keep_payload`` keeps it too.
    """
    outer = F.from_json(base64_text(F.col(col)), PAYLOAD_SCHEMA)
    inner = F.from_json(base64_text(F.col("_p.sageMakerOutput")), PREDICTION_SCHEMA)
    keep = [c for c in df.columns if keep_payload or c != col]
    decoded = computed_once(computed_once(df, "_p", outer), "_q", inner)
    return decoded.select(
        *keep,
        F.col("_p.fragmentMetaData").alias("fragment"),
        F.col("_p.frameMetaData").alias("frame"),
        F.col("_p.streamName").alias("stream_name"),
        F.col("_q.prediction").alias("prediction"),
    )


def explode_predictions(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row ``(class, score)`` per prediction; other columns are kept."""
    keep = [c for c in df.columns if c != prediction]
    return df.select(*keep, F.explode(prediction).alias("_p")).select(
        *keep, F.get("_p", F.lit(0)).alias("class"), F.get("_p", F.lit(1)).alias("score")
    )


def _above(score: Column, threshold: float) -> Column:
    # Spark orders NaN above all numbers.
    return (score > threshold) & ~F.isnan(score)


def score_threshold(df: DataFrame, score: str = "score", threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Rows whose score is strictly above the threshold; NaN is not."""
    return df.filter(_above(F.col(score), threshold))


def best_score_per_class(
    df: DataFrame,
    keys: Sequence[str],
    class_col: str = "class",
    score: str = "score",
    threshold: float = SCORE_THRESHOLD,
) -> DataFrame:
    """Highest score above the threshold per record and class.

    Filter and partial maximum run before the shuffle.
    """
    kept = score_threshold(df, score, threshold)
    return kept.groupBy(*keys, class_col).agg(F.max(score).alias(score))


def best_scores_in_record(
    df: DataFrame, prediction: str = "prediction", threshold: float = SCORE_THRESHOLD
) -> DataFrame:
    """Same result as :func:`best_score_per_class`, while predictions are still an array.

    A record holds all its predictions, so the maximum is taken inside the row and
    nothing is shuffled.
    """
    keep = [c for c in df.columns if c != prediction]
    above = F.filter(prediction, lambda p: _above(F.get(p, F.lit(1)), threshold))
    # Sorted by class and score, the last of each run of a class is its best.
    pairs = F.transform(above, lambda p: F.struct(F.get(p, F.lit(0)).alias("class"), F.get(p, F.lit(1)).alias("score")))
    after = F.get("_pairs", F.col("_at") + 1)
    last = after.isNull() | ~after["class"].eqNullSafe(F.col("_pair.class"))
    return (
        computed_once(df.select(*keep, prediction), "_pairs", F.array_sort(pairs))
        .select(*keep, "_pairs", F.posexplode("_pairs").alias("_at", "_pair"))
        .filter(last)
        .select(*keep, "_pair.class", "_pair.score")
    )


def label_lookup(
    df: DataFrame,
    class_col: str = "class",
    labels: Sequence[str] | DataFrame = OBJECT_NAMES,
    name_col: str = "class_name",
) -> DataFrame:
    """Add the name of a class number; unknown numbers keep a null name.

    A list of names is as small as the program text, so it is broadcast. A table
    ``(class_id, name)`` has no known size: Spark decides from its statistics, and
    adaptive execution splits hot classes if both sides are large.
    """
    if isinstance(labels, DataFrame):
        names = labels.select(labels[labels.columns[0]].alias("_class_id"), labels[labels.columns[1]].alias(name_col))
    else:
        names = F.broadcast(
            df.sparkSession.range(1).select(
                F.posexplode(F.array(*[F.lit(n) for n in labels])).alias("_class_id", name_col)
            )
        )
    number = F.col(class_col).try_cast("int")
    return df.join(names, number == F.col("_class_id"), "left").drop("_class_id")


def batch_record_count(df: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Records handled per batch."""
    return df.groupBy(*batch).agg(F.count("*").alias("records"))
