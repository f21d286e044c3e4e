"""Statistics of array-valued rows: frame logits and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.words import let

FORBIDDEN = -1e9  # fixed value: finite, so that a softmax over it stays defined
NO_SPEECH = -20.0  # fixed value


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def log_softmax(logits: Column) -> Column:
    xs = F.transform(logits, lambda x: x.cast("double"))
    return let(
        xs,
        lambda v: let(
            F.array_max(v), lambda m: let(m + F.log(_sum(F.transform(v, lambda x: F.exp(x - m)))), lambda z: F.transform(v, lambda x: x - z))
        ),
    )


def frame_stats(frames: DataFrame, logits: str = "logits") -> DataFrame:
    """Per frame: best log probability, its index from 0, and the negative entropy."""
    lp = frames.withColumn("_lp", log_softmax(F.col(logits)))
    return lp.select(
        *[c for c in frames.columns if c != logits],
        F.array_max("_lp").alias("top"),
        (F.array_position(F.col("_lp"), F.array_max("_lp")) - 1).alias("arg"),
        _sum(F.transform("_lp", lambda x: F.exp(x) * x)).alias("neg_entropy"),
    )


def posterior_confidence(frames: DataFrame, by: list[str], blank_id: int = 0, logits: str = "logits") -> DataFrame:
    """Four router scores per clip: mean best log probability, the same without blank frames,
    mean negative entropy, and the share of blank frames."""
    stats = frame_stats(frames, logits)
    speech = F.col("arg") != blank_id
    return stats.groupBy(*by).agg(
        F.count("*").alias("frames"),
        F.avg("top").alias("mean_lp"),
        F.coalesce(F.avg(F.when(speech, F.col("top"))), F.lit(NO_SPEECH)).alias("mean_lp_nb"),
        F.avg("neg_entropy").alias("neg_entropy"),
        F.avg(F.when(speech, 0.0).otherwise(1.0)).alias("blank_frac"),
    )


def mask_and_argmax(frames: DataFrame, forbidden: list[int], logits: str = "logits", keep: Column | None = None) -> DataFrame:
    """Argmax after forbidden label columns are masked; frames outside `keep` (padding) are dropped."""
    masked = F.transform(
        logits, lambda x, i: F.when(i.isin(*forbidden), F.lit(FORBIDDEN)).otherwise(x.cast("double"))
    )
    rows = frames if keep is None else frames.where(keep)
    return rows.withColumn("_m", masked).select(
        *[c for c in frames.columns if c != logits],
        (F.array_position(F.col("_m"), F.array_max("_m")) - 1).alias("arg"),
        F.array_max("_m").alias("value"),
    )


def signal_profile(clips: DataFrame, samples: str = "samples", rate: int = 16000) -> DataFrame:
    """Per clip: samples, seconds, root mean square, peak."""
    xs = F.transform(samples, lambda x: x.cast("double"))
    return clips.select(
        *[c for c in clips.columns if c != samples],
        F.size(samples).cast("bigint").alias("n_samples"),
        (F.size(samples) / F.lit(rate)).alias("seconds"),
        F.sqrt(_sum(F.transform(xs, lambda x: x * x)) / F.size(samples)).alias("rms"),
        F.array_max(F.transform(xs, lambda x: F.abs(x))).alias("peak"),
    )


def duration_summary(profiled: DataFrame, by: list[str], short_seconds: float = 2.0) -> DataFrame:
    """Minimum, median and maximum duration; `short` flags a median below the limit."""
    sums = profiled.groupBy(*by).agg(
        F.count("*").alias("clips"),
        F.min("seconds").alias("min_seconds"),
        F.percentile("seconds", F.lit(0.5)).alias("median_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.avg("rms").alias("mean_rms"),
        F.max("peak").alias("peak"),
    )
    return sums.withColumn("short", F.col("median_seconds") < short_seconds)
