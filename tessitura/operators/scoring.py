"""Pooled word and character error rates.

Edit counts are additive. They are computed once per pair, and every score,
share, reweighting and resample sums them instead of aligning again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.distance import char_distance, char_distances, word_distance, word_distances
from tessitura.functions.draws import SCALE, draw, pick
from tessitura.functions.text import BLANK_NEXT, SPACE, WHITE, scorer_normalise
from tessitura.functions.words import let, n_words
from tessitura.session import settled

EDITS = ["word_edits", "ref_words", "char_edits", "ref_chars"]


def _side(text: Column, case_sensitive: bool) -> Column:
    return F.btrim(scorer_normalise(text, case_sensitive), F.lit(WHITE))


def _single_spaced(text: Column) -> Column:
    """Text as the word metric sees it: runs of white space collapse, edges are gone, words lie between spaces."""
    return F.regexp_replace(text, BLANK_NEXT + SPACE + "{2,}", " ")


def edit_counts(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", case_sensitive: bool = False) -> DataFrame:
    """Add word and character edits and reference sizes to each (ref, hyp) pair.

    A missing hypothesis counts as empty; an empty reference is an error, since
    the rates divide by its length. Narrow: no shuffle; a batch of pairs is aligned
    at once.
    """
    kept = [c for c in pairs.columns if c not in (ref, hyp)]
    sides = pairs.select(*kept, _reference(F.col(ref), case_sensitive).alias("_r"), _hypothesis(F.col(hyp), case_sensitive).alias("_h"))
    spaced = sides.select(*kept, "_r", "_h", _single_spaced(F.col("_r")).alias("_rs"), _single_spaced(F.col("_h")).alias("_hs"))
    return spaced.select(
        *kept,
        word_distance(F.col("_rs"), F.col("_hs")).alias("word_edits"),
        n_words(F.col("_rs")).alias("ref_words"),
        char_distance(F.col("_r"), F.col("_h")).alias("char_edits"),
        F.length("_r").cast("bigint").alias("ref_chars"),
    )


def _reference(text: Column, case_sensitive: bool) -> Column:
    side = _side(text, case_sensitive)
    return let(side, lambda r: F.when(r == "", F.raise_error(F.lit("empty reference"))).otherwise(r))


def _hypothesis(text: Column, case_sensitive: bool) -> Column:
    return _side(F.coalesce(text, F.lit("")), case_sensitive)


def edit_counts_of(rows: DataFrame, variants: dict[str, Column], ref: str = "ref", name: str = "variant", case_sensitive: bool = False) -> DataFrame:
    """`edit_counts` of each row's reference and several hypotheses, one row per variant, named in column `name`.

    A row's texts are aligned together and leave as numbers: no text is copied, and a hypothesis that several variants
    share is aligned once.
    """
    kept = [c for c in rows.columns if c != ref]
    staged = settled(rows, {"_r": _reference(F.col(ref), case_sensitive)} | {f"_h{k}": _hypothesis(h, case_sensitive) for k, h in enumerate(variants.values())})
    staged = settled(staged, {"_rs": _single_spaced(F.col("_r"))})
    texts = [F.col(f"_h{k}") for k in range(len(variants))]
    counted = staged.select(
        *kept,
        word_distances(F.col("_rs"), F.array(*[_single_spaced(t) for t in texts])).alias("_w"),
        n_words(F.col("_rs")).alias("ref_words"),
        char_distances(F.col("_r"), F.array(*texts)).alias("_c"),
        F.length("_r").cast("bigint").alias("ref_chars"),
    )
    of = lambda k: (F.get("_w", F.lit(k)).alias("word_edits"), F.get("_c", F.lit(k)).alias("char_edits"))
    each = F.array(*[F.struct(F.lit(n).alias(name), *of(k)) for k, n in enumerate(variants)])
    return counted.select(*kept, "ref_words", "ref_chars", F.inline(each)).select(*kept, name, *EDITS)


def pool(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum edit counts per group."""
    return counts.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in EDITS])


def with_rates(pooled: DataFrame) -> DataFrame:
    """WER, CER and the combined score of summed edits; rates may exceed 1."""
    wer = F.col("word_edits") / F.col("ref_words")
    cer = F.col("char_edits") / F.col("ref_chars")
    return pooled.withColumns({"wer": wer, "cer": cer, "multi": 0.5 * (1 - wer) + 0.5 * (1 - cer)})


def pooled_score(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pooled score of each group: a ratio of sums, never a mean of ratios."""
    return with_rates(pool(counts, by))


def score_by_language(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per language plus `overall`, within each of the groups `by`.

    Grouping sets run over the per-language sums, so the rows are read and
    shuffled once, not once per set.
    """
    by = by or []
    sums = pool(counts, [*by, "lang"])
    cols = [F.col(c) for c in [*by, "lang"]]
    both = sums.groupingSets([cols, cols[:-1]], *cols).agg(
        F.grouping("lang").alias("_all"), *[F.sum(c).alias(c) for c in ["n", *EDITS]]
    )
    named = both.withColumn("lang", F.when(F.col("_all") == 1, "overall").otherwise(F.col("lang"))).drop("_all")
    return with_rates(named)


def word_share(counts: DataFrame) -> DataFrame:
    """Share of reference words per language: the weight each one carries in a pooled score."""
    sums = counts.groupBy("lang").agg(F.sum("ref_words").alias("ref_words"))
    return sums.withColumn("share", F.col("ref_words") / F.sum("ref_words").over(Window.partitionBy()))


def reweight_to_mix(scores: DataFrame, mix: DataFrame, mode: str = "exact", chars_per_word: float = 5.5) -> DataFrame:
    """The pooled score under another language mix (`lang, weight`).

    `exact` scales measured reference characters; `compat` assumes a constant
    number of characters per word, which does not cancel in the character rate.
    """
    words = F.col("ref_words") / F.col("n") * F.col("weight")
    if mode == "exact":
        chars = F.col("ref_chars") / F.col("n") * F.col("weight")
    elif mode == "compat":
        chars = words * chars_per_word
    else:
        raise ValueError(f"unknown mode {mode!r}")
    joined = scores.where(F.col("lang") != "overall").join(mix, "lang")
    rates = joined.agg(
        (F.sum(F.col("wer") * words) / F.sum(words)).alias("wer"),
        (F.sum(F.col("cer") * chars) / F.sum(chars)).alias("cer"),
    )
    return rates.withColumn("multi", 0.5 * (1 - F.col("wer")) + 0.5 * (1 - F.col("cer")))


def _interval(resampled: DataFrame, by: list[str], alpha: float) -> DataFrame:
    multi = 1 - 0.5 * F.col("we") / F.col("rw") - 0.5 * F.col("ce") / F.col("rc")
    return (
        resampled.where(F.col("rw") > 0)
        .withColumn("multi", multi)
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_boot"),
            F.percentile("multi", F.lit(alpha / 2)).alias("lo"),
            F.percentile("multi", F.lit(1 - alpha / 2)).alias("hi"),
        )
    )


def _poisson_steps(terms: int = 12) -> list[float]:
    """P(X <= k) of Poisson(1) for k < terms; the tail beyond is below one draw step."""
    steps, term, upto = [], math.exp(-1), 0.0
    for k in range(terms):
        upto += term
        steps.append(upto)
        term /= k + 1
    return steps


POISSON_STEPS = _poisson_steps()


def bootstrap_ci(counts: DataFrame, key: str, n_boot: int = 400, seed: int = 1337, alpha: float = 0.05, mode: str = "exact") -> DataFrame:
    """Percentile interval on the pooled score from resampled edit counts.

    `exact` draws n utterances with replacement per replicate. It is meant for a
    dev set, whose size is a parameter, and numbers its rows in one task.
    `poisson` weights every row independently with Poisson(1) counts, the limit of
    the same scheme: one pass, partial sums per replicate, any number of rows.
    """
    if mode == "poisson":
        # Leading hex digits of a draw sort as its value does; most draws are settled by two comparisons.
        digits = F.substring(draw(seed, F.col(key), F.col("rep")), 1, 8)
        cuts = [math.ceil(step * SCALE) for step in POISSON_STEPS]
        reached = [cut for cut in cuts if cut < SCALE]
        weight = F.when(F.col("_d") < F.lit(f"{reached[0]:08x}"), 0)
        for k, cut in enumerate(reached[1:], start=1):
            weight = weight.when(F.col("_d") < F.lit(f"{cut:08x}"), k)
        weight = weight.otherwise(len(reached))
        rows = counts.select(key, *EDITS, F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep"))
        rows = settled(rows, {"_d": digits}).withColumn("w", weight)
    elif mode == "exact":
        size = counts.agg(F.count("*")).scalar()
        numbered = counts.select(
            F.row_number().over(Window.orderBy(key)).alias("idx"), *EDITS, F.lit(1).alias("w")
        )
        grid = numbered.select(
            F.col("idx").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep")
        ).select("rep", pick(draw(seed, F.col("rep"), F.col("k")), 0, size).alias("idx"))
        rows = grid.join(numbered, "idx")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    sums = rows.groupBy("rep").agg(
        *[F.sum(F.col(c) * F.col("w")).alias(a) for c, a in zip(EDITS, ("we", "rw", "ce", "rc"))]
    )
    return _interval(sums, [], alpha)


def score_pairs(refs: DataFrame, hyps: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Matched pairs, and how many references found a hypothesis.

    Rows are counted per key instead of through an outer join: several scalars of one frame are merged by the
    planner, which then takes a column of an outer join for one without NULLs and counts every row.
    """
    pairs = refs.join(hyps, key)
    of = lambda df, r, h: df.select(key, F.lit(r).alias("_r"), F.lit(h).alias("_h"))
    per = of(refs, 1, 0).unionByName(of(hyps.where(F.col(key).isNotNull()), 0, 1)).groupBy(key).agg(F.sum("_r").alias("_r"), F.sum("_h").alias("_h"))
    coverage = per.agg(
        F.coalesce(F.sum(F.col("_r") * F.greatest("_h", F.lit(1))), F.lit(0)).alias("expected"),
        F.coalesce(F.sum(F.col("_r") * F.col("_h")), F.lit(0)).alias("matched"),
    ).withColumn("coverage", F.try_divide("matched", "expected"))
    return pairs, coverage


def plus_period_by_lang(scored: DataFrame, dotted: DataFrame) -> DataFrame:
    """Score before and after a trailing period, per language and overall."""
    base = score_by_language(scored).select("lang", F.col("multi").alias("base"))
    plus = score_by_language(dotted).select("lang", F.col("multi").alias("plus_period"))
    return base.join(plus, "lang").withColumn("delta", F.col("plus_period") - F.col("base"))
