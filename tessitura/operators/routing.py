"""Language routing: deciding, measuring, comparing.

Scores are long tables `utt_id, model_lang, rule, score`. A per-utterance argmax is
an aggregate (largest score, then earliest language), so map tasks reduce their own
rows first and no window sorts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lang_order(lang: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), lang).cast("int")


def argmax_route(scores: DataFrame, order: list[str], by: tuple[str, ...] = ("utt_id",), score: str = "score") -> DataFrame:
    """Best-scoring language per utterance; ties go to the first in `order`."""
    best = F.max(F.struct(F.col(score).alias("s"), (-lang_order(F.col("model_lang"), order)).alias("o"), F.col("model_lang").alias("l")))
    chosen = scores.groupBy(*by).agg(best.alias("b"))
    return chosen.select(*by, F.col("b.l").alias("lang"), F.col("b.s").alias("score"))


def best_label(scores: dict[str, Column], order: list[str]) -> Column:
    """`argmax_route` of a row that holds all its scores, as a struct `lang, score`."""
    ranked = [F.struct(scores[lg].alias("score"), F.lit(-k).alias("_o"), F.lit(lg).alias("lang")) for k, lg in enumerate(order) if lg in scores]
    if not ranked:
        return F.lit(None).cast("struct<lang:string,score:double>")
    best = F.array_max(F.array(*ranked))
    return F.struct(best["lang"].alias("lang"), best["score"].alias("score"))


def open_vs_closed_route(scores: DataFrame, open_set: list[str], closed_set: list[str]) -> DataFrame:
    """Two argmaxes over one pass of the same scores: `utt_id, open_lang, closed_lang` and their scores."""

    def best(langs: list[str], name: str) -> Column:
        rank = F.struct(F.col("score").alias("s"), (-lang_order(F.col("model_lang"), langs)).alias("o"), F.col("model_lang").alias("l"))
        return F.max(F.when(F.col("model_lang").isin(*langs), rank)).alias(name)

    both = scores.groupBy("utt_id").agg(best(open_set, "o"), best(closed_set, "c"))
    return both.select(
        "utt_id",
        F.col("o.l").alias("open_lang"),
        F.col("o.s").alias("open_score"),
        F.col("c.l").alias("closed_lang"),
        F.col("c.s").alias("closed_score"),
    )


def zscore_rules(scores: DataFrame) -> DataFrame:
    """Standardise each model's scores per rule (population sigma; a constant score divides by 1).

    The statistics are one row per model and rule: two aggregates and a small join
    instead of a window that would gather a model's rows in one task.
    """
    stats = scores.groupBy("model_lang", "rule").agg(
        F.avg("score").alias("_mu"), F.stddev_pop("score").alias("_sd")
    )
    joined = scores.join(F.broadcast(stats), ["model_lang", "rule"])
    sd = F.when(F.col("_sd") < 1e-9, 1.0).otherwise(F.col("_sd"))
    return joined.select(
        "utt_id", "model_lang", F.concat(F.lit("z:"), F.col("rule")).alias("rule"), ((F.col("score") - F.col("_mu")) / sd).alias("score")
    )


def topk_labels(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k likeliest labels per utterance with softmax probabilities; labels are one array per row."""
    ranked = scores.groupBy("utt_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("score").alias("s"), F.col("model_lang").alias("l"))), asc=False).alias("a")
    )
    top = F.get(F.col("a"), F.lit(0))["s"]
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + F.exp(x["s"] - top))
    staged = ranked.select("utt_id", "a", top.alias("_top"), total.alias("_z"))
    return staged.select("utt_id", "_top", "_z", F.posexplode(F.slice("a", 1, k)).alias("pos", "x")).select(
        "utt_id",
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("x.l").alias("label"),
        (F.exp(F.col("x.s") - F.col("_top")) / F.col("_z")).alias("prob"),
    )


def target_share(top: DataFrame, targets: list[str]) -> DataFrame:
    """How often the first label is one of the targets."""
    return top.where(F.col("rank") == 1).agg(
        F.count("*").alias("n"), F.count_if(F.col("label").isin(*targets)).alias("in_target")
    ).withColumn("share", F.col("in_target") / F.col("n"))


def accuracy(routes: DataFrame, truth: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Share of labelled utterances routed right; an unrouted one counts as wrong. Rows of `truth` count once, or `weight` times."""
    by = by or []
    w = F.lit(1) if weight is None else F.col(weight)
    joined = routes.select("utt_id", *by, F.col("lang").alias("pred")).join(
        truth.select("utt_id", F.col("lang").alias("truth"), w.cast("bigint").alias("_w")), "utt_id"
    )
    sums = joined.groupBy(*by).agg(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("_w")).otherwise(0)).alias("hits"))
    n = truth.agg(F.coalesce(F.sum(w.cast("bigint")), F.lit(0))).scalar()
    return sums.withColumn("n", n).withColumn("accuracy", F.col("hits") / F.col("n"))


def rank_rules(routes: DataFrame, truth: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """Rules by measured accuracy, ties in the declared order; one row per rule."""
    acc = accuracy(routes, truth, ["rule"], weight)
    window = Window.orderBy(F.desc("hits"), lang_order(F.col("rule"), order))
    return acc.withColumn("rank", F.row_number().over(window))


def vote_route(routes: DataFrame, ranks: DataFrame, third: DataFrame, covered: list[str]) -> DataFrame:
    """Two best rules and a third voter that abstains when it cannot name the first choice.

    Two equal votes win, else the best rule stands. `routes` holds `utt_id, rule,
    lang`, `third` holds `utt_id, lang`, `covered` is what the third voter can say.
    """
    two = routes.join(ranks.where(F.col("rank") <= 2).select("rule", "rank"), "rule")
    wide = two.groupBy("utt_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("lang"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("lang"))).alias("second"),
    )
    joined = wide.join(third.select("utt_id", F.col("lang").alias("third")), "utt_id", "left")
    votes = F.col("first").isin(*covered) & F.col("third").isNotNull()
    agreed = (
        F.when(F.col("first") == F.col("second"), F.col("first"))
        .when(votes & (F.col("third") == F.col("first")), F.col("first"))
        .when(votes & (F.col("third") == F.col("second")), F.col("second"))
        .otherwise(F.col("first"))
    )
    return joined.select("utt_id", agreed.alias("lang"), (~votes).alias("abstained"))


def confusion(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Counts per (true, predicted) pair with the row's recall share."""
    counted = pairs.groupBy(F.col(truth).alias("truth"), F.coalesce(F.col(pred), F.lit("??")).alias("pred")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("truth"))
    return counted.select("truth", "pred", "n", (F.col("n") / total).alias("share"))


def recall(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Per class: support, hits, recall; plus one `overall` row with the accuracy."""
    per = confusion(pairs, truth, pred).withColumn("hits", F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    rolled = per.rollup("truth").agg(F.sum("n").alias("support"), F.sum("hits").alias("hits"))
    return rolled.select(F.coalesce("truth", F.lit("overall")).alias("truth"), "support", "hits", (F.col("hits") / F.col("support")).alias("recall"))


def top_confusions(pairs: DataFrame, k: int = 3, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """The k most frequent wrong answers per class; ties alphabetical."""
    wrong = confusion(pairs, truth, pred).where(F.col("truth") != F.col("pred"))
    order = Window.partitionBy("truth").orderBy(F.desc("n"), "pred")
    return wrong.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def high_confidence_errors(pairs: DataFrame, k: int = 12, truth: str = "truth", pred: str = "pred", score: str = "score") -> DataFrame:
    """The k errors with the highest score of the wrong answer."""
    return pairs.where(F.col(truth) != F.col(pred)).orderBy(F.desc(score), "utt_id").limit(k)


def router_agreement(routes: DataFrame) -> DataFrame:
    """Agreement of every pair of routers over the ids both answered.

    `routes` holds `router, utt_id, lang`. The answers to one id are one array, at
    most one entry per router, and pairs are formed inside it.
    """
    per = routes.groupBy("utt_id").agg(F.sort_array(F.collect_list(F.struct("router", "lang"))).alias("a"))
    pairs = F.flatten(
        F.transform(
            "a",
            lambda x: F.transform(
                F.filter("a", lambda y: x["router"] < y["router"]),
                lambda y: F.struct(
                    x["router"].alias("a"), y["router"].alias("b"), x["lang"].alias("lang_a"), y["lang"].alias("lang_b")
                ),
            ),
        )
    )
    exploded = per.select(F.explode(pairs).alias("p")).select("p.*")
    cells = exploded.groupBy("a", "b", "lang_a", "lang_b").agg(F.count("*").alias("n"))
    return cells


def agreement_summary(cells: DataFrame) -> DataFrame:
    """Pair agreement from `router_agreement` cells: `a, b, common, agree, rate`."""
    sums = cells.groupBy("a", "b").agg(
        F.sum("n").alias("common"), F.sum(F.when(F.col("lang_a") == F.col("lang_b"), F.col("n")).otherwise(0)).alias("agree")
    )
    return sums.withColumn("rate", F.col("agree") / F.col("common"))


def language_mix(routes: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counted = routes.groupBy(*by, "lang").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def mix_drift(mix: DataFrame, reference: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total variation between a routed mix (`by, lang, share`) and a reference (`lang, share`).

    Languages missing on one side count with share 0: what the mix never names adds
    the part of the reference that found no partner.
    """
    joined = mix.join(reference.select("lang", F.col("share").alias("q")), "lang", "left")
    q = F.coalesce("q", F.lit(0.0))
    total = reference.agg(F.sum("share")).scalar()
    sums = joined.groupBy(*(by or [])).agg(F.sum(F.abs(F.col("share") - q)).alias("_d"), F.sum(q).alias("_q"))
    return sums.select(*(by or []), ((F.col("_d") + total - F.col("_q")) / 2).alias("drift"))
