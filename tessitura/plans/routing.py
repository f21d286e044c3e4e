"""Queries over language scores and routings.

The scores are those of a word-level naive Bayes model fitted on the train split,
under three rules; the utterance's language column is the truth.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions.draws import draw, unit
from tessitura.operators import lid
from tessitura.operators import routing as R
from tessitura.plans import scoring as PS
from tessitura.plans import sql as Q
from tessitura.plans import views as V
from tessitura.session import dimension

LANGS = list(V.LANGS)
RULES = ["mean", "noisy", "sum"]


def _train(spark, sf_dir):
    return V.utterances(spark, sf_dir).where(V.original_split(F.col("utt_id")) == "train")


def scored(spark, sf_dir):
    """One row per utterance: `utt_id, truth, copies, tokens, scores`."""
    model = lid.nb_fit(_train(spark, sf_dir), "ref", LANGS)
    rows = lid.nb_score_rows(V.utterances(spark, sf_dir), "ref", "utt_id", model, LANGS, by=("lang",))
    return rows.withColumnRenamed("lang", "truth")


def _under(rows, rule):
    """The scores of a row under one rule, by language: the sum, its mean per token, or a perturbed mean."""

    def value(lang):
        mean = F.col("scores")[lang] / F.col("tokens")
        noise = unit(draw("noise", F.col("utt_id"), F.lit(lang))) * 3
        return F.round({"mean": mean, "noisy": mean + noise, "sum": F.col("scores")[lang]}[rule], 6)

    return {lang: value(lang) for lang in rows.schema["scores"].dataType.names}


def scores(spark, sf_dir, rules=RULES):
    """Long table `utt_id, model_lang, rule, score`."""
    rows = scored(spark, sf_dir)
    entries = [F.struct(F.lit(lg).alias("model_lang"), F.lit(r).alias("rule"), v.alias("score")) for r in rules for lg, v in _under(rows, r).items()]
    return rows.select("utt_id", F.inline(F.array(*entries)))


def answers(spark, sf_dir, **rules):
    """`utt_id, truth, copies` and a struct `lang, score` for each name in `rules`: the best of its languages under its rule."""
    rows = scored(spark, sf_dir)
    return rows.select("utt_id", "truth", "copies", *[R.best_label(_under(rows, rule), langs).alias(name) for name, (rule, langs) in rules.items()])


def _long(rows):
    """`utt_id, rule, lang, score` of answers under every rule."""
    return rows.select("utt_id", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}.lang"), F.col(f"{r}.score")) for r in RULES])))


def routes(spark, sf_dir):
    return _long(answers(spark, sf_dir, **{r: (r, LANGS) for r in RULES}))


def _patterns(spark, sf_dir, third=LANGS[:2]):
    """How many utterances have the same truth and the same answers: a few languages to the power of a few rules. `third`
    answers under the perturbed mean from a part of the languages."""
    named = answers(spark, sf_dir, third=("noisy", third), **{r: (r, LANGS) for r in RULES})
    kinds = named.groupBy("truth", *[F.col(f"{r}.lang").alias(r) for r in (*RULES, "third")]).agg(F.sum("copies").alias("n"))
    kinds = dimension(kinds)
    rows = kinds.withColumn("utt_id", F.to_json(F.struct(*[c for c in kinds.columns if c != "n"])))
    long = rows.select("utt_id", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("lang")) for r in RULES])))
    return rows, long, rows.select("utt_id", F.col("truth").alias("lang"), "n")


def truth(spark, sf_dir):
    return V.utterances(spark, sf_dir).select("utt_id", "lang")


def pairs(spark, sf_dir, rule="noisy"):
    """`utt_id, truth, pred, score` under one rule, one row per utterance."""
    best = answers(spark, sf_dir, best=(rule, LANGS))
    return best.select("utt_id", "truth", F.col("best.lang").alias("pred"), F.col("best.score").alias("score"), F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def nb_scores(spark, sf_dir):
    rows = scored(spark, sf_dir)
    entries = [F.struct(F.lit(lg).alias("model_lang"), v.alias("score")) for lg, v in _under(rows, "sum").items()]
    return rows.select("utt_id", F.inline(F.array(*entries)), "tokens")


def naive_bayes_lid(spark, sf_dir):
    # Fitted on one part of the documents, judged on the rest.
    held = V.utterances(spark, sf_dir).where(V.original_split(F.col("utt_id")) == "validation")
    model = lid.nb_fit(_train(spark, sf_dir), "ref", LANGS)
    pred = lid.nb_predict(held, "ref", "utt_id", model, LANGS)
    joined = held.select("utt_id", F.col("lang").alias("truth")).join(pred.withColumnRenamed("lang", "pred"), "utt_id")
    return R.recall(joined).withColumn("passes", F.col("recall") >= 0.95).withColumn("recall", F.round("recall", 6))


def implied_routing(spark, sf_dir):
    model = lid.nb_fit(_train(spark, sf_dir), "ref", LANGS)
    files = V.hyps(spark, sf_dir, 0.6)
    out = lid.implied_routing(files, "hyp", "utt_id", model, LANGS, truth(spark, sf_dir))
    return PS.rounded(out, "read_share", "routed_share", "bias")


def argmax_route(spark, sf_dir):
    return answers(spark, sf_dir, best=("sum", LANGS)).select("utt_id", "best.lang", "best.score")


def open_vs_closed_route(spark, sf_dir):
    both = answers(spark, sf_dir, open=("noisy", LANGS), closed=("noisy", LANGS[:3])).where("closed.lang IS NOT NULL")
    return both.groupBy("truth", F.col("open.lang").alias("open_lang"), F.col("closed.lang").alias("closed_lang")).agg(F.sum("copies").alias("n"))


def zscore_rules(spark, sf_dir):
    z = R.zscore_rules(scores(spark, sf_dir))
    best = R.argmax_route(z.withColumn("score", F.round("score", 6)), LANGS, ("utt_id", "rule"))
    named = truth(spark, sf_dir).withColumnRenamed("lang", "truth").join(best, "utt_id")
    return named.groupBy("rule", "truth", "lang").agg(F.count("*").alias("n"))


def topk_labels(spark, sf_dir):
    top = R.topk_labels(scores(spark, sf_dir, ["mean"]))
    return top.groupBy("rank", "label").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("prob"))


def target_share(spark, sf_dir):
    return PS.rounded(R.target_share(R.topk_labels(scores(spark, sf_dir, ["noisy"]), 5), LANGS[:2]), "share")


def router_accuracy(spark, sf_dir):
    _, routed, named = _patterns(spark, sf_dir)
    return PS.rounded(R.accuracy(routed, named, ["rule"], "n"), "accuracy")


def vote_route(spark, sf_dir):
    # Rules are ranked and votes are cast on the kinds of answers, so utterances are read once.
    kinds, routed, named = _patterns(spark, sf_dir)
    ranks = R.rank_rules(routed, named, RULES, "n")
    third = kinds.where("third IS NOT NULL").select("utt_id", F.col("third").alias("lang"))
    voted = R.vote_route(routed, ranks, third, LANGS[:2])
    return kinds.select("utt_id", "truth", "n").join(voted, "utt_id").groupBy("truth", "lang", "abstained").agg(F.sum("n").alias("n"))


def confusion(spark, sf_dir):
    return PS.rounded(R.confusion(pairs(spark, sf_dir)), "share")


def class_recall(spark, sf_dir):
    return PS.rounded(R.recall(pairs(spark, sf_dir)), "recall")


def top_confusions(spark, sf_dir):
    return R.top_confusions(pairs(spark, sf_dir), 2).select("truth", "pred", "n", "rank")


def high_confidence_errors(spark, sf_dir):
    return R.high_confidence_errors(pairs(spark, sf_dir), 12)


def _routers(spark, sf_dir):
    return routes(spark, sf_dir).select(F.col("rule").alias("router"), "utt_id", "lang")


def router_agreement(spark, sf_dir):
    return PS.rounded(R.agreement_summary(R.router_agreement(_routers(spark, sf_dir))), "rate")


def router_confusion(spark, sf_dir):
    return R.router_agreement(_routers(spark, sf_dir))


def language_mix(spark, sf_dir):
    return PS.rounded(R.language_mix(_routers(spark, sf_dir), ["router"]), "share")


def mix_drift(spark, sf_dir):
    reference = R.language_mix(truth(spark, sf_dir)).select("lang", "share")
    return PS.rounded(R.mix_drift(R.language_mix(_routers(spark, sf_dir), ["router"]), reference, ["router"]), "drift")


QUERIES = {
    "nb_scores": nb_scores, "naive_bayes_lid": naive_bayes_lid, "implied_routing": implied_routing,
    "argmax_route": argmax_route, "open_vs_closed_route": open_vs_closed_route, "zscore_rules": zscore_rules,
    "topk_labels": topk_labels, "target_share": target_share, "router_accuracy": router_accuracy,
    "vote_route": vote_route, "confusion": confusion, "class_recall": class_recall, "top_confusions": top_confusions,
    "high_confidence_errors": high_confidence_errors, "router_agreement": router_agreement,
    "router_confusion": router_confusion, "language_mix": language_mix, "mix_drift": mix_drift,
}

_ORD = "CASE {} WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END"


def nb_sql(name: str, rows: str, text: str, fit: str = "train") -> str:
    """Scores of `rows` under the model fitted on CTE `fit`."""
    return f"""{name}_m AS MATERIALIZED (SELECT utt_id, word, count(*) AS m FROM (SELECT utt_id, unnest({Q.ws(text)}) AS word FROM {rows}) GROUP BY ALL),
{name}_g AS MATERIALIZED (SELECT utt_id, lang AS model_lang, sum(m * ln(c + 1)) AS g FROM {name}_m JOIN {fit}_counts USING (word) GROUP BY ALL),
{name}_t AS MATERIALIZED (SELECT utt_id, sum(m)::BIGINT AS tokens FROM {name}_m GROUP BY utt_id),
{name} AS MATERIALIZED (
  SELECT utt_id, model_lang, logprior + coalesce(g, 0) + tokens * "default" AS score, tokens
  FROM (SELECT * FROM {name}_t, {fit}_classes) LEFT JOIN {name}_g USING (utt_id, model_lang))"""


def nb_fit_sql(fit: str = "train") -> str:
    return f"""{fit}_counts AS MATERIALIZED (SELECT lang, word, count(*) AS c FROM (SELECT lang, unnest({Q.ws('ref')}) AS word FROM {fit}) GROUP BY ALL),
{fit}_classes AS MATERIALIZED (SELECT lang AS model_lang, ln(docs / (SELECT count(*) FROM {fit})) AS logprior,
    ln(1 / (tok + (SELECT count(DISTINCT word) FROM {fit}_counts))) AS "default"
  FROM (SELECT lang, count(*) AS docs FROM {fit} GROUP BY lang) JOIN (SELECT lang, sum(c) AS tok FROM {fit}_counts GROUP BY lang) USING (lang))"""


_TRAIN = f"train AS MATERIALIZED (SELECT * FROM utt WHERE {PS.SPLIT} < 0.85::DOUBLE)"
BASE = Q.UTT + ",\n" + _TRAIN + ",\n" + nb_fit_sql() + ",\n" + nb_sql("base", "utt", "ref")
SCORES = BASE + f""",
sc AS MATERIALIZED (SELECT utt_id, model_lang, rule, round(s, 6) AS score FROM (
  SELECT utt_id, model_lang, 'mean' AS rule, score / tokens AS s FROM base
  UNION ALL SELECT utt_id, model_lang, 'noisy', score / tokens + {Q.unit(Q.draw('noise', 'utt_id', 'model_lang'))} * 3 FROM base
  UNION ALL SELECT utt_id, model_lang, 'sum', score FROM base))"""
ROUTES = SCORES + f""",
rt AS MATERIALIZED (SELECT utt_id, rule, model_lang AS lang, score FROM sc
  QUALIFY row_number() OVER (PARTITION BY utt_id, rule ORDER BY score DESC, {_ORD.format('model_lang')}) = 1)"""
PAIRS = ROUTES + """,
pr AS MATERIALIZED (SELECT utt_id, utt.lang AS truth, rt.lang AS pred, score FROM utt JOIN rt USING (utt_id) WHERE rule = 'noisy')"""


def _best(name: str, source: str, where: str = "true") -> str:
    return f"""{name} AS MATERIALIZED (SELECT utt_id, rule, model_lang AS lang, score FROM {source} WHERE {where}
      QUALIFY row_number() OVER (PARTITION BY utt_id, rule ORDER BY score DESC, {_ORD.format('model_lang')}) = 1)"""


_AGREE = """cells AS MATERIALIZED (SELECT x.rule AS a, y.rule AS b, x.lang AS lang_a, y.lang AS lang_b, count(*) AS n
  FROM rt x JOIN rt y ON x.utt_id = y.utt_id AND x.rule < y.rule GROUP BY ALL)"""
_LABELLED = "lm AS (SELECT rule AS router, lang, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY rule) AS share FROM rt GROUP BY rule, lang)"

SQL = {
    "nb_scores": Q.query(BASE, "SELECT utt_id, model_lang, round(score, 6) AS score, tokens FROM base"),
    "naive_bayes_lid": Q.query(
        BASE,
        f"""p AS MATERIALIZED (SELECT utt_id, utt.lang AS truth, model_lang AS pred FROM base JOIN utt USING (utt_id) WHERE {PS.SPLIT} >= 0.85::DOUBLE
              QUALIFY row_number() OVER (PARTITION BY utt_id ORDER BY round(score, 9) DESC, {_ORD.format('model_lang')}) = 1)""",
        "r AS (SELECT p.truth AS t, count(*) AS support, count(*) FILTER (p.truth = p.pred) AS hits FROM p GROUP BY ROLLUP (p.truth))",
        "SELECT coalesce(t, 'overall') AS truth, support, hits, round(hits / support, 6) AS recall, hits / support >= 0.95 AS passes FROM r",
    ),
    "implied_routing": Q.query(
        Q.UTT, Q.VOCAB, _TRAIN, nb_fit_sql(), Q.hyps("hf", 0.6), nb_sql("base", "hf", "hyp"),
        f"""p AS MATERIALIZED (SELECT utt_id, utt.lang AS routed, model_lang AS read FROM base JOIN utt USING (utt_id)
              QUALIFY row_number() OVER (PARTITION BY utt_id ORDER BY round(score, 9) DESC, {_ORD.format('model_lang')}) = 1)""",
        "x AS (SELECT read AS lang, 1 AS r, 0 AS k, 0 AS same FROM p UNION ALL SELECT routed, 0, 1, CASE WHEN read = routed THEN 1 ELSE 0 END FROM p)",
        "s AS (SELECT lang, sum(r)::BIGINT AS read, sum(k)::BIGINT AS routed, sum(same)::BIGINT AS agree, (SELECT count(*) FROM p) AS n FROM x GROUP BY lang)",
        "SELECT * EXCLUDE (n), round(read / n, 6) AS read_share, round(routed / n, 6) AS routed_share, round((read - routed) / n, 6) AS bias FROM s",
    ),
    "argmax_route": Q.query(ROUTES, "SELECT utt_id, lang, score FROM rt WHERE rule = 'sum'"),
    "open_vs_closed_route": Q.query(
        ROUTES, _best("cl", "sc", "rule = 'noisy' AND model_lang IN ('en', 'fr', 'de')"),
        """SELECT utt.lang AS truth, o.lang AS open_lang, cl.lang AS closed_lang, count(*) AS n
           FROM utt JOIN rt o USING (utt_id) JOIN cl USING (utt_id) WHERE o.rule = 'noisy' GROUP BY ALL""",
    ),
    "zscore_rules": Q.query(
        SCORES,
        "st AS (SELECT model_lang, rule, avg(score) AS mu, stddev_pop(score) AS sd FROM sc GROUP BY ALL)",
        """z AS MATERIALIZED (SELECT utt_id, model_lang, 'z:' || rule AS rule, round((score - mu) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END, 6) AS score
             FROM sc JOIN st USING (model_lang, rule))""",
        _best("zr", "z"),
        "SELECT rule, utt.lang AS truth, zr.lang, count(*) AS n FROM utt JOIN zr USING (utt_id) GROUP BY ALL",
    ),
    "topk_labels": Q.query(
        SCORES,
        """t AS (SELECT utt_id, model_lang AS label, exp(score - max(score) OVER w) / sum(exp(score - mx)) OVER w AS prob, row_number() OVER (PARTITION BY utt_id ORDER BY score DESC, model_lang DESC) AS rank
             FROM (SELECT *, max(score) OVER (PARTITION BY utt_id) AS mx FROM sc WHERE rule = 'mean') WINDOW w AS (PARTITION BY utt_id))""",
        "SELECT rank, label, count(*) AS n, round(avg(prob), 6) AS prob FROM t WHERE rank <= 5 GROUP BY ALL",
    ),
    "target_share": Q.query(
        SCORES,
        "t AS (SELECT * FROM sc WHERE rule = 'noisy' QUALIFY row_number() OVER (PARTITION BY utt_id ORDER BY score DESC, model_lang DESC) = 1)",
        """SELECT count(*) AS n, count(*) FILTER (model_lang IN ('en', 'fr')) AS in_target, round(count(*) FILTER (model_lang IN ('en', 'fr')) / count(*), 6) AS share FROM t""",
    ),
    "router_accuracy": Q.query(
        ROUTES,
        """SELECT rule, count(*) FILTER (rt.lang = utt.lang) AS hits, (SELECT count(*) FROM utt) AS n,
             round(count(*) FILTER (rt.lang = utt.lang) / (SELECT count(*) FROM utt), 6) AS accuracy FROM rt JOIN utt USING (utt_id) GROUP BY rule""",
    ),
    "vote_route": Q.query(
        ROUTES, _best("th", "sc", "rule = 'noisy' AND model_lang IN ('en', 'fr')"),
        "acc AS (SELECT rule, row_number() OVER (ORDER BY count(*) FILTER (rt.lang = utt.lang) DESC, rule) AS rank FROM rt JOIN utt USING (utt_id) GROUP BY rule)",
        """w AS (SELECT utt_id, max(lang) FILTER (rank = 1) AS f, max(lang) FILTER (rank = 2) AS s FROM rt JOIN acc USING (rule) GROUP BY utt_id)""",
        """v AS (SELECT utt_id, f, s, th.lang AS t, f IN ('en', 'fr') AND th.lang IS NOT NULL AS votes FROM w LEFT JOIN th USING (utt_id))""",
        """SELECT utt.lang AS truth, CASE WHEN f = s THEN f WHEN votes AND t = f THEN f WHEN votes AND t = s THEN s ELSE f END AS lang, NOT votes AS abstained, count(*) AS n
           FROM v JOIN utt USING (utt_id) GROUP BY ALL""",
    ),
    "confusion": Q.query(PAIRS, "SELECT truth, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM pr GROUP BY truth, pred"),
    "class_recall": Q.query(
        PAIRS,
        "r AS (SELECT p.truth AS t, count(*) AS support, count(*) FILTER (p.truth = p.pred) AS hits FROM pr p GROUP BY ROLLUP (p.truth))",
        "SELECT coalesce(t, 'overall') AS truth, support, hits, round(hits / support, 6) AS recall FROM r",
    ),
    "top_confusions": Q.query(
        PAIRS,
        "c AS (SELECT truth, pred, count(*) AS n FROM pr WHERE truth <> pred GROUP BY ALL)",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred) AS rank FROM c) WHERE rank <= 2",
    ),
    "high_confidence_errors": Q.query(PAIRS, "SELECT utt_id, truth, pred, score FROM pr WHERE truth <> pred ORDER BY score DESC, utt_id LIMIT 12"),
    "router_agreement": Q.query(
        ROUTES, _AGREE,
        "SELECT a, b, sum(n)::BIGINT AS common, sum(CASE WHEN lang_a = lang_b THEN n ELSE 0 END)::BIGINT AS agree, round(sum(CASE WHEN lang_a = lang_b THEN n ELSE 0 END) / sum(n), 6) AS rate FROM cells GROUP BY a, b",
    ),
    "router_confusion": Q.query(ROUTES, _AGREE, "SELECT * FROM cells"),
    "language_mix": Q.query(ROUTES, _LABELLED, "SELECT router, lang, n, round(share, 6) AS share FROM lm"),
    "mix_drift": Q.query(
        ROUTES, _LABELLED,
        "ref AS (SELECT lang, count(*) / sum(count(*)) OVER () AS q FROM utt GROUP BY lang)",
        "g AS (SELECT DISTINCT router FROM lm)",
        "SELECT router, round(sum(abs(coalesce(share, 0) - coalesce(q, 0))) / 2, 6) AS drift FROM (SELECT * FROM g, ref) FULL JOIN lm USING (router, lang) GROUP BY router",
    ),
}
