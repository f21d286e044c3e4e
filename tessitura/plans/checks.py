"""Queries over frames, contract checks, experiments and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.functions.draws import draw, unit
from tessitura.functions.words import n_words
from tessitura.operators import experiments as E
from tessitura.operators import frames as L
from tessitura.operators import routing as R
from tessitura.operators import scoring as S
from tessitura.operators import validation as C
from tessitura.plans import punct as PP
from tessitura.plans import routing as PR
from tessitura.plans import scoring as PS
from tessitura.plans import sql as Q
from tessitura.plans import views as V
from tessitura.session import dimension, reliable_checkpoint

RATES = (0.15, 0.6)


def _frames(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "logits")


def posterior_confidence(spark, sf_dir):
    out = L.posterior_confidence(_frames(spark, sf_dir), ["label"], blank_id=0)
    return PS.rounded(out, "mean_lp", "mean_lp_nb", "neg_entropy", "blank_frac")


def mask_and_argmax(spark, sf_dir):
    return PS.rounded(L.mask_and_argmax(_frames(spark, sf_dir), [0, 5, 9]), "value")


def _profiled(spark, sf_dir):
    return L.signal_profile(_frames(spark, sf_dir), "logits", rate=16)


def signal_profile(spark, sf_dir):
    return PS.rounded(_profiled(spark, sf_dir), "rms", "peak")


def duration_summary(spark, sf_dir):
    return PS.rounded(L.duration_summary(_profiled(spark, sf_dir), ["label"], 5.0), "mean_rms", "peak")


def pick_template(spark, sf_dir):
    ids = lambda name, col: V.table(spark, sf_dir, name).select(F.concat_ws("_", F.lit("doc"), col).alias("ID")).distinct()
    templates = ids("labels", "doc_id").withColumn("template", F.lit("labels")).unionByName(
        ids("conversations", "conv_id").withColumn("template", F.lit("conversations"))
    )
    return C.pick_template(ids("documents", "doc_id"), templates)


def _submission(spark, sf_dir):
    """A system's file for the validation split, damaged in every way a rule looks for."""
    u = unit(draw("damage", F.col("utt_id")))
    rows = V.with_hyps(PS._validation(spark, sf_dir), V.vocabulary(spark, sf_dir)).where(u >= 0.01)
    copies = F.explode(F.sequence(F.lit(1), F.when(u < 0.02, 2).otherwise(1)))
    target = (
        F.when(u.between(0.02, 0.09), "").when((u > 0.09) & (u < 0.1), F.lit(None).cast("string"))
        .when((u >= 0.1) & (u < 0.11), F.concat(F.lit("[UNK] "), "hyp")).otherwise(F.col("hyp"))
    )
    named = F.when((u >= 0.11) & (u < 0.12), F.concat("utt_id", F.lit("x"))).otherwise(F.col("utt_id"))
    return rows.select(named.alias("ID"), target.alias("Target"), _row_no().alias("row_no"), copies.alias("_c")).drop("_c")


def _row_no():
    return F.col("doc_id") * 100_000 + F.col("sent_no")


def validate_submission(spark, sf_dir):
    template = PS._validation(spark, sf_dir).select(F.col("utt_id").alias("ID"), _row_no().alias("row_no"))
    refs = reliable_checkpoint(V.utterances(spark, sf_dir).select("ref"))
    submission = reliable_checkpoint(_submission(spark, sf_dir))  # both are read by several rules
    out = C.validate_submission(submission, reliable_checkpoint(template), refs, columns=("ID", "Target"))
    return PS.rounded(out, "value")


def expectations(spark, sf_dir):
    sents = V.sentences(spark, sf_dir)
    facts = sents.groupBy(F.concat(F.lit("words_"), F.col("lang")).alias("fact")).agg(F.sum(n_words(F.col("sentence"))).cast("double").alias("v"))
    rules = [
        ("enough english", "words_en", ">=", 100_000, "FAIL"), ("enough german", "words_de", ">=", 10_000_000_000, "WARN"),
        ("no latin", "words_la", "==", 0, "FAIL"), ("spanish is small", "words_es", "<", 10_000_000_000, "FAIL"),
    ]
    return C.expectations(facts, rules)


def _results(spark, sf_dir):
    """Scores of two systems per language, raw and with a trailing period: `candidate, lang, multi, plus_period`."""
    noisy = PP._noisy(spark, sf_dir, PP.RATES)
    # Both systems are scored in one pass over the noisy rows.
    systems = {"multi": F.col("hyp"), "plus_period": T.append_period(F.col("hyp"), "nonblank")}
    counts = S.edit_counts_of(noisy.select("rate", "lang", "ref", "hyp"), systems, name="system")
    sums = S.pooled_score(counts.where("lang IS NOT NULL"), ["rate", "lang", "system"])
    of = lambda s: F.max(F.when(F.col("system") == s, F.round("multi", 9))).alias(s)
    # A row per candidate and language, read by several steps.
    return dimension(sums.groupBy(F.concat(F.lit("r"), F.col("rate").cast("string")).alias("candidate"), "lang").agg(*[of(s) for s in systems]))


def _expected(results):
    """The candidates of every language and one that never delivered."""
    have = results.select("candidate", "lang")
    return have.unionByName(have.select(F.lit("r0.99").alias("candidate"), "lang").distinct())


def bakeoff(spark, sf_dir):
    results = _results(spark, sf_dir)
    weights = V.utterances(spark, sf_dir).groupBy("lang").agg(F.sum(n_words(F.col("ref"))).alias("share"))
    table, _ = E.bakeoff(results, _expected(results), weights)
    return PS.rounded(table, "multi", "plus_period", "score")


def bakeoff_total(spark, sf_dir):
    results = _results(spark, sf_dir)
    weights = V.utterances(spark, sf_dir).groupBy("lang").agg(F.sum(n_words(F.col("ref"))).alias("share"))
    _, total = E.bakeoff(results, _expected(results), weights)
    return PS.rounded(total, "weighted")


def control_delta(spark, sf_dir):
    results = _results(spark, sf_dir).select("candidate", "lang", "multi")
    return PS.rounded(E.control_delta(results, "r0.32", ["lang"]), "multi", "control", "delta")


def calibration(spark, sf_dir):
    scores = S.score_by_language(PS.counts(spark, sf_dir))
    overall = scores.where(F.col("lang") == "overall").select("multi").scalar()
    rows = scores.select("lang", "wer", "cer", F.round(overall, 4).alias("observed"), F.round("multi", 4).alias("dev"))
    return PS.rounded(E.calibration(rows), "wer", "cer", "predicted", "delta", "bias")


def _anchors(spark, sf_dir):
    """One row `oracle, floor, observed`: scores at a low and a high error rate, and halfway."""
    noisy = PP._noisy(spark, sf_dir, RATES)
    by = S.pooled_score(S.edit_counts(noisy), ["rate"])
    pick = lambda r: F.max(F.when(F.col("rate") == r, F.col("multi")))
    one = by.agg(pick(RATES[0]).alias("oracle"), pick(RATES[1]).alias("floor"))
    # Read as several scalars.
    return dimension(one.select("oracle", "floor", ((F.col("oracle") + F.col("floor")) / 2).alias("observed")))


def route_projection(spark, sf_dir):
    anchors = _anchors(spark, sf_dir)
    acc = R.accuracy(PR.routes(spark, sf_dir), PR.truth(spark, sf_dir), ["rule"]).select("rule", "accuracy")
    rows = acc.select("rule", "accuracy", *[anchors.select(c).scalar().alias(c) for c in ("oracle", "floor", "observed")])
    return PS.rounded(E.route_projection(rows), "accuracy", "oracle", "floor", "observed", "projected", "perfect", "implied")


def _mixes(spark, sf_dir):
    """`router, lang, p, q`: the routed and the true share of every language."""
    p = R.language_mix(PR._routers(spark, sf_dir), ["router"]).select("router", "lang", F.col("share").alias("p"))
    q = R.language_mix(PR.truth(spark, sf_dir)).select("lang", F.col("share").alias("q"))
    return p.join(q, "lang", "left")


def agreement_bounds(spark, sf_dir):
    return PS.rounded(E.agreement_bounds(_mixes(spark, sf_dir), ["router"]), "lo", "hi")


def falsify_hypotheses(spark, sf_dir):
    anchors = _anchors(spark, sf_dir)
    one = lambda c: anchors.select(c).scalar()
    out = E.falsify_hypotheses(_mixes(spark, sf_dir), ["router"], one("observed"), one("floor"), one("oracle"))
    return PS.rounded(out, "lo", "hi", "observed", "floor", "posted", "ceiling")


def _halves(spark, sf_dir):
    """Each router's mix and the true one, on the two halves of a seeded split."""
    half = lambda df: df.withColumn("half", (unit(draw("half", F.col("utt_id"))) < 0.5).cast("int"))
    p = R.language_mix(half(PR._routers(spark, sf_dir)), ["router", "half"]).select("router", "half", "lang", F.col("share").alias("p"))
    q = R.language_mix(half(PR.truth(spark, sf_dir)), ["half"]).select("half", "lang", F.col("share").alias("q"))
    return p.join(q, ["half", "lang"], "left")


def _corrected(spark, sf_dir):
    """The mix of one half, corrected by the bias measured on the other."""
    halves = _halves(spark, sf_dir)
    bias = halves.where("half = 1").select("router", "lang", (F.col("p") - F.coalesce("q", F.lit(0.0))).alias("bias"))
    mine = halves.where("half = 0").select("router", "lang", F.col("p").alias("share"), F.coalesce("q", F.lit(0.0)).alias("true_share"))
    return E.correct_mix(mine.join(bias, ["router", "lang"], "left").fillna(0.0, ["bias"]), ["router"])


def corrected_mix(spark, sf_dir):
    return PS.rounded(_corrected(spark, sf_dir), "share", "true_share", "bias", "corrected")


def falsify_corrected(spark, sf_dir):
    """The claims tested again after the bias correction, with the accuracy at which each would just hold."""
    anchors = _anchors(spark, sf_dir)
    one = lambda c: anchors.select(c).scalar()
    mixes = _corrected(spark, sf_dir).select("router", "lang", F.col("corrected").alias("p"), F.col("true_share").alias("q"))
    out = E.falsify_hypotheses(mixes, ["router"], one("observed"), one("floor"), one("oracle"))
    even = E.implied_accuracy(F.col("observed"), F.col("posted"), F.col("floor"))
    return PS.rounded(out.withColumn("break_even", even), "lo", "hi", "observed", "floor", "posted", "ceiling", "break_even")


def projection_grid(spark, sf_dir):
    rows = _anchors(spark, sf_dir).select(F.col("observed").alias("s"), (F.col("oracle") - F.col("floor")).alias("delta"), "floor")
    return PS.rounded(E.projection_grid(rows, [0.85, 0.9, 0.9658], [0.0, 0.5, 1.0]), "s", "delta", "floor", "projected")


QUERIES = {
    "posterior_confidence": posterior_confidence, "mask_and_argmax": mask_and_argmax, "signal_profile": signal_profile,
    "duration_summary": duration_summary, "pick_template": pick_template, "validate_submission": validate_submission,
    "expectations": expectations, "bakeoff": bakeoff, "bakeoff_total": bakeoff_total, "control_delta": control_delta,
    "calibration": calibration, "route_projection": route_projection, "agreement_bounds": agreement_bounds,
    "falsify_hypotheses": falsify_hypotheses, "corrected_mix": corrected_mix, "falsify_corrected": falsify_corrected, "projection_grid": projection_grid,
}

_FR = """fr AS MATERIALIZED (SELECT vec_id, label, x, mx, z, mx - z AS top, list_position(x, mx) - 1 AS arg,
    list_sum(list_transform(x, lambda v: exp(v - z) * (v - z))) AS ent FROM (
  SELECT *, mx + ln(list_sum(list_transform(x, lambda v: exp(v - mx)))) AS z FROM (
    SELECT *, list_max(x) AS mx FROM (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings))))"""
_SIG = """sig AS (SELECT vec_id, label, len(x) AS n_samples, len(x) / 16 AS seconds, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms,
    list_max(list_transform(x, lambda v: abs(v))) AS peak FROM fr)"""
_SUB = f"""sub AS MATERIALIZED (SELECT CASE WHEN u >= 0.11 AND u < 0.12 THEN utt_id || 'x' ELSE utt_id END AS ID,
    CASE WHEN u BETWEEN 0.02 AND 0.09 THEN '' WHEN u > 0.09 AND u < 0.1 THEN NULL WHEN u >= 0.1 AND u < 0.11 THEN '[UNK] ' || hyp ELSE hyp END AS t,
    doc_id * 100000 + sent_no AS row_no, unnest(range(0, CASE WHEN u < 0.02 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, {Q.unit(Q.draw('damage', 'utt_id'))} AS u FROM hyps WHERE {PS.SPLIT} >= 0.85::DOUBLE) WHERE u >= 0.01),
tpl AS MATERIALIZED (SELECT utt_id AS ID, doc_id * 100000 + sent_no AS want_at FROM utt WHERE {PS.SPLIT} >= 0.85::DOUBLE)"""


def _side(name: str, source: str, col: str) -> str:
    t = f"coalesce({col}, '')"
    w = f"len(regexp_extract_all({t}, '{Q.NOT_SPACE}'))"
    return rf"""{name} AS (SELECT count(*) AS rows, count(*) FILTER ({col} IS NULL) AS nulls, count(*) FILTER (trim({t}) = '') AS blanks, max({w}) AS maxw, avg({w}) AS meanw,
    count(*) FILTER (regexp_matches({t}, '[\[\]<>]')) AS br, count(*) FILTER (contains({t}, ',')) AS commas,
    sum(length(regexp_replace({t}, '[^\p{{Lu}}]+', '', 'g'))) / greatest(1, sum(length(regexp_replace({t}, '[^\p{{L}}]+', '', 'g')))) AS up FROM {source})"""


_IDS = """ids AS (SELECT count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (want_at IS NULL) AS unexpected, sum(greatest(coalesce(n, 1) - 1, 0)) AS dups,
    count(*) FILTER (got_at <> want_at) AS moved, count(want_at) AS expected FROM tpl FULL JOIN (SELECT ID, count(*) AS n, min(row_no) AS got_at FROM sub GROUP BY ID) USING (ID)),
unseen AS (SELECT count(*) AS k FROM (SELECT DISTINCT unnest(string_split(coalesce(t, ''), '')) AS c FROM sub) a WHERE c <> ''
    AND c NOT IN (SELECT DISTINCT unnest(string_split(ref, '')) FROM utt))"""
_RULES = """SELECT rule, severity, round(value, 6) AS value FROM (
  SELECT unnest([
    {'rule': 'row_count', 'severity': 'FAIL', 'value': (a.rows - expected)::DOUBLE, 'b': a.rows <> expected},
    {'rule': 'missing_ids', 'severity': 'FAIL', 'value': missing::DOUBLE, 'b': missing > 0}, {'rule': 'unexpected_ids', 'severity': 'FAIL', 'value': unexpected::DOUBLE, 'b': unexpected > 0},
    {'rule': 'row_order', 'severity': 'WARN', 'value': moved::DOUBLE, 'b': missing = 0 AND unexpected = 0 AND moved > 0},
    {'rule': 'duplicate_ids', 'severity': 'FAIL', 'value': dups::DOUBLE, 'b': dups > 0}, {'rule': 'nulls', 'severity': 'FAIL', 'value': a.nulls::DOUBLE, 'b': a.nulls > 0},
    {'rule': 'blanks', 'severity': CASE WHEN 100 * a.blanks / a.rows > 5 THEN 'FAIL' ELSE 'WARN' END, 'value': a.blanks::DOUBLE, 'b': a.blanks > 0},
    {'rule': 'longest', 'severity': 'WARN', 'value': a.maxw::DOUBLE, 'b': a.maxw > 200}, {'rule': 'brackets', 'severity': 'WARN', 'value': a.br::DOUBLE, 'b': a.br > 0},
    {'rule': 'commas', 'severity': 'WARN', 'value': a.commas::DOUBLE, 'b': a.commas > 0},
    {'rule': 'upper_gap', 'severity': 'WARN', 'value': abs(a.up - r.up)::DOUBLE, 'b': abs(a.up - r.up) > 0.02},
    {'rule': 'length_gap', 'severity': 'WARN', 'value': (abs(a.meanw - r.meanw) / r.meanw)::DOUBLE, 'b': abs(a.meanw - r.meanw) / r.meanw > 0.35},
    {'rule': 'unseen_chars', 'severity': 'WARN', 'value': k::DOUBLE, 'b': k > 0}], recursive := true)
  FROM sa a, sr r, ids, unseen) WHERE b"""

_RES = (
    Q.UTT, Q.VOCAB, PS.BARE, PP._noisy_sql(PP.RATES), Q.edits("e1", "noisy", "utt_id, lang, rate"),
    "dotted AS (SELECT utt_id, lang, rate, ref, hyp || '.' AS hyp FROM noisy)", Q.edits("e2", "dotted", "utt_id, lang, rate"),
    f"""res AS MATERIALIZED (SELECT 'r' || rate AS candidate, lang, multi, plus_period FROM (SELECT rate, lang, round({Q.MULTI}, 9) AS multi FROM e1 GROUP BY rate, lang)
      JOIN (SELECT rate, lang, round({Q.MULTI}, 9) AS plus_period FROM e2 GROUP BY rate, lang) USING (rate, lang))""",
)
_BAKE = """bk AS MATERIALIZED (SELECT *, CASE WHEN score IS NULL THEN 'FAILED' WHEN row_number() OVER (PARTITION BY lang ORDER BY score DESC NULLS LAST, candidate) = 1 THEN 'BEST' ELSE 'ok' END AS status
  FROM (SELECT candidate, lang, multi, plus_period, greatest(multi, coalesce(plus_period, multi)) AS score FROM (
    SELECT * FROM res UNION ALL SELECT DISTINCT 'r0.99', lang, NULL::DOUBLE, NULL::DOUBLE FROM res)))"""
_ANCH = (
    Q.VOCAB + ",\n" + PS.BARE + ",\n" + PP._noisy_sql(RATES) + ",\n" + Q.edits("ea", "noisy", "utt_id, rate")
    + f""",
an AS MATERIALIZED (SELECT oracle, floor, (oracle + floor) / 2 AS observed FROM (SELECT max(m) FILTER (rate = 0.15) AS oracle, max(m) FILTER (rate = 0.6) AS floor
  FROM (SELECT rate, {Q.MULTI} AS m FROM ea GROUP BY rate)))"""
)
_MIXES = """mx AS MATERIALIZED (SELECT router, lang, p, q FROM (SELECT rule AS router, lang, count(*) / sum(count(*)) OVER (PARTITION BY rule) AS p FROM rt GROUP BY rule, lang)
  LEFT JOIN (SELECT lang, count(*) / sum(count(*)) OVER () AS q FROM utt GROUP BY lang) USING (lang))"""
_BOUNDS = "bd AS (SELECT router, sum(greatest(0, coalesce(p, 0) + coalesce(q, 0) - 1)) AS lo, sum(least(coalesce(p, 0), coalesce(q, 0))) AS hi FROM mx GROUP BY router)"

_CORRECTED = (
    f"""hp AS (SELECT rule AS router, CASE WHEN {Q.unit(Q.draw('half', 'utt_id'))} < 0.5::DOUBLE THEN 1 ELSE 0 END AS half, lang FROM rt)""",
    f"""hq AS (SELECT CASE WHEN {Q.unit(Q.draw('half', 'utt_id'))} < 0.5::DOUBLE THEN 1 ELSE 0 END AS half, lang FROM utt)""",
    """hm AS MATERIALIZED (SELECT router, half, lang, p, coalesce(q, 0) AS q FROM (
         SELECT router, half, lang, count(*) / sum(count(*)) OVER (PARTITION BY router, half) AS p FROM hp GROUP BY router, half, lang)
       LEFT JOIN (SELECT half, lang, count(*) / sum(count(*)) OVER (PARTITION BY half) AS q FROM hq GROUP BY half, lang) USING (half, lang))""",
    """cb AS (SELECT a.router, a.lang, a.p, a.q, coalesce(b.p - b.q, 0) AS bias FROM (SELECT * FROM hm WHERE half = 0) a
       LEFT JOIN (SELECT * FROM hm WHERE half = 1) b ON b.router = a.router AND b.lang = a.lang)""",
    """cm AS MATERIALIZED (SELECT router, lang, p, q, bias, greatest(0, p - bias) / sum(greatest(0, p - bias)) OVER (PARTITION BY router) AS corrected FROM cb)""",
)

SQL = {
    "posterior_confidence": Q.query(
        _FR,
        """SELECT label, count(*) AS frames, round(avg(top), 6) AS mean_lp, round(coalesce(avg(top) FILTER (arg <> 0), -20), 6) AS mean_lp_nb, round(avg(ent), 6) AS neg_entropy,
             round(avg(CASE WHEN arg <> 0 THEN 0 ELSE 1 END), 6) AS blank_frac FROM fr GROUP BY label""",
    ),
    "mask_and_argmax": Q.query(
        _FR, "mk AS (SELECT vec_id, label, list_transform(x, lambda v, i: CASE WHEN i IN (1, 6, 10) THEN -1e9::DOUBLE ELSE v END) AS x FROM fr)",
        "SELECT vec_id, label, (list_position(x, list_max(x)) - 1)::BIGINT AS arg, round(list_max(x), 6) AS value FROM mk",
    ),
    "signal_profile": Q.query(_FR, _SIG, "SELECT vec_id, label, n_samples, seconds, round(rms, 6) AS rms, round(peak, 6) AS peak FROM sig"),
    "duration_summary": Q.query(
        _FR, _SIG,
        """SELECT label, count(*) AS clips, min(seconds) AS min_seconds, quantile_cont(seconds, 0.5) AS median_seconds, max(seconds) AS max_seconds,
             round(avg(rms), 6) AS mean_rms, round(max(peak), 6) AS peak, quantile_cont(seconds, 0.5) < 5 AS short FROM sig GROUP BY label""",
    ),
    "pick_template": Q.query(
        "t AS (SELECT DISTINCT 'labels' AS template, 'doc_' || doc_id AS ID FROM labels UNION ALL SELECT DISTINCT 'conversations', 'doc_' || conv_id FROM conversations)",
        "c AS (SELECT template, count(*) AS expected, count(d.ID) AS overlap FROM t LEFT JOIN (SELECT 'doc_' || doc_id AS ID FROM documents) d USING (ID) GROUP BY template)",
        "SELECT *, CASE WHEN overlap = 0 THEN 'ids match no template' ELSE 'ok' END AS note FROM c ORDER BY overlap DESC, template LIMIT 1",
    ),
    "validate_submission": Q.query(Q.HYPS, _SUB, _side("sa", "sub", "t"), _side("sr", "utt", "ref"), _IDS, _RULES),
    "expectations": Q.query(
        Q.SENT, f"f AS (SELECT 'words_' || lang AS fact, sum({Q.nw('sentence')})::DOUBLE AS v FROM sent GROUP BY lang)",
        """r(rule, fact, lim, sev, op) AS (VALUES ('enough english', 'words_en', 100000::DOUBLE, 'FAIL', 1), ('enough german', 'words_de', 10000000000, 'WARN', 1),
             ('no latin', 'words_la', 0, 'FAIL', 0), ('spanish is small', 'words_es', 10000000000, 'FAIL', -1))""",
        """SELECT rule, fact, v AS value, lim AS "limit", CASE WHEN coalesce(CASE op WHEN 1 THEN v >= lim WHEN 0 THEN v = lim ELSE v < lim END, false) THEN 'OK' ELSE sev END AS outcome FROM r LEFT JOIN f USING (fact)""",
    ),
    "bakeoff": Q.query(*_RES, _BAKE, "SELECT candidate, lang, round(multi, 6) AS multi, round(plus_period, 6) AS plus_period, round(score, 6) AS score, status FROM bk"),
    "bakeoff_total": Q.query(
        *_RES, _BAKE, f"w AS (SELECT lang, sum({Q.nw('ref')}) AS share FROM utt GROUP BY lang)",
        "SELECT round(sum(share * score) / sum(share), 6) AS weighted, count(*) AS languages FROM bk JOIN w USING (lang) WHERE status = 'BEST'",
    ),
    "control_delta": Q.query(
        *_RES, "c AS (SELECT lang, multi AS control FROM res WHERE candidate = 'r0.32')",
        """SELECT lang, candidate, round(multi, 6) AS multi, round(control, 6) AS control, round(multi - control, 6) AS delta,
             CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY multi DESC, candidate) = 1 AND multi > control THEN 'WINNER' ELSE 'keep control' END AS verdict FROM res JOIN c USING (lang)""",
    ),
    "calibration": Q.query(
        Q.EDITS,
        """s AS (SELECT coalesce(lang, 'overall') AS lang, sum(word_edits) / sum(ref_words) AS wer, sum(char_edits) / sum(ref_chars) AS cer FROM ed GROUP BY GROUPING SETS ((lang), ()))""",
        "m AS (SELECT *, 0.5::DOUBLE * (1 - wer) + 0.5::DOUBLE * (1 - cer) AS predicted FROM s)",
        "o AS (SELECT *, (SELECT round(predicted, 4) FROM m WHERE lang = 'overall') AS observed, round(predicted, 4) AS dev FROM m)",
        """SELECT lang, round(wer, 6) AS wer, round(cer, 6) AS cer, observed, dev, round(predicted, 6) AS predicted, round(abs(predicted - observed), 6) AS delta,
             CASE WHEN abs(predicted - observed) < 5e-4 THEN 'CONFIRMED' ELSE 'MISMATCH' END AS verdict, round(dev - observed, 6) AS bias,
             CASE WHEN abs(dev - observed) > 0.08 THEN 'rank only' ELSE 'absolute' END AS "use" FROM o""",
    ),
    "route_projection": Q.query(
        PR.ROUTES, _ANCH,
        "acc AS (SELECT rule, count(*) FILTER (rt.lang = utt.lang) / (SELECT count(*) FROM utt) AS accuracy FROM rt JOIN utt USING (utt_id) GROUP BY rule)",
        """SELECT rule, round(accuracy, 6) AS accuracy, round(oracle, 6) AS oracle, round(floor, 6) AS floor, round(observed, 6) AS observed,
             round(accuracy * oracle + (1 - accuracy) * floor, 6) AS projected, round((observed - (1 - accuracy) * floor) / accuracy, 6) AS perfect,
             round((observed - floor) / (oracle - floor), 6) AS implied FROM acc, an""",
    ),
    "agreement_bounds": Q.query(PR.ROUTES, _MIXES, _BOUNDS, "SELECT router, round(lo, 6) AS lo, round(hi, 6) AS hi FROM bd"),
    "falsify_hypotheses": Q.query(
        PR.ROUTES, _MIXES, _BOUNDS, _ANCH,
        "c AS (SELECT *, (observed - (1 - greatest(lo, 1e-9::DOUBLE)) * floor) / greatest(lo, 1e-9::DOUBLE) AS ceiling FROM bd, an)",
        """SELECT router, round(lo, 6) AS lo, round(hi, 6) AS hi, round(observed, 6) AS observed, round(floor, 6) AS floor, round(oracle, 6) AS posted,
             round(ceiling, 6) AS ceiling, ceiling < oracle AS refuted FROM c""",
    ),
    "corrected_mix": Q.query(
        PR.ROUTES, *_CORRECTED,
        "SELECT router, lang, round(p, 6) AS share, round(q, 6) AS true_share, round(bias, 6) AS bias, round(corrected, 6) AS corrected FROM cm",
    ),
    "falsify_corrected": Q.query(
        PR.ROUTES, *_CORRECTED, _ANCH,
        """bd AS (SELECT router, sum(greatest(0, corrected + q - 1)) AS lo, sum(least(corrected, q)) AS hi FROM cm GROUP BY router)""",
        "f AS (SELECT router, lo, hi, observed, floor, oracle AS posted, (observed - floor * (1 - greatest(lo, 1e-9::DOUBLE))) / greatest(lo, 1e-9::DOUBLE) AS ceiling FROM bd, an)",
        """SELECT router, round(lo, 6) AS lo, round(hi, 6) AS hi, round(observed, 6) AS observed, round(floor, 6) AS floor, round(posted, 6) AS posted, round(ceiling, 6) AS ceiling,
             ceiling < posted AS refuted, round((observed - floor) / (posted - floor), 6) AS break_even FROM f""",
    ),
    "projection_grid": Q.query(
        Q.UTT, _ANCH,
        """SELECT round(observed, 6) AS s, round(oracle - floor, 6) AS delta, round(floor, 6) AS floor, accuracy, transfer,
             round(accuracy * least(1, observed + (oracle - floor) * transfer) + (1 - accuracy) * floor, 6) AS projected
           FROM an, (VALUES (0.85::DOUBLE), (0.9), (0.9658)) a(accuracy), (VALUES (0.0::DOUBLE), (0.5), (1.0)) t(transfer)""",
    ),
}
