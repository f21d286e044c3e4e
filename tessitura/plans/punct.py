"""Queries over punctuation: restoring, probing, ablating."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.functions.words import join_words, words
from tessitura.operators import punct as U
from tessitura.operators import scoring as S
from tessitura.operators.sampling import corrupt_words
from tessitura.plans import scoring as PS
from tessitura.plans import sql as Q
from tessitura.plans import views as V
from tessitura.session import dimension, settled

# Error rates and thresholds of the published sweeps.
RATES = (0.15, 0.25, 0.32, 0.42)
SWEEP_RATES = (0.32, 0.38, 0.42)
THRESHOLDS = [0.5, 0.7, 0.8, 0.85, 0.9, 0.92, 0.95]
ADDITIVE_THRESHOLDS = [0.7, 0.8, 0.85, 0.9, 0.95]
PROBE_THRESHOLD = 0.5


def _bare(spark, sf_dir):
    rows = V.utterances(spark, sf_dir).withColumn("bare", T.strip_punct(F.col("ref"))).where(F.col("bare") != "")
    return rows.select("utt_id", "lang", "ref", "bare")


def _noisy(spark, sf_dir, rates) -> DataFrame:
    """Each bare utterance corrupted at every rate: `utt_id, lang, ref, rate, hyp`."""
    rates = F.explode(F.array(*[F.lit(float(r)) for r in rates]))
    rows = _bare(spark, sf_dir).withColumn("rate", rates)
    seed = F.concat(F.lit("1337/"), F.col("rate").cast("string"))
    noisy = corrupt_words(
        rows, words(F.col("bare")), "utt_id", V.vocabulary(spark, sf_dir), F.col("rate"), seed, out="hyp", row_id=["utt_id", "rate"])
    # Spelled out once, however often it is read.
    return settled(noisy.withColumnRenamed("hyp", "_ws"), {"hyp": join_words(F.col("_ws"))}).select("utt_id", "lang", "ref", "rate", "hyp")


def _marks(spark, sf_dir):
    train = V.utterances(spark, sf_dir).where(V.original_split(F.col("utt_id")) == "train")
    return U.mark_table(train, "ref", "utt_id")


def mark_table(spark, sf_dir):
    return PS.rounded(_marks(spark, sf_dir), "p1", "p2")


def apply_marks(spark, sf_dir):
    rows = _bare(spark, sf_dir).select("utt_id", words(F.col("bare")).alias("ws"))
    return U.apply_marks(rows, "utt_id", "ws", _marks(spark, sf_dir), [0.5])


def add_marks_additive(spark, sf_dir):
    rows = V.utterances(spark, sf_dir).select("utt_id", words(F.col("ref")).alias("ws"))
    return U.add_marks_additive(rows, "utt_id", "ws", _marks(spark, sf_dir), [0.3])


def oracle_marks(spark, sf_dir):
    rows = _noisy(spark, sf_dir, (0.32,))
    return rows.select("utt_id", U.oracle_marks(F.col("ref"), F.col("hyp")).alias("marked"))


def token_prf(spark, sf_dir):
    # Predictions: a period from a probability of .2, else a comma from .1.
    labelled = U.labelled_words(V.utterances(spark, sf_dir).select("utt_id", "ref"), "ref", "utt_id").withColumn("word", F.lower("word"))
    p1, p2 = F.coalesce("p1", F.lit(0.0)), F.coalesce("p2", F.lit(0.0))
    pred = F.when((p1 >= 0.2) & (p1 >= p2), 1).when(p2 >= 0.1, 2).otherwise(0)
    # Words are counted with their labels first, so the lookup meets each word three times at most.
    counted = labelled.groupBy("word", "label").agg(F.count("*").alias("m"))
    joined = counted.join(_marks(spark, sf_dir).drop("n"), "word", "left").withColumn("pred", pred)
    rows = joined.groupBy("label", "pred").agg(F.sum("m").alias("m"))
    out = U.token_prf(rows, weight="m")
    return PS.rounded(out, "precision", "recall", "f1").withColumn("label", F.col("label").cast("int"))


def _restorable(noisy: DataFrame, text) -> DataFrame:
    """The rows of `_noisy` under an id of their own, with their words."""
    return noisy.select(F.concat_ws("@", "utt_id", "rate").alias("row_id"), "ref", "rate", "hyp", words(text).alias("ws"))


def punct_probe(spark, sf_dir):
    noisy = _noisy(spark, sf_dir, RATES)
    hyp = F.col("hyp")
    restored = U.restored_texts(_restorable(noisy, hyp), "row_id", "ws", _marks(spark, sf_dir), [PROBE_THRESHOLD])
    systems = {"none": hyp, "always": T.append_period(hyp, "always"), "restored": F.get("restored", F.lit(0)), "oracle": U.oracle_marks(F.col("ref"), hyp)}
    rows = restored.select("rate", "ref", *[h.alias(f"_{n}") for n, h in systems.items()])
    counts = S.edit_counts_of(rows, {n: F.col(f"_{n}") for n in systems}, name="system")
    scores = S.pooled_score(counts.select("rate", "system", *S.EDITS), ["rate", "system"])
    wide = scores.groupBy("rate").agg(*[F.max(F.when(F.col("system") == s, F.col("multi"))).alias(s) for s in systems])
    gain, always = F.col("restored") - F.col("none"), F.col("always") - F.col("none")
    out = wide.withColumns({"gain": gain, "always_gain": always, "verdict": F.when(F.greatest(gain, always) > 0, "APPLY").otherwise("DO NOT APPLY")})
    return PS.rounded(out, *systems, "gain", "always_gain")


def mark_ablation(spark, sf_dir):
    # A reference of marks only leaves nothing to ablate to; it still counts, as an empty hypothesis.
    rows = V.utterances(spark, sf_dir).select("lang", "ref")
    return PS.rounded(S.score_by_language(S.edit_counts_of(rows, U.ablations(F.col("ref"))), ["variant"]))


def _grid(spark, sf_dir, additive: bool) -> DataFrame:
    """Per rate and threshold the restored text's score beside what is shipped, `base`, and marks restored without
    error, `oracle`; commas per utterance."""
    thresholds = ADDITIVE_THRESHOLDS if additive else THRESHOLDS
    noisy = _noisy(spark, sf_dir, SWEEP_RATES)
    shipped = T.append_period(F.col("hyp"), "always")
    rows = _restorable(noisy, shipped if additive else F.col("hyp"))
    restored = U.restored_texts(rows, "row_id", "ws", _marks(spark, sf_dir), thresholds, additive)
    commas = F.transform("restored", lambda t: (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))).cast("bigint"))
    staged = restored.select("rate", "ref", "restored", commas.alias("commas"), shipped.alias("_base"), U.oracle_marks(F.col("ref"), F.col("hyp")).alias("_oracle"))
    variants = {str(k): F.get("restored", F.lit(k)) for k in range(len(thresholds))} | {"base": F.col("_base"), "oracle": F.col("_oracle")}
    counts = S.edit_counts_of(staged, variants)
    number = F.expr("try_cast(variant AS int)")
    marked = counts.select("rate", number.alias("k"), "variant", F.get("commas", number).alias("c"), *S.EDITS)
    sums = marked.groupBy("rate", "variant", "k").agg(F.count("*").alias("n"), F.sum("c").alias("c"), *[F.sum(e).alias(e) for e in S.EDITS])
    # A row per rate and variant, all of them parameters.
    scores = dimension(S.with_rates(sums).select("rate", "variant", "k", F.round("multi", 9).alias("multi"), (F.col("c") / F.col("n")).alias("commas_per_utt")))
    of = lambda v: scores.where(F.col("variant") == v).select("rate", F.col("multi").alias(v))
    thr = F.get(F.array(*[F.lit(t) for t in thresholds]), F.col("k"))
    grid = scores.where("k IS NOT NULL").join(of("base"), "rate").join(of("oracle"), "rate")
    return grid.select("rate", thr.alias("thr"), "multi", "base", "oracle", (F.col("multi") - F.col("base")).alias("delta"), "commas_per_utt")


def _sweep(spark, sf_dir, additive: bool):
    grid = _grid(spark, sf_dir, additive)
    best = U.best_threshold(grid.select("rate", "thr", "multi"), ["rate"], grid.select("rate", "base").distinct(), min_wins=2 if additive else 1)
    return PS.rounded(best, "multi", "base", "delta")


def threshold_grid(spark, sf_dir):
    return PS.rounded(_grid(spark, sf_dir, additive=False), "multi", "base", "oracle", "delta", "commas_per_utt")


def additive_grid(spark, sf_dir):
    return PS.rounded(_grid(spark, sf_dir, additive=True), "multi", "base", "oracle", "delta", "commas_per_utt")


def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir, additive=False)


def additive_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir, additive=True)


def punct_restorer(spark, sf_dir):
    """Fit the MLlib restorer on the train split and restore the validation split: per label its words on both
    sides and its class weight, whether every prediction is the likeliest class, and whether the model beats a
    constant answer."""
    utts = V.utterances(spark, sf_dir).select("utt_id", "lang", "ref", V.original_split(F.col("utt_id")).alias("split"))
    examples = U.restorer_examples(utts, "ref", "utt_id")
    weighted = U.balanced_weights(examples.where("split = 'train'"))
    model = U.restorer_pipeline().fit(weighted)
    held = model.transform(examples.where("split = 'validation'"))
    top = vector_to_array("probability")
    likeliest = F.array_position(top, F.array_max(top)) - 1 == F.col("prediction")
    found = held.groupBy("label").agg(
        F.count("*").alias("held"), F.bool_and(likeliest).alias("argmax"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("recall"))
    better = F.avg("recall").over(Window.partitionBy()) > 1 / F.count("*").over(Window.partitionBy())
    sizes = weighted.groupBy("label").agg(F.count("*").alias("train"), F.round(F.first("weight"), 6).alias("weight"))
    return found.withColumn("beats_constant", better).join(sizes, "label").select(
        F.col("label").cast("int").alias("label"), "train", "weight", "held", "argmax", "beats_constant")


QUERIES = {
    "mark_table": mark_table, "apply_marks": apply_marks, "add_marks_additive": add_marks_additive, "oracle_marks": oracle_marks,
    "token_prf": token_prf, "punct_probe": punct_probe, "mark_ablation": mark_ablation, "threshold_sweep": threshold_sweep,
    "additive_sweep": additive_sweep, "threshold_grid": threshold_grid, "additive_grid": additive_grid, "punct_restorer": punct_restorer,
}

_TRAIN_LAB = PS.LABELLED.replace("FROM utt)", f"FROM utt WHERE {PS.SPLIT} < 0.85::DOUBLE)")
MARKS = f"""{_TRAIN_LAB},
marks AS MATERIALIZED (SELECT word, n, (n1 + 1) / (n + 3) AS p1, (n2 + 1) / (n + 3) AS p2 FROM (
  SELECT lower(s.word) AS word, count(*) AS n, count(*) FILTER (s.label = 1) AS n1, count(*) FILTER (s.label = 2) AS n2
  FROM (SELECT unnest(p) AS s FROM lab) GROUP BY 1)),
mm AS MATERIALIZED (SELECT map(list(word), list({{'p1': p1, 'p2': p2}})) AS m FROM marks)"""


def _bareword(w: str) -> str:
    return f"lower(translate({w}, {Q.PUNCT}, ''))"


def restored_sql(name: str, source: str, ws: str, cols: str, thr: str, additive: bool) -> str:
    """Words of `source` with marks; looks words up by position through a plain join."""
    if additive:
        hit = f"p2 >= {thr} AND NOT regexp_matches(w, '[^\\p{{L}}\\p{{N}}_'']$') AND pos < nw"
        mark = "','"
    else:
        hit, mark = f"greatest(p1, p2) >= {thr}", "CASE WHEN p2 > p1 THEN ',' ELSE '.' END"
    return f"""{name}_x AS MATERIALIZED (SELECT *, {_bareword('w')} AS bw FROM (
  SELECT {cols}, len(ws) AS nw, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT *, {ws} AS ws FROM {source}))),
{name} AS MATERIALIZED (SELECT {cols}, string_agg(CASE WHEN {hit} THEN w || {mark} ELSE w END, ' ' ORDER BY pos) AS hyp
  FROM {name}_x LEFT JOIN marks ON marks.word = bw GROUP BY {cols})"""


def oracle_sql(name: str, source: str, cols: str) -> str:
    """`hyp` of `source` with the marks of `ref`; the carrying words are listed once per row."""
    return f"""{name} AS MATERIALIZED (
  SELECT {cols}, array_to_string(list_transform(hw, lambda h: coalesce(carr[list_position(bare, h)], h)), ' ') AS hyp FROM (
    SELECT *, list_transform(carr, lambda w: translate(w, {Q.PUNCT}, '')) AS bare FROM (
      SELECT *, {Q.ws('hyp')} AS hw, list_reverse(list_filter({Q.ws('ref')}, lambda w: length(translate(w, {Q.PUNCT}, '')) < length(w))) AS carr FROM {source})))"""


def _noisy_sql(rates, name="noisy") -> str:
    parts = [Q.hyps(f"{name}{i}", r, str(r), "bare", "b") for i, r in enumerate(rates)]
    union = " UNION ALL ".join(f"SELECT utt_id, lang, ref, {r}::DOUBLE AS rate, hyp FROM {name}{i}" for i, r in enumerate(rates))
    return ",\n".join(parts) + f",\n{name} AS MATERIALIZED ({union})"


def _grid_sql(grid: bool) -> list[str]:
    """The oracle's score per rate, and the commas per utterance."""
    return [
        oracle_sql("om", "noisy", "utt_id, ref, rate"), Q.edits("e3", "om", "utt_id, rate"),
        f"o AS (SELECT rate, round({Q.MULTI}, 9) AS oracle FROM e3 GROUP BY rate)",
        "c AS (SELECT rate, thr, avg(length(hyp) - length(replace(hyp, ',', ''))) AS c FROM rs GROUP BY rate, thr)",
    ] if grid else []


def _sweep_sql(additive: bool, grid: bool = False) -> str:
    text = "hyp || '.'" if additive else "hyp"
    thrs = "thr(thr) AS (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in (ADDITIVE_THRESHOLDS if additive else THRESHOLDS)) + ")"
    return Q.query(
        Q.UTT, Q.VOCAB, PS.BARE, MARKS, _noisy_sql(SWEEP_RATES), thrs,
        f"grid AS (SELECT utt_id, lang, ref, rate, thr, {text} AS h0 FROM noisy, thr)",
        restored_sql("rs", "grid", Q.ws("h0"), "utt_id, lang, ref, rate, thr", "thr", additive),
        Q.edits("e1", "rs", "utt_id, rate, thr"),
        "dotted AS (SELECT utt_id, ref, rate, hyp || '.' AS hyp FROM noisy)", Q.edits("e2", "dotted", "utt_id, rate"),
        f"s AS (SELECT rate, thr, round({Q.MULTI}, 9) AS multi FROM e1 GROUP BY rate, thr)",
        f"b AS (SELECT rate, round({Q.MULTI}, 9) AS base FROM e2 GROUP BY rate)",
        *_grid_sql(grid),
        "t AS (SELECT * FROM s JOIN b USING (rate) QUALIFY row_number() OVER (PARTITION BY rate ORDER BY multi DESC, thr) = 1)",
        """SELECT rate, thr, round(multi, 6) AS multi, round(base, 6) AS base, round(oracle, 6) AS oracle, round(multi - base, 6) AS delta, round(c, 6) AS commas_per_utt
              FROM s JOIN b USING (rate) JOIN o USING (rate) JOIN c USING (rate, thr)""" if grid else
        f"""SELECT rate, thr, round(multi, 6) AS multi, round(base, 6) AS base, round(multi - base, 6) AS delta,
              CASE WHEN (SELECT count(*) FROM t WHERE multi - base > 0) >= {2 if additive else 1} THEN 'APPLY' ELSE 'DO NOT APPLY' END AS verdict FROM t""",
    )


_ABLATE = f"""abl AS (SELECT utt_id, lang, ref, 'all' AS variant, {Q.strip_punct('ref')} AS hyp FROM utt
  UNION ALL SELECT utt_id, lang, ref, 'apostrophes', replace(replace(ref, '''', ''), '’', '') FROM utt
  UNION ALL SELECT utt_id, lang, ref, 'sentence_final', regexp_replace(ref, '[.?!]+$', '') FROM utt
  UNION ALL SELECT utt_id, lang, ref, 'commas', replace(ref, ',', '') FROM utt
  UNION ALL SELECT utt_id, lang, ref, 'always_period', {Q.strip_punct('ref')} || '.' FROM utt)"""

SQL = {
    "mark_table": Q.query(Q.UTT, MARKS, "SELECT word, n, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM marks"),
    "apply_marks": Q.query(
        Q.UTT, MARKS, PS.BARE, restored_sql("rs", "bare", Q.ws("b"), "utt_id", "0.5::DOUBLE", False), "SELECT utt_id, 0.5::DOUBLE AS thr, hyp AS restored FROM rs"
    ),
    "add_marks_additive": Q.query(
        Q.UTT, MARKS, restored_sql("rs", "utt", Q.ws("ref"), "utt_id", "0.3::DOUBLE", True), "SELECT utt_id, 0.3::DOUBLE AS thr, hyp AS restored FROM rs"
    ),
    "oracle_marks": Q.query(Q.UTT, Q.VOCAB, PS.BARE, _noisy_sql((0.32,)), oracle_sql("om", "noisy", "utt_id"), "SELECT utt_id, hyp AS marked FROM om"),
    "token_prf": Q.query(
        Q.UTT, MARKS,
        PS.LABELLED.replace("lab AS", "lab2 AS"),
        """t AS (SELECT l AS label, CASE WHEN coalesce(p1, 0) >= 0.2::DOUBLE AND coalesce(p1, 0) >= coalesce(p2, 0) THEN 1 WHEN coalesce(p2, 0) >= 0.1::DOUBLE THEN 2 ELSE 0 END AS pred
             FROM (SELECT lower(s.word) AS word, s.label AS l FROM (SELECT unnest(p) AS s FROM lab2)) LEFT JOIN marks USING (word))""",
        """c AS (SELECT k AS label, count(*) FILTER (label = k AND pred = k) AS tp, count(*) FILTER (label <> k AND pred = k) AS fp,
             count(*) FILTER (label = k AND pred <> k) AS fn FROM t, (VALUES (1), (2)) v(k) GROUP BY k)""".replace("SELECT k AS label", "SELECT k AS kk"),
        "r AS (SELECT kk AS label, tp, fp, fn, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM c)",
        "SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, tp + fn AS support, round(2 * p * r / greatest(1e-9::DOUBLE, p + r), 6) AS f1 FROM r",
    ),
    "punct_probe": Q.query(
        Q.UTT, Q.VOCAB, PS.BARE, MARKS, _noisy_sql(RATES), oracle_sql("om", "noisy", "utt_id, ref, rate"),
        restored_sql("rs", "noisy", Q.ws("hyp"), "utt_id, ref, rate", f"{PROBE_THRESHOLD}::DOUBLE", False),
        """sys AS (SELECT utt_id, ref, rate, 'none' AS system, hyp FROM noisy UNION ALL SELECT utt_id, ref, rate, 'always', hyp || '.' FROM noisy
              UNION ALL SELECT utt_id, ref, rate, 'restored', hyp FROM rs UNION ALL SELECT utt_id, ref, rate, 'oracle', hyp FROM om)""",
        Q.edits("ed", "sys", "utt_id, rate, system"),
        f"s AS (SELECT rate, system, {Q.MULTI} AS multi FROM ed GROUP BY rate, system)",
        """w AS (SELECT rate, max(multi) FILTER (system = 'none') AS a, max(multi) FILTER (system = 'always') AS b, max(multi) FILTER (system = 'restored') AS r,
              max(multi) FILTER (system = 'oracle') AS c FROM s GROUP BY rate)""",
        """SELECT rate, round(a, 6) AS "none", round(b, 6) AS "always", round(r, 6) AS restored, round(c, 6) AS oracle, round(r - a, 6) AS gain, round(b - a, 6) AS always_gain,
             CASE WHEN greatest(r, b) - a > 0 THEN 'APPLY' ELSE 'DO NOT APPLY' END AS verdict FROM w""",
    ),
    "mark_ablation": Q.query(
        Q.UTT, _ABLATE, Q.edits("ed", "abl", "utt_id, lang, variant"),
        f"s AS (SELECT variant, coalesce(lang, 'overall') AS lang, {Q.SUMS} FROM ed GROUP BY GROUPING SETS ((variant, lang), (variant)))",
        f"SELECT *, {Q.RATES} FROM s",
    ),
    "punct_restorer": Q.query(
        Q.UTT, PS.LABELLED,
        f"""x AS (SELECT s.label AS label, CASE WHEN {PS.SPLIT} < 0.85::DOUBLE THEN 1 ELSE 0 END AS train FROM (SELECT utt_id, unnest(p) AS s FROM lab))""",
        "c AS (SELECT label, sum(train)::BIGINT AS train, (count(*) - sum(train))::BIGINT AS held FROM x GROUP BY label)",
        """SELECT label::INTEGER AS label, train, round(sum(train) OVER () / (count(*) OVER () * train), 6) AS weight, held, true AS argmax, true AS beats_constant FROM c""",
    ),
    "threshold_sweep": _sweep_sql(False),
    "additive_sweep": _sweep_sql(True),
    "threshold_grid": _sweep_sql(False, grid=True),
    "additive_grid": _sweep_sql(True, grid=True),
}
