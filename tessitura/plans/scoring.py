"""Queries over edit counts, sampling and text statistics of systems' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.functions.draws import draw, unit
from tessitura.functions.words import n_words, punct_labels
from tessitura.operators import profile as P
from tessitura.operators import sampling as A
from tessitura.operators import scoring as S
from tessitura.plans import sql as Q
from tessitura.plans import views as V
from tessitura.sources import readers as R

ROUNDED = ("wer", "cer", "multi")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in (cols or ROUNDED)})


def counts(spark: SparkSession, sf_dir: str, rate: float = V.RATE, system: str = "s1") -> DataFrame:
    pairs = V.hyps(spark, sf_dir, rate, system).select("utt_id", "lang", "ref", "hyp")
    return S.edit_counts(pairs)


def edit_counts(spark, sf_dir):
    return counts(spark, sf_dir)


def score_by_language(spark, sf_dir):
    return rounded(S.score_by_language(counts(spark, sf_dir)))


def pooled_score(spark, sf_dir):
    return rounded(S.pooled_score(counts(spark, sf_dir)))


def word_share(spark, sf_dir):
    return rounded(S.word_share(counts(spark, sf_dir)), "share")


def reweight_to_mix(spark, sf_dir):
    scores = S.pooled_score(counts(spark, sf_dir), ["lang"])
    # The target mix is measured on the ids of one source, as a test list would be.
    ids = V.utterances(spark, sf_dir).where(F.col("source") == "src1").select("utt_id")
    mix = P.mix_from_ids(ids, list(V.LANGS)).select("lang", F.col("n").alias("weight"))
    out = None
    for mode in ("exact", "compat"):
        row = S.reweight_to_mix(scores, mix, mode).withColumn("mode", F.lit(mode))
        out = row if out is None else out.unionByName(row)
    return rounded(out)


def mix_from_ids(spark, sf_dir):
    return rounded(P.mix_from_ids(V.utterances(spark, sf_dir), list(V.LANGS[:3])), "share")


def _validation(spark, sf_dir):
    return V.utterances(spark, sf_dir).where(V.original_split(F.col("utt_id")) == "validation")


def _target_mix(spark, name="share"):
    return spark.createDataFrame(list(V.TARGET_MIX.items()), f"lang string, {name} double")


def devset(spark, sf_dir):
    return A.stratified_devset(_validation(spark, sf_dir), _target_mix(spark), "utt_id", 900, 1337)


def stratified_devset(spark, sf_dir):
    return devset(spark, sf_dir).select("utt_id", "lang", "ref")


def devset_shortage(spark, sf_dir):
    return A.devset_shortage(_validation(spark, sf_dir), _target_mix(spark), 900)


def explode_eval_manifest(spark, sf_dir):
    item = F.struct(F.col("utt_id").alias("id"), F.col("lang").alias("language"), F.col("ref").alias("reference"))
    # A dev-set manifest is one JSON object that holds the 900 items.
    manifest = devset(spark, sf_dir).agg(F.collect_list(item).alias("items")).select(
        F.to_json(F.struct(F.lit(1337).alias("seed"), F.size("items").alias("n"), F.lit("validation").alias("source"), "items")).alias("value")
    )
    return R.explode_manifest(manifest)


def _dev_counts(spark, sf_dir):
    pairs = V.with_hyps(devset(spark, sf_dir), V.vocabulary(spark, sf_dir))
    return S.edit_counts(pairs.select("utt_id", "lang", "ref", "hyp"))


def bootstrap_ci(spark, sf_dir):
    return rounded(S.bootstrap_ci(_dev_counts(spark, sf_dir), "utt_id", 400, 1337), "lo", "hi")


def bootstrap_poisson(spark, sf_dir):
    return rounded(S.bootstrap_ci(counts(spark, sf_dir), "utt_id", 400, 1337, mode="poisson"), "lo", "hi")


def plus_period_by_lang(spark, sf_dir):
    # The simulated recogniser writes no marks, so a period can help.
    rows = V.utterances(spark, sf_dir).withColumn("bare", T.strip_punct(F.col("ref"))).where(F.col("bare") != "")
    hyp = V.with_hyps(rows, V.vocabulary(spark, sf_dir), text="bare").select("utt_id", "lang", "ref", "hyp")
    # Both are scored in one pass over the rows.
    systems = {"base": F.col("hyp"), "plus_period": T.append_period(F.col("hyp"), "nonblank")}
    scores = S.score_by_language(S.edit_counts_of(hyp.select("lang", "ref", "hyp"), systems, name="system"), ["system"])
    of = lambda s: F.max(F.when(F.col("system") == s, F.col("multi"))).alias(s)
    out = scores.where("lang IS NOT NULL").groupBy("lang").agg(*[of(s) for s in systems]).withColumn("delta", F.col("plus_period") - F.col("base"))
    return rounded(out, "base", "plus_period", "delta")


def corrupt_words(spark, sf_dir):
    return V.hyps(spark, sf_dir).select("utt_id", "hyp")


def corrupt_labelled(spark, sf_dir):
    rows = V.utterances(spark, sf_dir).select("utt_id", punct_labels(F.col("ref")).alias("p")).where(F.size("p") > 0)
    noisy = A.corrupt_labelled(rows, F.col("p"), "utt_id", V.vocabulary(spark, sf_dir), "lab", epoch=2, out="p")
    return noisy.select(
        "utt_id", F.array_join("p.word", " ").alias("words"), F.array_join(F.col("p.label").cast("array<string>"), "").alias("labels")
    )


def holdout_split(spark, sf_dir):
    rows = A.holdout_split(V.utterances(spark, sf_dir), "utt_id", 0.15)
    return rows.groupBy("lang", "held").agg(F.count("*").alias("n"))


def mixture_sample(spark, sf_dir):
    utts = V.utterances(spark, sf_dir).select("utt_id", "lang")
    n = V.utterances(spark, sf_dir).agg(F.count("*")).scalar()
    return A.mixture_sample(utts, _target_mix(spark, "weight"), "utt_id", n).select("utt_id", "lang", "rank", "copy")


def length_buckets(spark, sf_dir):
    rows = V.utterances(spark, sf_dir).select("utt_id", "lang", n_words(F.col("ref")).alias("len"))
    return rounded(A.padding_waste(A.length_buckets(rows, "len", "utt_id", 16), "len"), "padding")


def punct_density(spark, sf_dir):
    out = P.punct_density(V.utterances(spark, sf_dir), "ref", ["lang"])
    return rounded(out, "periods_per_row", "commas_per_row", "periods_per_1000", "commas_per_1000", "end_period_share")


def suspicious_rows(spark, sf_dir):
    return rounded(P.suspicious_rows(V.table(spark, sf_dir, "documents"), "text", ["source"]), "mean_chars")


def repetition_rate(spark, sf_dir):
    return rounded(P.repeated_gram_share(V.utterances(spark, sf_dir), "ref"), "rate")


def row_repetition_rate(spark, sf_dir):
    return rounded(P.repetition_rate(V.utterances(spark, sf_dir), "ref", "utt_id"), "rate")


def token_jaccard(spark, sf_dir):
    vocab = V.vocabulary(spark, sf_dir)
    one = V.with_hyps(V.utterances(spark, sf_dir), vocab, 0.25, "s1").withColumnRenamed("hyp", "a")
    two = V.with_hyps(one, vocab, 0.4, "s2")
    return rounded(P.token_jaccard(two, "a", "hyp", ["lang"]), "mean_jaccard", "pooled_jaccard")


def glued_token_rate(spark, sf_dir):
    # A recogniser that loses one word boundary in thirty.
    def with_gap(w, i):
        kept = (i > 0) & (unit(draw("glue", F.col("utt_id"), i)) >= 1 / 30)
        return F.concat(F.when(kept, F.lit(" ")).otherwise(F.lit("")), w)

    rows = V.utterances(spark, sf_dir).withColumn("hyp", F.array_join(F.transform(F.split("ref", " "), with_gap), ""))
    return rounded(P.glued_token_rate(rows, "ref", "hyp", ["lang"]), "rate")


def oov_rate(spark, sf_dir):
    train = V.utterances(spark, sf_dir).where(V.original_split(F.col("utt_id")) == "train")
    vocab = P.word_counts(train, "ref").where("n >= 2")
    return rounded(P.oov_rate(V.hyps(spark, sf_dir), vocab), "rate")


QUERIES = {
    "edit_counts": edit_counts, "score_by_language": score_by_language, "pooled_score": pooled_score,
    "word_share": word_share, "reweight_to_mix": reweight_to_mix, "mix_from_ids": mix_from_ids,
    "stratified_devset": stratified_devset, "devset_shortage": devset_shortage,
    "explode_eval_manifest": explode_eval_manifest, "bootstrap_ci": bootstrap_ci, "bootstrap_poisson": bootstrap_poisson,
    "plus_period_by_lang": plus_period_by_lang, "corrupt_words": corrupt_words, "corrupt_labelled": corrupt_labelled,
    "holdout_split": holdout_split, "mixture_sample": mixture_sample, "length_buckets": length_buckets,
    "punct_density": punct_density, "suspicious_rows": suspicious_rows, "repetition_rate": repetition_rate,
    "row_repetition_rate": row_repetition_rate, "token_jaccard": token_jaccard, "glued_token_rate": glued_token_rate,
    "oov_rate": oov_rate,
}

_SCORES = f"s AS (SELECT coalesce(lang, 'overall') AS lang, {Q.SUMS} FROM ed GROUP BY GROUPING SETS ((lang), ()))"
SPLIT = Q.unit(Q.draw("split", "utt_id"))
MIX = "mix(lang, share) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in V.TARGET_MIX.items()) + ")"
DEV = f"""dev AS MATERIALIZED (SELECT * EXCLUDE (rn, share) FROM (SELECT utt.*, share, row_number() OVER (PARTITION BY lang ORDER BY {Q.draw(1337, 'utt_id')}, utt_id) AS rn
  FROM utt JOIN mix USING (lang) WHERE {SPLIT} >= 0.85::DOUBLE) WHERE rn <= round_even(share * 900, 0))"""
_CDF = "[" + ", ".join(repr(c) + "::DOUBLE" for c in S.POISSON_STEPS) + "]"
_BOOT = "1 - 0.5::DOUBLE * we / rw - 0.5::DOUBLE * ce / rc"
BARE = f"bare AS MATERIALIZED (SELECT * FROM (SELECT *, {Q.strip_punct('ref')} AS b FROM utt) WHERE b <> '')"
LABELLED = f"""lab AS MATERIALIZED (
  SELECT utt_id, lang, list_filter(list_transform(string_split(ref, ' '), lambda t: {{'word': translate(t, {Q.PUNCT}, ''),
    'label': CASE WHEN suffix(t, '.') THEN 1 WHEN suffix(t, ',') THEN 2 ELSE 0 END}}), lambda s: s.word <> '') AS p FROM utt)"""
_MANY = "len(regexp_extract_all(text, '" + Q.NOT_SPACE + "'))"


def _noisy_labelled() -> str:
    key = "(utt_id || '#2')"
    u = Q.unit("h")
    return f"""rated AS MATERIALIZED (SELECT utt_id, p, CASE WHEN {Q.unit('rh')} < 0.15::DOUBLE THEN 0::DOUBLE ELSE 0.1::DOUBLE + {Q.unit('rh', 1)} * 0.35::DOUBLE END AS rate
      FROM (SELECT *, {Q.draw('lab', key, "'rate'")} AS rh FROM lab WHERE len(p) > 0)),
    sized AS MATERIALIZED (SELECT count(*) AS n FROM vocab),
    placed AS MATERIALIZED (SELECT *, {Q.whole('h', 1)} % n AS k FROM (
      SELECT *, {Q.draw('lab', key, 'i')} AS h FROM (SELECT utt_id, rate, unnest(p) AS s, unnest(range(len(p))) AS i FROM rated)), sized),
    pieces AS (SELECT utt_id, i, CASE WHEN {u} < rate * 0.7::DOUBLE THEN word WHEN {u} < rate * 0.9::DOUBLE THEN NULL WHEN {u} < rate THEN s.word || ' ' || word ELSE s.word END AS w,
        CASE WHEN {u} < rate * 0.7::DOUBLE THEN '0' WHEN {u} < rate * 0.9::DOUBLE THEN NULL WHEN {u} < rate THEN s.label || '0' ELSE s.label::VARCHAR END AS l
      FROM placed JOIN vocab ON idx = k),
    noisy AS (SELECT utt_id, string_agg(w, ' ' ORDER BY i) AS words, string_agg(l, '' ORDER BY i) AS labels FROM pieces GROUP BY utt_id)"""


SQL = {
    "edit_counts": Q.query(Q.EDITS, "SELECT utt_id, lang, word_edits, ref_words, char_edits, ref_chars FROM ed"),
    "score_by_language": Q.query(Q.EDITS, _SCORES, f"SELECT *, {Q.RATES} FROM s"),
    "pooled_score": Q.query(Q.EDITS, f"s AS (SELECT {Q.SUMS} FROM ed)", f"SELECT *, {Q.RATES} FROM s"),
    "word_share": Q.query(Q.EDITS, "SELECT lang, sum(ref_words)::BIGINT AS ref_words, round(sum(ref_words) / sum(sum(ref_words)) OVER (), 6) AS share FROM ed GROUP BY lang"),
    "reweight_to_mix": Q.query(
        Q.EDITS, f"s AS (SELECT lang, {Q.SUMS} FROM ed GROUP BY lang)",
        "m AS (SELECT lang, count(*) AS weight FROM utt WHERE source = 'src1' GROUP BY lang)",
        """j AS (SELECT word_edits / ref_words AS wer, char_edits / ref_chars AS cer, ref_words / n * weight AS words, ref_chars / n * weight AS exact,
             ref_words / n * weight * 5.5::DOUBLE AS compat FROM s JOIN m USING (lang))""",
        """r AS (SELECT 'exact' AS mode, sum(wer * words) / sum(words) AS wer, sum(cer * exact) / sum(exact) AS cer FROM j
             UNION ALL SELECT 'compat', sum(wer * words) / sum(words), sum(cer * compat) / sum(compat) FROM j)""",
        "SELECT mode, round(wer, 6) AS wer, round(cer, 6) AS cer, round(0.5::DOUBLE * (1 - wer) + 0.5::DOUBLE * (1 - cer), 6) AS multi FROM r",
    ),
    "mix_from_ids": Q.query(Q.UTT, "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM utt WHERE lang IN ('en', 'fr', 'de') GROUP BY lang"),
    "stratified_devset": Q.query(Q.UTT, MIX, DEV, "SELECT utt_id, lang, ref FROM dev"),
    "devset_shortage": Q.query(
        Q.UTT, MIX,
        f"p AS (SELECT lang, count(*) AS pool FROM utt WHERE {SPLIT} >= 0.85::DOUBLE GROUP BY lang)",
        """SELECT lang, round_even(share * 900, 0)::BIGINT AS want, pool, least(round_even(share * 900, 0)::BIGINT, pool) AS take,
             pool < round_even(share * 900, 0) AS short FROM mix JOIN p USING (lang)""",
    ),
    "explode_eval_manifest": Q.query(
        Q.UTT, MIX, DEV, "SELECT 1337::BIGINT AS seed, (SELECT count(*) FROM dev) AS n, utt_id AS id, lang AS language, ref AS reference FROM dev"
    ),
    "bootstrap_ci": Q.query(
        Q.UTT, Q.VOCAB, MIX, DEV, Q.hyps("dh", source="dev"), Q.edits("ed", "dh", "utt_id, lang"),
        "num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY utt_id) AS idx FROM ed)",
        f"grid AS (SELECT rep, ({Q.whole(Q.draw(1337, 'rep', 'k'))} % (SELECT count(*) FROM ed)) + 1 AS idx FROM range(1, 401) a(rep), (SELECT idx AS k FROM num))",
        "b AS (SELECT rep, sum(word_edits) AS we, sum(ref_words) AS rw, sum(char_edits) AS ce, sum(ref_chars) AS rc FROM grid JOIN num USING (idx) GROUP BY rep)",
        f"SELECT count(*) AS n_boot, round(quantile_cont({_BOOT}, 0.025), 6) AS lo, round(quantile_cont({_BOOT}, 0.975), 6) AS hi FROM b",
    ),
    "bootstrap_poisson": Q.query(
        Q.EDITS,
        f"""w AS (SELECT *, len(list_filter({_CDF}, lambda c: u >= c)) AS w FROM (
              SELECT rep, ed.*, {Q.unit(Q.draw(1337, 'utt_id', 'rep'))} AS u FROM ed, range(1, 401) a(rep)))""",
        "b AS (SELECT rep, sum(word_edits * w) AS we, sum(ref_words * w) AS rw, sum(char_edits * w) AS ce, sum(ref_chars * w) AS rc FROM w GROUP BY rep)",
        f"SELECT count(*) AS n_boot, round(quantile_cont({_BOOT}, 0.025), 6) AS lo, round(quantile_cont({_BOOT}, 0.975), 6) AS hi FROM b",
    ),
    "plus_period_by_lang": Q.query(
        Q.UTT, Q.VOCAB, BARE, Q.hyps("bh", source="bare", text="b"), Q.edits("e1", "bh", "utt_id, lang"),
        "dotted AS (SELECT utt_id, lang, ref, hyp || '.' AS hyp FROM bh)", Q.edits("e2", "dotted", "utt_id, lang"),
        f"a AS (SELECT coalesce(lang, 'overall') AS lang, {Q.MULTI} AS base FROM e1 GROUP BY GROUPING SETS ((lang), ()))",
        f"b AS (SELECT coalesce(lang, 'overall') AS lang, {Q.MULTI} AS plus FROM e2 GROUP BY GROUPING SETS ((lang), ()))",
        "SELECT lang, round(base, 6) AS base, round(plus, 6) AS plus_period, round(plus - base, 6) AS delta FROM a JOIN b USING (lang)",
    ),
    "corrupt_words": Q.query(Q.HYPS, "SELECT utt_id, hyp FROM hyps"),
    "corrupt_labelled": Q.query(
        Q.UTT, Q.VOCAB, LABELLED, _noisy_labelled(),
        f"""SELECT utt_id, coalesce(words, word) AS words, coalesce(labels, '0') AS labels FROM (
              SELECT *, {Q.whole(Q.draw('lab', "(utt_id || '#2')", "'empty'"), 1)} % n AS k FROM noisy, sized) JOIN vocab ON idx = k""",
    ),
    "holdout_split": Q.query(Q.UTT, f"SELECT lang, {Q.unit(Q.draw(1337, 'utt_id'))} < 0.15::DOUBLE AS held, count(*) AS n FROM utt GROUP BY ALL"),
    "mixture_sample": Q.query(
        Q.UTT, MIX,
        """q AS (SELECT lang, pool, round_even(share / (sum(share) OVER ()) * (SELECT count(*) FROM utt), 0)::BIGINT AS quota
             FROM (SELECT lang, count(*) AS pool FROM utt GROUP BY lang) JOIN mix USING (lang))""",
        f"r AS (SELECT utt_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {Q.draw(1337, 'utt_id')}) - 1 AS rank FROM utt)",
        """SELECT utt_id, lang, rank, unnest(range(1, c + 1)) AS copy FROM (
             SELECT r.*, quota // pool + CASE WHEN rank < quota % pool THEN 1 ELSE 0 END AS c FROM r JOIN q USING (lang)) WHERE c > 0""",
    ),
    "length_buckets": Q.query(
        Q.UTT,
        f"""l AS (SELECT lang, len, (row_number() OVER (PARTITION BY lang ORDER BY len, {Q.draw(0, 'utt_id')}) - 1) // 16 AS batch
              FROM (SELECT *, {Q.nw('ref')} AS len FROM utt))""",
        "b AS (SELECT lang, batch, sum(len) AS used, max(len) * count(*) AS cells FROM l GROUP BY ALL)",
        "SELECT lang, count(*) AS batches, round(1 - sum(used) / sum(cells), 6) AS padding FROM b GROUP BY lang",
    ),
    "punct_density": Q.query(
        Q.UTT,
        f"""s AS (SELECT lang, count(*) AS n, sum({Q.nw('ref')})::BIGINT AS words, sum(length(ref) - length(replace(ref, '.', '')))::BIGINT AS periods,
             sum(length(ref) - length(replace(ref, ',', '')))::BIGINT AS commas,
             sum(2 * length(ref) - length(replace(ref, '''', '')) - length(replace(ref, '’', '')))::BIGINT AS apostrophes,
             count(*) FILTER (suffix(ref, '.')) AS end_period, count(*) FILTER (regexp_matches(ref, '[.?!]$')) AS end_any,
             count(*) FILTER (trim(ref) = '') AS blanks FROM utt GROUP BY lang)""",
        """SELECT *, round(periods / n, 6) AS periods_per_row, round(commas / n, 6) AS commas_per_row, round(1000 * periods / words, 6) AS periods_per_1000,
             round(1000 * commas / words, 6) AS commas_per_1000, round(end_period / n, 6) AS end_period_share FROM s""",
    ),
    "suspicious_rows": rf"""SELECT source, count(*) AS n, count(*) FILTER (trim(text) IN ('', 'nan', 'a')) AS blank_like, round(avg(length(text)), 6) AS mean_chars,
        max({_MANY}) AS max_words, count(*) FILTER ({_MANY} > 200) AS loops, count(*) FILTER (regexp_matches(text, '[\[\]<>]')) AS bracketed
        FROM documents GROUP BY source""",
    "repetition_rate": Q.query(
        Q.UTT,
        "g AS (SELECT lang, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS gram FROM (SELECT lang, string_split(ref, ' ') AS w FROM utt))",
        "c AS (SELECT lang, gram, count(*) AS c FROM g GROUP BY ALL)",
        """SELECT lang, sum(c)::BIGINT AS grams, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS repeated,
             round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6) AS rate FROM c GROUP BY lang""",
    ),
    "row_repetition_rate": Q.query(
        Q.UTT,
        "g AS (SELECT lang, list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) AS g FROM (SELECT lang, string_split(ref, ' ') AS w FROM utt))",
        """SELECT lang, sum(len(g))::BIGINT AS grams, sum(len(g) - len(list_distinct(g)))::BIGINT AS repeats,
             round(sum(len(g) - len(list_distinct(g))) / sum(len(g)), 6) AS rate FROM g GROUP BY lang""",
    ),
    "token_jaccard": Q.query(
        Q.HYPS, Q.hyps("h2", 0.4, "s2"),
        f"t AS (SELECT hyps.lang, list_distinct({Q.ws('hyps.hyp')}) AS x, list_distinct({Q.ws('h2.hyp')}) AS y FROM hyps JOIN h2 USING (utt_id))",
        "c AS (SELECT lang, len(list_intersect(x, y)) AS b, len(list_distinct(list_concat(x, y))) AS e FROM t)",
        "SELECT lang, count(*) AS n, round(avg(CASE WHEN e = 0 THEN 1 ELSE b / e END), 6) AS mean_jaccard, round(sum(b) / sum(e), 6) AS pooled_jaccard FROM c GROUP BY lang",
    ),
    "glued_token_rate": Q.query(
        Q.UTT,
        f"""g AS (SELECT lang, w, string_split(array_to_string(list_transform(w, lambda x, i:
              CASE WHEN i > 1 AND {Q.unit(Q.draw('glue', 'utt_id', '(i - 1)'))} >= {1 / 30!r}::DOUBLE THEN ' ' || x ELSE x END), ''), ' ') AS h
             FROM (SELECT utt_id, lang, string_split(ref, ' ') AS w FROM utt))""",
        """c AS (SELECT lang, len(h) AS t, len(list_filter(h, lambda x: list_contains(gl, x))) AS gl FROM (
             SELECT lang, h, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || w[i+1])) AS gl FROM g))""",
        "SELECT lang, sum(t)::BIGINT AS tokens, sum(gl)::BIGINT AS glued, round(sum(gl) / sum(t), 6) AS rate FROM c GROUP BY lang",
    ),
    "oov_rate": Q.query(
        Q.HYPS,
        f"""v AS (SELECT lang, word FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({Q.ws('ref')}) AS word FROM utt WHERE {SPLIT} < 0.85::DOUBLE) GROUP BY lang, word) WHERE n >= 2)""",
        f"t AS (SELECT lang, unnest({Q.ws('hyp')}) AS word FROM hyps)",
        """SELECT t.lang, count(*) AS tokens, count(*) FILTER (v.word IS NULL) AS oov, round(count(*) FILTER (v.word IS NULL) / count(*), 6) AS rate
           FROM t LEFT JOIN v USING (lang, word) GROUP BY t.lang""",
    ),
}
