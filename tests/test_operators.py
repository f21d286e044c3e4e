import hashlib
import json
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.operators import corpus as C
from tessitura.operators import experiments as E
from tessitura.operators import frames as L
from tessitura.operators import joins as J
from tessitura.operators import lid
from tessitura.operators import ngram as N
from tessitura.operators import profile as P
from tessitura.operators import punct as U
from tessitura.operators import routing as R
from tessitura.operators import sampling as A
from tessitura.operators import scoring as S
from tessitura.operators import validation as V
from tessitura.session import settled

# reference, hypothesis, and by hand: word edits, reference words, character edits, reference characters
COUNTED = [
    ("the cat sat", "the cat sat", 0, 3, 0, 11),
    ("the cat sat", "the hat", 2, 3, 5, 11),
    ("go", "go on now", 2, 1, 7, 2),
    ("Old OAK", "old oak", 0, 2, 0, 7),
    ("señor", "senor", 1, 1, 1, 5),
    ("so, yes.", "so yes", 2, 2, 2, 8),
    ("one two", None, 2, 2, 7, 7),
]


def counted(spark, pairs, **kw):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, ref string, hyp string")
    return S.edit_counts(rows, **kw)


def test_coverage_read_as_several_scalars_counts_only_matches(spark):
    ids = lambda where: spark.range(10).where(where).select(F.concat_ws("_", F.lit("u"), "id").alias("ID"))
    # Settled, as hypotheses are: the planner then merges all three scalars.
    hyps = settled(ids("id % 5 > 0"), {"x": F.col("ID")}).select("ID")
    pairs, coverage = S.score_pairs(ids("id >= 0"), hyps, "ID")
    read = pairs.groupBy().agg(F.count("*").alias("n")).select("n", *[coverage.select(c).scalar().alias(c) for c in coverage.columns])
    assert [tuple(r) for r in read.collect()] == [(8, 10, 8, 0.8)]
    twice = spark.sql("SELECT * FROM VALUES ('u_1'), ('u_1'), (NULL), ('v') AS t(ID)")
    assert [tuple(r) for r in S.score_pairs(ids("id < 2"), twice, "ID")[1].collect()] == [(3, 2, 2 / 3)]


def test_edits_of_hand_counted_pairs(spark):
    got = counted(spark, [c[:2] for c in COUNTED]).orderBy("id").collect()
    assert [tuple(r[c] for c in S.EDITS) for r in got] == [c[2:] for c in COUNTED]
    assert counted(spark, [("Old OAK", "old oak")], case_sensitive=True).first()["word_edits"] == 2


def test_pooled_scores_are_ratios_of_sums(spark):
    rows = counted(spark, [c[:2] for c in COUNTED]).withColumn("part", F.col("id") % 3)
    w, n, c, m = (sum(x[k] for x in COUNTED) for k in (2, 3, 4, 5))
    whole = S.pooled_score(rows).first()
    assert abs(whole["multi"] - (1 - w / n / 2 - c / m / 2)) < 1e-12
    parts = S.pooled_score(rows, ["part"]).agg(*[F.sum(e).alias(e) for e in S.EDITS]).first()
    assert [parts[e] for e in S.EDITS] == [whole[e] for e in S.EDITS]


def test_more_errors_never_score_better(spark):
    line = "p q r s t u v w".split()
    worse = [(" ".join(line), " ".join(["z"] * k + line[k:])) for k in range(len(line) + 1)]
    scores = [r["multi"] for r in S.pooled_score(counted(spark, worse), ["id"]).orderBy("id").collect()]
    assert scores[0] == 1.0 and all(a > b for a, b in zip(scores, scores[1:]))


def test_a_reference_must_have_text(spark):
    with pytest.raises(Exception, match="empty reference"):
        counted(spark, [(" ", "anything")]).collect()


@pytest.mark.parametrize("wer, cer, want", [(0.760125, 0.255986, 0.4919445), (0.4379, 0.1835, 0.6893), (0.9346, 0.3932, 0.3361)])
def test_score_formula(spark, wer, cer, want):
    row = spark.range(1).select(F.lit(wer).alias("wer"), F.lit(cer).alias("cer"), F.lit(want).alias("observed"), F.lit(want + 0.1).alias("dev"))
    got = E.calibration(row).first()
    assert got["verdict"] == "CONFIRMED" and got["use"] == "rank only" and abs(got["predicted"] - want) < 5e-4


@pytest.mark.parametrize(
    "mix, want, tol", [((1866, 1749, 638), 0.7964, 1e-4), ((13, 57, 1430), 0.8274, 1e-4), ((446, 445, 1), 0.78983, 2e-4)]
)
def test_reweighting(spark, mix, want, tol):
    rows = [("lin", 0.3110, 0.1234, 395, 23226 * 0.459), ("sna", 0.3269, 0.0771, 370, 23226 * 0.366), ("lug", 0.2830, 0.0597, 135, 23226 * 0.175)]
    scores = spark.createDataFrame(rows, "lang string, wer double, cer double, n int, ref_words double").withColumn("ref_chars", F.col("ref_words") * 5.5)
    weights = spark.createDataFrame(list(zip(("lin", "sna", "lug"), mix)), "lang string, weight int")
    for mode in ("compat", "exact"):
        assert abs(S.reweight_to_mix(scores, weights, mode).first()["multi"] - want) < tol


def test_projection_arithmetic(spark):
    rows = spark.createDataFrame([(0.0, 0.660), (0.2, 0.535), (0.3, 0.431), (0.35, 0.359)], "m double, p double")
    got = rows.select("p", E.implied_accuracy(F.lit(0.4919), F.lit(0.7453), F.col("m")).alias("got")).collect()
    assert all(abs(r["p"] - r["got"]) < 1e-3 for r in got)
    even = spark.range(1).select(E.implied_accuracy(F.lit(0.491944347), F.lit(0.725666538), F.lit(0.29581174)).alias("b")).first()["b"]
    assert abs(even - 0.4563) < 1e-4
    back = spark.range(1).select(E.invert(E.project(F.lit(0.6), F.lit(0.8), F.lit(0.3)), F.lit(0.6), F.lit(0.3)).alias("s")).first()["s"]
    assert abs(back - 0.8) < 1e-12


def test_bounds_and_falsification(spark):
    rows = [("h", "a", 0.9, 0.1), ("h", "b", 0.1, 0.9), ("k", "a", 0.9, 0.95), ("k", "b", 0.1, 0.05)]
    mixes = spark.createDataFrame(rows, "claim string, lang string, p double, q double")
    got = {r["claim"]: r for r in E.falsify_hypotheses(mixes, ["claim"], F.lit(0.5), F.lit(0.3), F.lit(0.7)).collect()}
    assert abs(got["h"]["hi"] - 0.2) < 1e-9 and abs(got["k"]["lo"] - 0.85) < 1e-9
    assert got["k"]["refuted"] and not got["h"]["refuted"]


def test_verdict(spark):
    rows = spark.createDataFrame([("lin", 7826099, 9025326), ("sna", 19367839, 5366168), ("lug", 7482535, 9168243), ("xx", 20, 100), ("yy", 1, 100)], "lang string, words bigint, target bigint")
    got = {r["lang"]: (round(r["pct"], 1), r["verdict"]) for r in C.corpus_verdict(rows.select("lang", "words"), rows.select("lang", "target")).collect()}
    assert got == {"lin": (86.7, "OK"), "sna": (360.9, "OK"), "lug": (81.6, "OK"), "xx": (20.0, "THIN"), "yy": (1.0, "TOO SMALL")}


def sequential_corpus(rows, sources):
    """The description followed line by line: `rows` are (lang, source, doc, no, sentence)."""
    out = []
    for lang in sorted({r[0] for r in rows}):
        seen = set()
        for name, priority, cap in sorted(sources, key=lambda s: s[1]):
            words, docs = 0, {}
            for r in rows:
                if r[0] == lang and r[1] == name:
                    docs.setdefault(r[2], []).append(r)
            for doc in sorted(docs):
                for r in sorted(docs[doc], key=lambda r: r[3]):
                    if priority and r[4] in seen:
                        continue
                    seen.add(r[4])
                    out.append(r)
                    words += len(r[4].split())
                if priority and cap and words >= cap:
                    break
    return sorted(out)


def test_prioritised_dedupe_with_caps_equals_the_sequential_reading(spark):
    import random

    rng = random.Random(3)
    sources = [("dom", 0, None), ("s1", 1, 12), ("s2", 2, None), ("s3", 3, 9), ("s4", 4, 1000)]
    rows = [
        (lang, s, doc, no, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))))
        for lang in ("en", "fr") for s, _, _ in sources for doc in range(8) for no in range(3)
    ]
    df = spark.createDataFrame(rows, "lang string, source string, doc_id bigint, sent_no int, sentence string")
    dims = spark.createDataFrame(sources, "source string, priority int, cap bigint")
    for parts in (1, 5):
        got = C.dedupe_prioritised(df.repartition(parts), dims).select("lang", "source", "doc_id", "sent_no", "sentence").collect()
        assert sorted(map(tuple, got)) == sequential_corpus(rows, sources)


def test_cap_keeps_the_crossing_document_whole(spark):
    rows = [("en", "s", d, n, "w w w") for d in (5, 9, 7, 100_000_000) for n in range(2)]
    df = spark.createDataFrame(rows, "lang string, source string, doc_id bigint, sent_no int, sentence string")
    caps = lambda cap: spark.createDataFrame([("s", cap)], "source string, cap bigint")
    kept = lambda cap: sorted({r["doc_id"] for r in C.cap_words(df, caps(cap)).collect()})
    assert kept(7) == [5, 7] and kept(6) == [5] and kept(24) == kept(999) == [5, 7, 9, 100_000_000]


def test_contains_holdout_finds_short_and_long_passages(spark):
    docs = spark.createDataFrame([(1, "Aa bb. cc dd ee ff gg"), (2, "xx bb cc"), (3, "aabb")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "bb. cc dd ee ff gg"), (2, "bb cc"), (3, "bb"), (4, "cc dd ee ff zz")], "item_id int, text string")
    assert sorted(map(tuple, C.contains_holdout(docs, items).collect())) == [(1, 1), (2, 2), (2, 3)]


def test_hash_rank_is_a_row_number(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    from pyspark.sql import Window

    want = rows.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("h")) - 1)
    got = A.hash_rank(rows, ["g"], "h", prefix=1).join(want, ["g", "h"])
    assert got.where("rank <> w").count() == 0 and got.count() == 500


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("k"), F.lit("a b c d").alias("t"))
    vocab = A.noise_vocabulary(spark.createDataFrame([("x y",), ("y z x",)], "t string"), "t")
    assert sorted(r["word"] for r in vocab.collect()) == ["x", "y", "z"] and sorted(r["idx"] for r in vocab.collect()) == [0, 1, 2]

    def noisy(parts, rate):
        out = A.corrupt_words(rows.repartition(parts), F.split("t", " "), "k", vocab, rate)
        return {r["k"]: r["noisy"] for r in out.collect()}

    assert noisy(1, 0.6) == noisy(7, 0.6) and {*sum(noisy(3, 0.6).values(), [])} == set("abcdxyz")
    assert set(map(tuple, noisy(2, 0.0).values())) == {("a", "b", "c", "d")}
    assert all(len(ws) >= 1 for ws in noisy(2, 1.0).values())


def test_mixture_repeats_short_strata(spark):
    rows = spark.createDataFrame([(f"k{i}", "en" if i < 9 else "fr") for i in range(10)], "k string, lang string")
    weights = spark.createDataFrame([("en", 0.5), ("fr", 0.5), ("de", 9.0)], "lang string, weight double")
    got = A.mixture_sample(rows, weights, "k", 8)
    assert {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()} == {"en": 4, "fr": 4}
    assert got.where("lang = 'fr'").select("k").distinct().count() == 1


def test_bootstrap_contains_the_point(spark):
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 4).alias("word_edits"), F.lit(10).cast("bigint").alias("ref_words"),
        (F.col("id") % 9).alias("char_edits"), F.lit(50).cast("bigint").alias("ref_chars"),
    )
    point = S.with_rates(rows.agg(*[F.sum(c).alias(c) for c in S.EDITS])).first()["multi"]
    for mode in ("exact", "poisson"):
        ci = S.bootstrap_ci(rows, "k", 60, mode=mode).first()
        assert ci["n_boot"] == 60 and ci["lo"] < point < ci["hi"]


def test_weights_stand_for_repeats(spark):
    rows = spark.createDataFrame([("en", "a b a", 3), ("en", "b", 1)], "lang string, sentence string, weight int")
    weighted = N.ngram_counts(rows, 3, F.col("weight"))
    repeated = N.ngram_counts(rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("weight")))), 3)
    assert weighted.exceptAll(repeated).count() == 0 and repeated.exceptAll(weighted).count() == 0


def test_kneser_ney_sums_to_one_per_context(spark):
    lines = ["a b c a", "b a", "c c a b", "a b", "d a b c"]
    rows = spark.createDataFrame([("en", s) for s in lines], "lang string, sentence string")
    adjusted = N.kn_continuations(N.ngram_counts(rows, 3), 3)
    model = N.kn_probabilities(adjusted, N.kn_discounts(adjusted), 3)
    table = {r["gram"]: (r["p"], r["bow"]) for r in model.collect()}
    assert abs(sum(p for g, (p, _) in table.items() if " " not in g and g != "<s>") - 1) < 1e-9
    predicted = [g for g in table if " " not in g and g != "<s>"]

    def prob(context, word):
        gram = " ".join([*context, word])
        if gram in table:
            return table[gram][0]
        return table.get(" ".join(context), (0, 1.0))[1] * prob(context[1:], word)

    for context in (["a"], ["<s>"], ["a", "b"], ["<s>", "b"]):
        assert abs(sum(prob(context, w) for w in predicted) - 1) < 1e-9
    scored = N.lm_score(spark.createDataFrame([(1, "en", "a b zz")], "k int, lang string, sentence string"), model, "k", 3).first()
    path = [(["<s>"], "a"), (["<s>", "a"], "b"), (["a", "b"], "<unk>"), (["b", "zz"], "</s>")]
    assert abs(scored["log10p"] - sum(math.log10(prob(c, w)) for c, w in path)) < 1e-9
    assert scored["oov"] == 1 and scored["tokens"] == 4


@pytest.mark.parametrize("order", [1, 2, 5])
def test_ngrams_of_every_order_are_counted_where_windows_meet(spark, order):
    rows = [("en", "a b a b", 1), ("en", "a b a b", 10), ("en", "", 2), ("fr", "a b", 1), ("en", "c", 3)]
    df = spark.createDataFrame(rows, "lang string, sentence string, w int")
    counts = N.ngram_counts(df, order, F.col("w"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    want = {}
    for lang, text, w in rows:
        p = ["<s>", *text.split(), "</s>"]
        for n in range(1, order + 1):
            for i in range(len(p) - n + 1):
                key = (lang, n, " ".join(p[i : i + n]))
                want[key] = want.get(key, 0) + w
    assert {(r["lang"], r["n"], r["gram"]): r["c"] for r in counts.collect()} == want
    # Equal lines are one row, and no gram above the first order travels by itself.
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert any("_line#" in k for k in keys)
    assert sum("gram#" in k for k in keys) == 1 and all(("_head#" in k) <= (order > 1) for k in keys)


def test_naive_bayes_counts_unseen_words(spark):
    train = [("en", "a a b"), ("en", "b c"), ("fr", "x y"), ("fr", "x a z z z z z z")]
    rows = spark.createDataFrame(train, "lang string, t string")
    model = lid.nb_fit(rows, "t", ["en", "fr"])
    test = spark.createDataFrame([(1, "a q"), (2, "z"), (3, " ")], "k int, t string")
    got = {(r["k"], r["model_lang"]): r["score"] for r in lid.nb_scores(test, "t", "k", model, ["en", "fr"]).collect()}
    assert abs(got[(1, "en")] - (math.log(0.5) + math.log(3 / 11) + math.log(1 / 11))) < 1e-9
    assert abs(got[(1, "fr")] - (math.log(0.5) + math.log(2 / 16) + math.log(1 / 16))) < 1e-9
    assert {r["k"]: r["lang"] for r in lid.nb_predict(test, "t", "k", model, ["en", "fr"]).collect()} == {1: "en", 2: "fr", 3: "??"}


@pytest.mark.parametrize("held", [0, 2, 1 << 19])
def test_naive_bayes_scores_inside_the_row(spark, monkeypatch, held):
    # However many words the tasks hold, scores are the same; rows that share a key are scored together.
    monkeypatch.setattr(lid, "HELD", held)
    train = spark.createDataFrame([("en", "the cat the dog the"), ("en", "the end"), ("fr", "le chat le chien"), ("fr", "le zoo")], "lang string, t string")
    rows = spark.createDataFrame([(1, "The dog  zoo zoo nowhere"), (1, "le\u00a0cat"), (2, "le"), (3, ""), (4, None)], "k int, t string")
    model = lid.nb_fit(train, "t", ["en", "fr", "de"])
    scored = lid.nb_score_rows(rows, "t", "k", model, ["en", "fr", "de"])
    got = {r["k"]: r for r in scored.collect()}
    counts = {"en": {"the": 4, "cat": 1, "dog": 1, "end": 1}, "fr": {"le": 3, "chat": 1, "chien": 1, "zoo": 1}}
    texts = {1: "the dog zoo zoo nowhere le cat".split(), 2: ["le"]}
    assert {k: (r["copies"], r["tokens"]) for k, r in got.items()} == {1: (2, 7), 2: (1, 1)}
    for k, ws in texts.items():
        want = {lg: math.log(1 / 2) + sum(math.log((c.get(w, 0) + 1) / (sum(c.values()) + 8)) for w in ws) for lg, c in counts.items()}
        assert got[k]["scores"].asDict() == pytest.approx(want)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == (0 if held > 2 else 1)


def test_hot_keys_join_like_any_other(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "i int, w string")
    table = spark.createDataFrame([("hot", 7)] + [(f"k{i}", i) for i in range(0, 60)], "w string, v int")
    got = {r["i"]: r["v"] for r in J.tiered_lookup(left, table, ["w"], "v", "i", share=0.5).collect()}
    assert got == {i: 7 if i % 3 else (i if i < 60 else None) for i in range(90)}


@pytest.mark.parametrize("known", [True, False])
def test_a_key_of_nine_rows_in_ten_stays_where_it_is(spark, known):
    # In the table or missing from it, the frequent key's rows spread over the join's partitions.
    left = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), "id")).otherwise("hot").alias("w"))
    table = spark.createDataFrame([("hot", 7)] * known + [(f"k{i}", i) for i in range(0, 4000, 20)], "w string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = J.tiered_lookup(left, table, ["w"], "v", "id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        hot = {r["v"] for r in joined.where("w = 'hot'").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert hot == ({7} if known else {None}) and sum(sizes) == 4000 and max(sizes) < 2 * 4000 / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_routing_rules(spark):
    rows = [("u", "en", 1.0), ("u", "fr", 1.0), ("v", "en", 0.0), ("v", "fr", 2.0), ("v", "nl", 3.0)]
    scores = spark.createDataFrame(rows, "utt_id string, model_lang string, score double").withColumn("rule", F.lit("r"))
    best = {r["utt_id"]: r["lang"] for r in R.argmax_route(scores, ["fr", "en", "nl"]).collect()}
    assert best == {"u": "fr", "v": "nl"}
    both = {r["utt_id"]: (r["open_lang"], r["closed_lang"]) for r in R.open_vs_closed_route(scores, ["en", "fr", "nl"], ["en", "fr"]).collect()}
    assert both == {"u": ("en", "en"), "v": ("nl", "fr")}
    z = R.zscore_rules(scores.where("model_lang = 'nl'")).first()
    assert z["score"] == 0.0  # one value: no variance, divided by 1


def test_vote_abstains(spark):
    routes = spark.createDataFrame([("a", "r1", "lug"), ("a", "r2", "sna"), ("b", "r1", "lin"), ("b", "r2", "sna"), ("c", "r1", "sna"), ("c", "r2", "lin")], "utt_id string, rule string, lang string")
    ranks = spark.createDataFrame([("r1", 1), ("r2", 2)], "rule string, rank int")
    third = spark.createDataFrame([("a", "sna"), ("b", "sna"), ("c", "sna")], "utt_id string, lang string")
    got = {r["utt_id"]: (r["lang"], r["abstained"]) for r in R.vote_route(routes, ranks, third, ["lin", "sna"]).collect()}
    assert got == {"a": ("lug", True), "b": ("sna", False), "c": ("sna", False)}


def test_agreement_survives_relabelling(spark):
    maps = [("x", i, "en" if i % 3 else "fr") for i in range(30)] + [("y", i, "en" if i % 5 else "fr") for i in range(25)]
    rows = spark.createDataFrame(maps, "router string, utt_id int, lang string")
    summary = lambda d: R.agreement_summary(R.router_agreement(d)).select("common", "agree").first()
    swapped = rows.withColumn("lang", F.when(F.col("lang") == "en", "fr").otherwise("en"))
    assert summary(rows) == summary(swapped) and summary(rows)["common"] == 25
    mix = R.language_mix(rows, ["router"])
    ref = spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, share double")
    drift = {r["router"]: r["drift"] for r in R.mix_drift(mix, ref, ["router"]).collect()}
    assert abs(drift["x"] - 0.5 * (20 / 30 - 0.5 + 10 / 30 + 0.5)) < 1e-9


def test_guards(spark):
    ids = spark.range(10).select(F.col("id").alias("utt_id"))
    routes = spark.range(4).select(F.col("id").alias("utt_id"), F.lit("en").alias("lang"))
    assert not J.map_coverage_guard(ids, routes).first()["ok"]
    with pytest.raises(ValueError, match="stale"):
        J.require_coverage(ids, routes)
    with pytest.raises(ValueError):
        J.derangement_route(routes, {"en": "en"})
    _, overlap = C.leak_guard(ids.where("utt_id < 5"), ids.where("utt_id > 3"), "utt_id")
    assert overlap.first()["overlap"] == 1
    checked = V.expectations(spark.createDataFrame([("words", 5.0)], "fact string, v double"), [("enough", "words", ">=", 10, "FAIL")])
    with pytest.raises(ValueError, match="enough"):
        V.require(checked)


def test_restored_text_keeps_its_words(spark):
    prob = spark.createDataFrame([("a", 1, 0.9, 0.1), ("b", 1, 0.1, 0.8)], "word string, n bigint, p1 double, p2 double")
    rows = spark.createDataFrame([("k", ["A", "b", "c.", "b", "b"])], "k string, ws array<string>")
    got = {r["thr"]: r["restored"] for r in U.apply_marks(rows, "k", "ws", prob, [0.5, 0.85]).collect()}
    assert got == {0.5: "A. b, c. b, b,", 0.85: "A. b c. b b"}
    assert U.add_marks_additive(rows, "k", "ws", prob, [0.5]).first()["restored"] == "A b, c. b, b"


def test_variants_of_a_row_are_aligned_in_one_pass(spark):
    long = " ".join(f"w{k % 37}" for k in range(600))
    refs = ["a b c.", "x", long, "wide  gap here", "ünï cödé"]
    rows = spark.createDataFrame(list(enumerate(refs)), "i int, ref string")
    ref = F.col("ref")
    variants = {
        "same": ref, "dot": F.concat(ref, F.lit(".")), "again": F.concat(ref, F.lit(".")), "none": F.lit(None).cast("string"),
        "empty": F.lit(""), "cut": F.substring(ref, 3, 2000), "back": F.reverse(ref),
    }
    counts = S.edit_counts_of(rows, variants)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = {(r["variant"], r["i"]): tuple(r[c] for c in S.EDITS) for r in counts.collect()}
    want = {}
    for name, hyp in variants.items():
        want |= {(name, r["i"]): tuple(r[c] for c in S.EDITS) for r in S.edit_counts(rows.withColumn("hyp", hyp)).collect()}
    assert got == want and len(got) == 7 * len(refs)


def test_poisson_weights_are_read_from_digits(spark):
    rows = spark.range(300).selectExpr("concat('u', id) AS k", "id % 3 AS word_edits", "3L AS ref_words", "id % 7 AS char_edits", "9L AS ref_chars")
    got = S.bootstrap_ci(rows, "k", 40, 7, mode="poisson")
    assert "conv(" not in got._jdf.queryExecution().optimizedPlan().toString()
    scores = []
    for rep in range(1, 41):
        we = rw = ce = rc = 0
        for i in range(300):
            u = int(hashlib.md5(f"7|u{i}|{rep}".encode()).hexdigest()[:8], 16) / 2**32
            w = sum(u >= step for step in S.POISSON_STEPS)
            we, rw, ce, rc = we + w * (i % 3), rw + w * 3, ce + w * (i % 7), rc + w * 9
        scores.append(1 - 0.5 * we / rw - 0.5 * ce / rc)
    scores.sort()
    at = lambda q: scores[int(q * 39)] + (q * 39 - int(q * 39)) * (scores[int(q * 39) + 1] - scores[int(q * 39)])
    row = got.first()
    assert row["n_boot"] == 40 and row["lo"] == pytest.approx(at(0.025)) and row["hi"] == pytest.approx(at(0.975))


def test_several_files_meet_once(spark):
    a = spark.sql("SELECT * FROM VALUES ('k', 'A b'), ('k', 'x'), ('l', 'y'), (NULL, 'z') AS t(k, t)")
    b = spark.sql("SELECT * FROM VALUES ('k', 'a b', 'x'), ('l', 'y', NULL), (NULL, 'z', 'z') AS t(k, one, two)")
    both = P.align_several(a, b, "k", "t", {"one": "one", "two": "two"})
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    want = {n: tuple(P.align_files(a, b.withColumn("t", F.col(n)), "k", "t").first()) for n in ("one", "two")}
    assert {r["against"]: tuple(r)[:4] for r in both.collect()} == want == {"one": (3, 1, 1, 1), "two": (3, 1, 0, 1)}


def test_marks_are_put_where_rows_are_and_joined_ones_agree(spark, monkeypatch):
    texts = ["a b, c b", "Ünder a", "", None, "c", "x y z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.split("t", " ").alias("ws"))
    prob = spark.createDataFrame([("a", 9, 0.6, 0.1), ("b", 9, 0.1, 0.9), ("c", 9, 0.7, 0.75), ("ünder", 9, 0.2, 0.8)], "word string, n long, p1 double, p2 double")
    for additive in (False, True):
        held = U.restored_texts(rows, "k", "ws", prob, [0.5, 0.7, 0.85], additive)
        plan = held._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        with monkeypatch.context() as m:
            m.setattr(U, "SHIPPED_BYTES", -1)
            joined = U.restored_texts(rows, "k", "ws", prob, [0.5, 0.7, 0.85], additive)
        want = {r["k"]: r["restored"] for r in joined.collect()}
        assert {r["k"]: r["restored"] for r in held.collect()} == want and len(want) == len(texts)


def test_prf(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(1, 2), (0, 1), (2, 0)], "label int, pred int")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in U.token_prf(rows).collect()}
    assert got == {1: (3, 1, 1), 2: (0, 1, 1)}


def test_frames(spark):
    rows = spark.createDataFrame([("c", [2.0, 1.0, 0.0]), ("c", [0.0, 3.0, 0.0])], "clip string, logits array<float>")
    got = L.posterior_confidence(rows, ["clip"], blank_id=0).first()
    lse = [math.log(sum(math.exp(x) for x in v)) for v in ([2, 1, 0], [0, 3, 0])]
    assert abs(got["mean_lp"] - ((2 - lse[0]) + (3 - lse[1])) / 2) < 1e-9
    assert abs(got["mean_lp_nb"] - (3 - lse[1])) < 1e-9 and got["blank_frac"] == 0.5
    assert L.posterior_confidence(rows.limit(1), ["clip"], blank_id=0).first()["mean_lp_nb"] == -20.0
    assert [r["arg"] for r in L.mask_and_argmax(rows, [0, 1]).collect()] == [2, 2]


def test_profile_and_reconcile(spark):
    rows = spark.createDataFrame([("en", "Ab c."), ("fr", "é é é")], "lang string, t string")
    got = {r["scope"]: r for r in P.text_profile(rows, "t").collect()}
    assert got["overall"]["n_words"] == 5 and got["overall"]["vocab_words"] == 3 and got["en"]["has_uppercase"]
    assert got["overall"]["p50_words"] == 2.5 and abs(got["en"]["uppercase_ratio"] - 1 / 3) < 1e-12
    a, b = spark.range(5).select("id"), spark.range(3, 9).select("id")
    assert P.id_reconcile(a, b).first()[:5] == (5, 6, 2, 3, 4)
    paths = spark.createDataFrame([("x/a.wav",), ("y/a.wav",), ("m.csv",)], "path string")
    parts = P.file_manifest_profile(paths)
    assert parts["collisions"].collect()[0]["stem"] == "a" and parts["metadata"].count() == 1


def test_grid_must_beat_greedy(spark):
    grid = spark.createDataFrame([("en", 0.3, 0.5, 0.7), ("en", 1.5, 0.5, 0.8), ("fr", 0.3, 0.5, 0.6)], "lang string, alpha double, beta double, multi double")
    greedy = spark.createDataFrame([("en", 0.75), ("fr", 0.6)], "lang string, base double")
    got = {r["lang"]: (r["alpha"], r["decision"], r["at_edge"]) for r in E.grid_winner(grid, greedy, 1.5).collect()}
    assert got == {"en": (1.5, "tuned", True), "fr": (None, "greedy", False)}


def test_manifest_roundtrip(spark):
    from tessitura.sources.readers import explode_manifest, explode_map

    doc = {"seed": 1, "n": 2, "source": "s", "target_mix": {"en": 0.5}, "actual_mix": {}, "items": [{"id": "a", "language": "en", "reference": "x"}, {"id": "b", "language": "fr", "reference": "y"}]}
    rows = spark.createDataFrame([(json.dumps(doc),)], "value string")
    assert [r["id"] for r in explode_manifest(rows).orderBy("id").collect()] == ["a", "b"]
    maps = spark.createDataFrame([('{"u": "en", "v": "fr"}',)], "value string")
    assert sorted(map(tuple, explode_map(maps, "value", "utt_id", "lang").collect())) == [("u", "en"), ("v", "fr")]


@pytest.mark.parametrize("rows", [1, 10, 10_000])
def test_cuts_with_ids_far_from_all_others(spark, rows):
    """However ids lie, few documents are ordered at once, and the cut is the first document that reaches the cap."""
    rng = random.Random(rows)
    docs = [(lang, i, rng.randrange(1, 9), cap) for lang, cap in (("a", 900), ("b", 10), ("c", 10**6)) for i in [-(2**50), *range(500), 2**40, 2**60]]
    got = {r["lang"]: r["cut_doc"] for r in C.cut_points(spark.createDataFrame(docs, "lang string, doc_id long, words long, cap long"), ["lang"], rows=rows).collect()}
    want, totals = {}, {}
    for lang, i, words, cap in docs:
        totals[lang] = totals.get(lang, 0) + words
        if totals[lang] >= cap:
            want.setdefault(lang, i)
    assert got == want and set(got) == {"a", "b"}


def test_passages_behind_an_opening_that_most_documents_share(spark):
    rng = random.Random(4)
    opening = "as a service to all our readers we print this note in full"
    tail = lambda i: "tail" + "".join(chr(97 + int(d)) for d in str(i))
    bodies = [f"{opening if i % 10 else ''} {' '.join(rng.choice('abcdefgh') * 3 for _ in range(30))} {tail(i)}" for i in range(200)]
    passages = [(k, " ".join(bodies[17 * k].split()[: 16 + k])) for k in range(1, 9)] + [(20, opening), (21, opening + " elsewhere"), (22, tail(7)), (22, tail(8))]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    got = sorted(map(tuple, C.contains_holdout(docs, spark.createDataFrame(passages, "item_id long, text string")).collect()))
    assert got == sorted((i, k) for i, b in enumerate(bodies) for k, p in passages if f" {p} " in f" {' '.join(b.split())} ")


def test_noise_words_are_the_same_sent_or_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i}", " ".join(f"w{(i * j) % 50}" for j in range(i % 12 + 1))) for i in range(200)], "k string, t string")
    vocab = A.noise_vocabulary(rows, "t")
    made = []
    for limit in (1 << 20, -1):
        monkeypatch.setattr(A, "SHIPPED_BYTES", limit)
        out = A.corrupt_words(rows, F.split("t", " "), "k", vocab, 0.6)
        made.append(({r["k"]: r["noisy"] for r in out.collect()}, "ArrowEvalPython" in out._jdf.queryExecution().toString()))
    assert made[0][0] == made[1][0] and (made[0][1], made[1][1]) == (True, False)


def test_a_file_that_matches_no_template_fails(spark):
    rows = spark.createDataFrame([("x1", "a b", 1), ("x2", "c d", 2)], "ID string, Target string, row_no int")
    template = spark.createDataFrame([("y1", 1), ("y2", 2)], "ID string, row_no int")
    refs = spark.createDataFrame([("a b c d",)], "ref string")
    broken = {r["rule"]: r["severity"] for r in V.validate_submission(rows, template, refs).collect()}
    assert broken["no_template"] == "FAIL"
    assert "no_template" not in {r["rule"] for r in V.validate_submission(rows, template.union(rows.select("ID", "row_no").limit(1)), refs).collect()}


def test_variants_are_made_once_though_python_makes_one_of_them(spark):
    rows = spark.createDataFrame([("c, d. " * 300 + "e", "c d " * 300 + "e"), ("a.", "a")], "ref string, hyp string")
    oracle = F.concat(U.oracle_marks(F.col("ref"), F.col("hyp")), F.lit("MARKER"))
    counts = S.edit_counts_of(rows, {"hyp": F.col("hyp"), "oracle": oracle})
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("MARKER") == 1
    got = {(r["variant"], r["ref_words"]): r["char_edits"] for r in counts.collect()}
    assert got == {("hyp", 1): 1, ("oracle", 1): 6, ("hyp", 601): 600, ("oracle", 601): 6}


def test_noise_of_labelled_pairs_is_the_same_sent_or_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i}", " ".join(f"w{(i * j) % 50}" for j in range(i % 40 + 1))) for i in range(200)], "k string, t string")
    vocab = A.noise_vocabulary(rows, "t")
    pairs = F.transform(F.split("t", " "), lambda w: F.struct(w.alias("word"), F.lit(2).alias("label")))
    made = []
    for limit in (1 << 20, -1):
        monkeypatch.setattr(A, "SHIPPED_BYTES", limit)
        made.append({r["k"]: r["noisy"] for r in A.corrupt_labelled(rows, pairs, "k", vocab).collect()})
    assert made[0] == made[1] and {p["label"] for ps in made[0].values() for p in ps} == {0, 2}


def test_sentences_are_normalised_once(spark):
    rows = C.to_sentences(spark.createDataFrame([(1, "One. Two!\n\nThree")], "doc_id int, text string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [(r["sent_no"], r["sentence"]) for r in rows.orderBy("sent_no").collect()] == [(0, "one."), (1, "two!"), (2, "three")]


def test_shares_compare_as_digits(spark):
    cases = [(d * 24, s) for d in ("00000000", "00000001", "3fffffff", "40000000", "40000001", "ffffffff") for s in (0.0, 2.0**-32, 0.25, 0.2500000001, 0.9999)]
    cases = [(d[:8] + "0" * 24, s) for d, s in cases]
    got = spark.createDataFrame(cases, "d string, s double").select((F.col("d") < A._threshold(F.col("s"))).alias("x"), (int_unit() < F.col("s")).alias("y")).collect()
    assert [r["x"] for r in got] == [r["y"] for r in got]


def int_unit():
    from tessitura.functions.draws import unit

    return unit(F.col("d"))


def test_counts_are_read_once_for_both_kinds_of_adjusted_count(spark):
    rows = spark.createDataFrame([("en", 2, "<s> a", 3), ("en", 2, "b a", 1), ("en", 2, "a </s>", 4), ("en", 1, "a", 4), ("en", 1, "<s>", 3)], "lang string, n int, gram string, c bigint")
    adjusted = N.kn_continuations(rows, 2)
    assert "Union" not in adjusted._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["n"], r["gram"], r["a"]) for r in adjusted.collect()} == {(2, "<s> a", 3), (2, "b a", 1), (2, "a </s>", 4), (1, "a", 2), (1, "</s>", 1)}


def test_noise_of_a_batch_is_drawn_together(spark):
    rows = spark.createDataFrame([(f"k{i}", "a b c" if i % 3 else "a", float(i % 4) / 4) for i in range(60)], "k string, t string, r double")
    vocab = A.noise_vocabulary(rows.select(F.lit("x y z").alias("t")), "t")
    out = A.corrupt_words(rows, F.split("t", " "), "k", vocab, F.col("r"))
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
    vocabulary = [r["word"] for r in vocab.orderBy("idx").collect()]
    for row in out.collect():
        want, said = [], row["t"].split(" ")
        parts = lambda at: [int(hashlib.md5(f"1337|{row['k']}|{at}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in (0, 1)]  # noqa: B023, E731
        for i, w in enumerate(said):
            u, word = parts(i)[0] / 2**32, vocabulary[parts(i)[1] % 3]
            want += [word] if u < row["r"] * 0.7 else [] if u < row["r"] * 0.9 else [w, word] if u < row["r"] else [w]
        assert row["noisy"] == (want or [vocabulary[parts("empty")[1] % 3]])


def test_words_of_the_vocabulary_leave_a_task_once(spark, monkeypatch):
    texts = [None, "", "a. b", "b, a.", "- a", "«c» a. b"] * 40
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    vocab = A.noise_vocabulary(rows, "t", T.strip_punct)
    assert sorted((r["idx"], r["word"]) for r in vocab.collect()) == [(i, w) for i, w in enumerate(sorted("abc", key=lambda w: hashlib.md5(w.encode()).hexdigest()))]
    batch = lambda *ts: pa.RecordBatch.from_arrays([pa.array(ts, pa.string())], ["t"])
    told = lambda: [sorted(b.column(0).to_pylist()) for b in A._distinct_words(iter([batch("x y x", None), batch("y x"), batch("z x")]))]
    assert told() == [["x", "y", "z"]]
    monkeypatch.setattr(A, "TOLD", 2)
    assert told() == [["x", "y"], ["x", "y"], ["x", "z"], []]
