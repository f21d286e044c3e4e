"""Building a sentence corpus from prioritised document sources.

Columns throughout: `lang, source, doc_id, sent_no, sentence`. A row's weight
stands for physical repetition, so nothing is multiplied before the final write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.text import SENTENCE_BREAK, compose, normalise, normalise_composed
from tessitura.functions.words import n_words
from tessitura.session import dimension, reliable_checkpoint

BLOCKS = 4096
#: Documents of a group that one task may order.
CUT_ROWS = 200_000


def corpus_sources(documents: DataFrame, sources: DataFrame, include_audio_heavy: bool = False) -> DataFrame:
    """Documents with text, joined to their source's priority, cap, weight and licence.

    `sources` is configuration, one row per source, broadcast once it is counted: a
    shuffle by source would gather the largest source in one task.
    """
    chosen = sources if include_audio_heavy else sources.where(~F.col("audio_heavy"))
    return documents.where(F.length("text") > 0).join(dimension(chosen), "source")


def to_sentences(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-empty normalised sentence; `sent_no` counts the raw pieces from 0.

    Splitting comes before normalising, which destroys the marks it splits on;
    composing comes first, as it never touches a break. No shuffle.
    """
    kept = [c for c in documents.columns if c != text]
    composed = documents.select(*kept, compose(F.col(text)).alias("_text"))
    # Made inside the generator: as a column of its own, the test below would make each sentence a second time.
    pieces = F.transform(F.split("_text", SENTENCE_BREAK, -1), normalise_composed)
    return composed.select(*kept, F.posexplode(pieces).alias("sent_no", "sentence")).where(F.col("sentence") != "")


def charset_counts(texts: DataFrame, text: str = "sentence") -> DataFrame:
    """Occurrences of every character except the space; at most one row per code point."""
    return (
        texts.select(F.explode(F.split(F.replace(F.col(text), F.lit(" "), F.lit("")), "")).alias("char"))
        .where(F.col("char") != "")
        .groupBy("char")
        .agg(F.count("*").alias("n"))
    )


def charset(texts: DataFrame, text: str = "sentence", min_count: int = 25) -> DataFrame:
    """One row, `allowed`: the space and every character seen at least `min_count` times."""
    return (
        charset_counts(texts, text)
        .where(F.col("n") >= min_count)
        .agg(F.concat(F.lit(" "), F.array_join(F.sort_array(F.collect_list("char")), "")).alias("allowed"))
    )


def char_vocab(texts: DataFrame, text: str = "sentence", min_count: int = 25) -> DataFrame:
    """`(char, id, n)`: frequent characters in order, then the delimiter and two specials.

    The single ordering task sees at most one row per Unicode code point.
    """
    kept = charset_counts(texts, text).where(F.col("n") >= min_count).select("char", "n", F.lit(0).alias("tail"))
    spark = texts.sparkSession
    specials = spark.createDataFrame(
        [("|", 0, 1), ("[UNK]", 0, 2), ("[PAD]", 0, 3)], "char string, n bigint, tail int"
    )
    order = Window.orderBy("tail", "char")
    return kept.unionByName(specials).select(
        "char", (F.row_number().over(order) - 1).cast("bigint").alias("id"), "n"
    )


def split_filter(rows: DataFrame, split: str, text: str = "transcription") -> DataFrame:
    """Rows of one original split whose text is longer than one character."""
    return rows.where((F.col("original_split") == split) & (F.length(F.trim(text)) > 1))


def trainable_pairs(
    rows: DataFrame,
    min_seconds: float = 1.0,
    max_seconds: float = 20.0,
    rate: int = 16000,
    samples_per_frame: int = 320,
) -> DataFrame:
    """Pairs of acceptable duration whose labels fit into the frames with a 1.5x margin."""
    samples, labels = F.col("n_samples"), F.col("n_labels")
    return rows.where(
        samples.between(min_seconds * rate, max_seconds * rate)
        & (labels > 0)
        & (labels * 1.5 < samples / samples_per_frame)
    )


def leak_guard(train: DataFrame, evaluation: DataFrame, key: str, labels: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The evaluation side without its label columns, and the overlap report that must be zero."""
    shared = train.select(key).distinct().join(evaluation.select(key).distinct(), key, "left_semi")
    return evaluation.drop(*labels), shared.agg(F.count("*").alias("overlap"))


def holdout_by_id(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not held out."""
    return rows.join(held.select(key), key, "left_anti")


def holdout_by_content(sentences: DataFrame, references: DataFrame, text: str = "text") -> DataFrame:
    """Sentences whose normalised text equals no normalised reference; needs no ids."""
    held = references.select(normalise(F.col(text)).alias("sentence")).distinct()
    return sentences.join(held, "sentence", "left_anti")


def contains_holdout(documents: DataFrame, passages: DataFrame, anchor_words: int = 5) -> DataFrame:
    """`(doc_id, item_id)`: the normalised document holds the passage as a run of whole words.

    A passage is looked for by its rarest run of `anchor_words` words (a shorter passage by the whole of it): one pass counts
    the documents of every run of a passage, another finds those of the rarest ones, by equality. However many
    documents share an opening or a phrase, only those with a passage's own words are compared in full.
    """
    from tessitura.functions.words import ngrams, words

    docs = reliable_checkpoint(documents.select("doc_id", normalise(F.col("text")).alias("body")))
    wanted = passages.select("item_id", normalise(F.col("text")).alias("passage")).where(F.col("passage") != "")
    ws = words(F.col("passage"))
    runs = F.when(F.size(ws) < anchor_words, F.array("passage")).otherwise(F.array_distinct(ngrams(ws, anchor_words, sentinels=False)))
    anchors = wanted.select("item_id", "passage", F.explode(runs).alias("anchor"))
    shorter = wanted.where(F.size(ws) < anchor_words).agg(F.collect_set(F.size(ws)).alias("s")).scalar()
    body = words(F.col("body"))
    shingles = ngrams(body, anchor_words, sentinels=False)
    for n in range(1, anchor_words):
        shingles = F.concat(
            shingles,
            F.when(F.array_contains(shorter, n), ngrams(body, n, sentinels=False)).otherwise(
                F.array().cast("array<string>")
            ),
        )
    found = docs.select("doc_id", F.explode(F.array_distinct(shingles)).alias("anchor"))
    often = found.join(anchors.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("n"))
    counted = anchors.join(often, "anchor", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # A passage with a run that no document has is in no document.
    rarest = counted.groupBy("item_id", "passage").agg(F.min(F.struct("n", "anchor")).alias("r")).where("r.n > 0")
    candidates = found.join(rarest.select("item_id", "passage", "r.anchor"), "anchor").select("doc_id", "item_id", "passage")
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (
        candidates.join(docs, "doc_id")
        .where(F.contains(padded(F.col("body")), padded(F.col("passage"))))
        .select("doc_id", "item_id")
    )


def cut_points(doc_words: DataFrame, keys: list[str], cap: str = "cap", rows: int = CUT_ROWS) -> DataFrame:
    """Per group the document at which its running word total first reaches the cap.

    Input: `keys, doc_id, words, cap`, one row per document; a few groups, such as languages and sources. Groups that
    never reach the cap are absent. Instead of one long running sum, totals of at most 4,096 doc_id ranges locate
    the range with the crossing. That range, from its first document to its last, is cut again until it holds at
    most `rows` documents, which alone are ordered one by one; ids far from all others cost one more round.
    """
    docs = reliable_checkpoint(doc_words.select(*keys, "doc_id", "words", F.col(cap).cast("double").alias("_cap")))
    ends = [F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.count("*").alias("_docs")]
    reach = docs.groupBy(*keys).agg(*ends, F.sum("words").alias("_all"), F.max("_cap").alias("_cap"))
    # A group that cannot reach its cap never enters the ordering.
    found = dimension(reach.where(F.col("_all") >= F.col("_cap")).select(*keys, "_lo", "_hi", "_docs", "_cap", F.lit(0).cast("long").alias("_before")))
    within = lambda: docs.drop("_cap").join(found, keys).where(F.col("doc_id").between(F.col("_lo"), F.col("_hi")))
    while (found.agg(F.max("_docs")).first()[0] or 0) > rows:
        width = F.floor((F.col("_hi") - F.col("_lo")) / BLOCKS) + 1
        placed = within().withColumn("_block", F.floor((F.col("doc_id") - F.col("_lo")) / width))
        blocks = placed.groupBy(*keys, "_block").agg(*ends, F.sum("words").alias("_w"), F.max("_cap").alias("_cap"), F.max("_before").alias("_from"))
        upto = F.col("_from") + F.sum("_w").over(Window.partitionBy(*keys).orderBy("_block"))
        crossing = blocks.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_cap")) & (F.col("_upto") - F.col("_w") < F.col("_cap")))
        found = dimension(crossing.select(*keys, "_lo", "_hi", "_docs", "_cap", (F.col("_upto") - F.col("_w")).alias("_before")))
    running = F.col("_before") + F.sum("words").over(Window.partitionBy(*keys).orderBy("doc_id"))
    return (
        within().withColumn("_running", running)
        .where(F.col("_running") >= F.col("_cap"))
        .groupBy(*keys)
        .agg(F.min("doc_id").alias("cut_doc"))
    )


def cap_words(sentences: DataFrame, caps: DataFrame) -> DataFrame:
    """Stop a source at the first document that brings its words to the cap; that document stays whole.

    `caps` holds `source, cap` for capped sources; others pass through.
    """
    per_doc = (
        sentences.groupBy("lang", "source", "doc_id")
        .agg(F.sum(n_words(F.col("sentence"))).alias("words"))
        .join(dimension(caps), "source")
    )
    # One row per language and source; stored, so that counting it does not compute it twice.
    cuts = reliable_checkpoint(cut_points(per_doc, ["lang", "source"]))
    return (
        sentences.join(dimension(cuts), ["lang", "source"], "left")
        .where(F.col("cut_doc").isNull() | (F.col("doc_id") <= F.col("cut_doc")))
        .drop("cut_doc")
    )


def dedupe_prioritised(sentences: DataFrame, sources: DataFrame) -> DataFrame:
    """Exact sentence dedupe across prioritised, capped sources.

    The first source by priority wins; within one the first occurrence in
    document order. In-domain rows (priority 0) stay as they are and count as
    seen. A capped source stops after the document that reaches its cap, and what
    lies behind the stop counts as unseen for later sources.

    `sentences` holds external rows already filtered for charset, and in-domain
    rows unfiltered; `sources` holds `source, priority, cap`, one row per source
    with distinct priorities. Output adds `priority`.

    Copies collapse map-side to one row per (sentence, source) before the wide
    shuffle, after which a sentence carries at most one entry per source. That
    table is checkpointed; each source that can reach its cap then needs one light
    pass over it for its stopping document, the rest need none.
    """
    ranked = sentences.join(dimension(sources.select("source", "priority")), "source")
    indomain = ranked.where(F.col("priority") == 0)
    first = ranked.groupBy("lang", "sentence", "priority").agg(
        F.min(F.struct("doc_id", "sent_no")).alias("at")
    )
    by_sentence = reliable_checkpoint(
        first.groupBy("lang", "sentence").agg(
            F.collect_list(F.struct("priority", F.col("at.doc_id").alias("doc_id"), F.col("at.sent_no").alias("sent_no"))).alias("entries")
        )
    )
    gross = (
        by_sentence.select("lang", F.explode("entries").alias("e"), n_words(F.col("sentence")).alias("w"))
        .groupBy("lang", F.col("e.priority").alias("priority"))
        .agg(F.sum("w").alias("w"))
        .join(sources.where(F.col("cap").isNotNull() & (F.col("priority") > 0)), "priority")
        .where(F.col("w") >= F.col("cap"))
        .select("priority", "cap")
        .distinct()
        .orderBy("priority")
    )
    stops: dict[str, dict[int, int]] = {}  # language -> priority -> the document that a source stops after
    for priority, cap in gross.toLocalIterator():  # one row per configured source at most
        winners = _winners(by_sentence, stops).where(F.col("e.priority") == priority)
        per_doc = (
            winners.groupBy("lang", F.col("e.doc_id").alias("doc_id"))
            .agg(F.sum(n_words(F.col("sentence"))).alias("words"))
            .withColumn("cap", F.lit(cap))
        )
        for lang, stop in cut_points(per_doc, ["lang"]).collect():
            stops.setdefault(lang, {})[priority] = stop
    names = dimension(sources.select("source", "priority"))
    external = (
        _winners(by_sentence, stops)
        .where(F.col("e.priority") > 0)
        .select("lang", F.col("e.priority").alias("priority"), F.col("e.doc_id").alias("doc_id"), F.col("e.sent_no").alias("sent_no"), "sentence")
        .join(names, "priority")
    )
    columns = ["lang", "source", "priority", "doc_id", "sent_no", "sentence"]
    return indomain.select(*columns).unionByName(external.select(*columns))


def _winners(by_sentence: DataFrame, stops: dict[str, dict[int, int]]) -> DataFrame:
    """Each sentence's first entry that lies before its source's stop."""
    if stops:
        table = by_sentence.sparkSession.createDataFrame(list(stops.items()), "lang string, _stops map<int, bigint>")
        behind = lambda e: e["doc_id"] > F.try_element_at("_stops", e["priority"])
        live = F.filter("entries", lambda e: ~F.coalesce(behind(e), F.lit(False)))
        by_sentence = by_sentence.join(table, "lang", "left").withColumn("entries", F.when(F.col("_stops").isNull(), F.col("entries")).otherwise(live))
    return by_sentence.select("lang", "sentence", F.array_min("entries").alias("e")).where(F.col("e").isNotNull())


def corpus_manifest(corpus: DataFrame, sources: DataFrame, langs: list[str], errors: DataFrame | None = None) -> DataFrame:
    """Disclosure rows, one per language and configured source: sentences, words, repeats and licence.

    Sources that kept nothing count 0. `capped` marks those that reached their cap, `skipped` those that
    the configuration leaves out (`audio_heavy`). `errors` (`source, error`), if given, adds why a source
    could not be read.
    """
    per = corpus.groupBy("lang", "source").agg(
        F.count("*").alias("sentences"), F.sum(n_words(F.col("sentence"))).alias("words")
    )
    every = sources.withColumn("lang", F.explode(F.array(*[F.lit(lg) for lg in langs])))
    joined = every.join(per, ["lang", "source"], "left").fillna(0, ["sentences", "words"])
    if errors is not None:
        joined = joined.join(dimension(errors), "source", "left")
    return joined.select(
        "lang", "source", "sentences", "words", F.col("weight").alias("repeated"), "licence",
        F.coalesce(F.col("words") >= F.col("cap"), F.lit(False)).alias("capped"), F.col("audio_heavy").alias("skipped"),
        *(["error"] if errors is not None else []),
    )


def corpus_totals(corpus: DataFrame, sources: DataFrame) -> DataFrame:
    """Per language: weighted sentences and words, and distinct words."""
    weighted = corpus.join(dimension(sources.select("source", "weight")), "source")
    totals = weighted.groupBy("lang").agg(
        F.sum("weight").alias("sentences"), F.sum(n_words(F.col("sentence")) * F.col("weight")).alias("words")
    )
    unique = (
        corpus.select("lang", F.explode(F.split("sentence", " ")).alias("word"))
        .distinct()
        .groupBy("lang")
        .agg(F.count("*").alias("unique_words"))
    )
    return totals.join(unique, "lang")


def nested_manifest(manifest: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per language with its sources as an array; an array holds one entry per source."""
    entries = manifest.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", "sentences", "words", "repeated", "licence", "capped", "skipped"))).alias("sources")
    )
    return totals.join(entries, "lang").select(
        "lang", F.concat("lang", F.lit(".txt")).alias("file"), "sentences", "words", "unique_words", "sources"
    )


def corpus_verdict(words: DataFrame, targets: DataFrame, warn_below: int = 500_000) -> DataFrame:
    """Corpus size against a published target: OK from 40 %, THIN from 10 %."""
    pct = 100 * F.col("words") / F.col("target")
    return words.join(targets, "lang").select(
        "lang",
        "words",
        "target",
        pct.alias("pct"),
        F.when(pct >= 40, "OK").when(pct >= 10, "THIN").otherwise("TOO SMALL").alias("verdict"),
        (F.col("words") < warn_below).alias("sparse"),
    )
