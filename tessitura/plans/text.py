"""Queries over scalar text functions, sources and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.functions.draws import draw, whole
from tessitura.functions.words import ngrams, punct_labels, words
from tessitura.operators import corpus, profile, punct
from tessitura.plans import sql as Q
from tessitura.plans import views as V
from tessitura.session import shared_folder
from tessitura.sources import readers, writers

RARE = 25  # fixed value: occurrences a character needs


def _docs(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


def _raw_sentences(spark, sf_dir):
    """Sentence rows without the source columns."""
    return V.sentences(spark, sf_dir).select("doc_id", "sent_no", "sentence")


def checksum(*cols):
    """Order-free digest of a group's values: the sum of their 32-bit hashes."""
    return F.sum(whole(F.md5(F.concat_ws("|", *cols))))


def checksum_sql(*cols: str) -> str:
    return f"sum({Q.whole('md5(concat_ws(' + chr(39) + '|' + chr(39) + ', ' + ', '.join(cols) + '))')})::BIGINT"


def normalise(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalise(F.col("text")).alias("normal"))


def normalise_cased(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalise_cased(F.col("text"), lowercase=False).alias("normal"))


def scorer_normalise(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.scorer_normalise(F.col("text")).alias("lowered"))


def fold_rare(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", T.normalise(F.col("text")).alias("normal"))
    # At most one character per code point reaches the driver.
    allowed = corpus.charset(docs, "normal", RARE).first()["allowed"]
    return docs.select("doc_id", T.fold_rare(F.col("normal"), allowed).alias("folded"))


def charset_ratio(spark, sf_dir):
    sents = _raw_sentences(spark, sf_dir)
    allowed = corpus.charset(sents, "sentence", RARE).scalar()
    return sents.select(
        "doc_id", "sent_no",
        F.round(T.charset_ratio(F.col("sentence"), allowed), 9).alias("ratio"),
        T.acceptable(F.col("sentence"), allowed).alias("acceptable"),
    )


def to_sentences(spark, sf_dir):
    return V.sentences(spark, sf_dir)


def lang_from_id(spark, sf_dir):
    utts = V.utterances(spark, sf_dir)
    tagged = utts.select("lang", T.lang_from_id(F.col("utt_id"), V.LANGS[:3]).alias("from_id"))
    return tagged.groupBy("lang", "from_id").agg(F.count("*").alias("n"))


def lang3(spark, sf_dir):
    folders = profile.file_parts(F.col("url"))["folder"]
    return V.table(spark, sf_dir, "pages").select("page_id", T.lang3(F.concat(F.lit(" "), F.upper(folders), F.lit("-X"))).alias("lang3"))


def id_shape_profile(spark, sf_dir):
    ids = _docs(spark, sf_dir).select(
        F.when(F.col("doc_id") % 7 == 0, F.concat_ws("_", "lang", "doc_id")).otherwise(
            F.concat(F.lit("ID_"), F.translate(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), "0123456789abcdef", "GHIJKLMNOPABCDEF"))
        ).alias("utt_id")
    )
    out = profile.id_shape_profile(ids, r"^ID_[A-Z]{6}$", "ID_")
    return out.withColumns({"share": F.round("share", 9), "excess": F.round("excess", 9)})


def strip_punct(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_punct(F.col("text")).alias("bare"))


def strip_marks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_marks(F.col("text")).alias("bare"))


def labels_query(spark, sf_dir):
    pairs = _raw_sentences(spark, sf_dir).select("doc_id", "sent_no", punct_labels(F.col("sentence")).alias("p"))
    return pairs.select(
        "doc_id", "sent_no", F.array_join("p.word", " ").alias("words"), F.array_join(F.col("p.label").cast("array<string>"), "").alias("labels")
    )


def finish(spark, sf_dir):
    sents = V.sentences(spark, sf_dir)
    return sents.select("doc_id", "sent_no", T.finish(F.col("sentence"), F.col("lang"), ["fr", "es"]).alias("finished"))


def append_period(spark, sf_dir):
    sents = _raw_sentences(spark, sf_dir).withColumn("t", F.when(F.col("sent_no") % 5 == 0, "").otherwise(F.col("sentence")))
    return sents.select("doc_id", "sent_no", *[T.append_period(F.col("t"), r).alias(r) for r in ("always", "nonblank", "guarded")])


def capfirst(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.capfirst(T.normalise(F.col("text"))).alias("capped"))


def fill_blank(spark, sf_dir):
    # Texts lose everything but their digits, so that many are blank.
    digits = _docs(spark, sf_dir).select("source", F.regexp_replace("text", r"[^0-9 ]+", "").alias("t"))
    return digits.groupBy("source").agg(
        F.count_if(T.is_blank(F.col("t"))).alias("blanks"), checksum(T.fill_blank(F.col("t"))).alias("digest")
    )


def chat_messages(spark, sf_dir):
    from tessitura.functions.chat import chat_messages as messages

    rows = messages(V.utterances(spark, sf_dir).select("utt_id", "lang", "ref"), F.concat(F.lit("transcribe "), F.col("lang")), F.lit("write the words"), F.col("ref"))
    return rows.select(
        "utt_id",
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.array_join(F.flatten(F.transform("messages", lambda m: F.transform(m["content"], lambda c: F.concat_ws(":", c["type"], c["text"])))), "/").alias("content"),
    )


def chat_conversations(spark, sf_dir):
    from tessitura.functions.chat import conversations

    rows = conversations(V.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return rows.select(
        "conv_id", F.size("messages").cast("bigint").alias("turns"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"][0]["text"], F.lit(""))), "\n")).alias("digest"))


def ngrams_query(spark, sf_dir):
    sents = _raw_sentences(spark, sf_dir)
    return sents.select("doc_id", "sent_no", F.array_join(ngrams(words(F.col("sentence")), 3), "|").alias("grams"))


def context_features(spark, sf_dir):
    utts = V.utterances(spark, sf_dir).select("utt_id", "lang", "ref")
    feats = punct.context_features(utts, "ref", "utt_id").select(F.explode("features").alias("f"))
    family = F.substring_index("f", "=", 1)
    return feats.groupBy(family.alias("family")).agg(F.count("*").alias("n"), checksum(F.col("f")).alias("digest"))


def char_vocab(spark, sf_dir):
    return corpus.char_vocab(V.sentences(spark, sf_dir), "sentence", 25)


def word_vocab(spark, sf_dir):
    # In-domain words count ten times, as their repeated lines would.
    sents = V.sentences(spark, sf_dir)
    weight = F.when(F.col("source") == "src0", 10).otherwise(1)
    return profile.word_vocab(sents, "sentence", weight, min_count=2)


def text_profile(spark, sf_dir):
    out = profile.text_profile(_docs(spark, sf_dir), "text")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_words", "uppercase_ratio", "p50_words", "p95_words")})


def char_profile(spark, sf_dir):
    return profile.char_profile(_docs(spark, sf_dir), "text")


def text_samples(spark, sf_dir):
    return profile.text_samples(_docs(spark, sf_dir), "text", "doc_id")


def split_filter(spark, sf_dir):
    utts = V.utterances(spark, sf_dir).select("utt_id", "lang", F.col("ref").alias("transcription"), V.original_split(F.col("utt_id")).alias("original_split"))
    return corpus.split_filter(utts, "validation")


def trainable_pairs(spark, sf_dir):
    utts = V.utterances(spark, sf_dir)
    pace = 900 + whole(draw("pace", F.col("utt_id"))) % 600
    rows = utts.select("utt_id", "lang", F.length("ref").cast("bigint").alias("n_labels"), (F.length("ref") * pace).alias("n_samples"))
    return corpus.trainable_pairs(rows)


def explode_routing_map(spark, sf_dir):
    from tessitura.sources.readers import explode_map

    events = V.table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    rows = explode_map(events, "props", "key", "value")
    return rows.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("bigint")).alias("total"))


def routing_map_files(spark, sf_dir):
    """The language of every utterance, written as routing maps and read back in pieces."""
    folder = shared_folder(spark, "maps")
    writers.write_routing_map(V.utterances(spark, sf_dir), folder)
    return readers.split_routing_map(spark, folder)


def file_manifest_profile(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    expected = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"))
    parts = profile.file_manifest_profile(pages, expected)
    rows = [
        parts[k].select(F.lit(k).alias("section"), F.col(c).alias("item"), F.col("n"))
        for k, c in (("extension", "extension"), ("folder", "folder"), ("collisions", "stem"), ("metadata", "extension"))
    ]
    counts = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in ("wanted", "got", "overlap", "missing", "unexpected")])
    rows.append(parts["expected"].select(F.explode(counts).alias("x")).select(F.lit("expected").alias("section"), "x.item", "x.n"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


QUERIES = {
    "normalise": normalise, "normalise_cased": normalise_cased, "scorer_normalise": scorer_normalise,
    "fold_rare": fold_rare, "charset_ratio": charset_ratio, "to_sentences": to_sentences,
    "lang_from_id": lang_from_id, "lang3": lang3, "id_shape_profile": id_shape_profile,
    "strip_punct": strip_punct, "strip_marks": strip_marks, "punct_labels": labels_query, "finish": finish,
    "append_period_variants": append_period, "capfirst": capfirst, "fill_blank": fill_blank,
    "chat_messages": chat_messages, "chat_conversations": chat_conversations, "ngrams": ngrams_query, "context_features": context_features,
    "char_vocab": char_vocab, "word_vocab": word_vocab, "text_profile": text_profile,
    "char_profile": char_profile, "text_samples": text_samples, "split_filter": split_filter,
    "trainable_pairs": trainable_pairs, "explode_routing_map": explode_routing_map, "routing_map_files": routing_map_files,
    "file_manifest_profile": file_manifest_profile,
}

_CHARS = """chars AS (SELECT c, count(*) AS n FROM (
  SELECT unnest(string_split(replace(sentence, ' ', ''), '')) AS c FROM {src}) WHERE c <> '' GROUP BY c)"""
_ALLOWED = f"allowed AS MATERIALIZED (SELECT list(c) AS cs, ' ' || string_agg(c, '' ORDER BY c) AS s FROM chars WHERE n >= {RARE})"
_WORD_RE = r"'[^\s\x0b\x1c-\x1f\x85\p{Z}]+'"


def _feature_sql() -> str:
    f = {
        "lang": "lang", "w": "ws[i]", "prev": "CASE WHEN i = 1 THEN '<s>' ELSE ws[i-1] END", "next": "coalesce(ws[i+1], '</s>')",
        "next2": "coalesce(ws[i+2], '</s>')", "w|next": "ws[i] || '|' || coalesce(ws[i+1], '</s>')",
        "prev|w": "(CASE WHEN i = 1 THEN '<s>' ELSE ws[i-1] END) || '|' || ws[i]",
        "suf3": "right(ws[i], 3)", "nsuf3": "right(coalesce(ws[i+1], '</s>'), 3)", "last": "CASE WHEN i = n THEN 'true' ELSE 'false' END",
        "from_end": "least(n - i, 5)::VARCHAR", "pos": "least(i - 1, 5)::VARCHAR", "len": "least(n // 5, 8)::VARCHAR",
    }
    return "[" + ", ".join(f"'{k}=' || {v}" for k, v in f.items()) + "]"


_LABELLED = f"""lab AS MATERIALIZED (
  SELECT utt_id, lang, list_filter(list_transform(string_split(ref, ' '), lambda t: {{'word': translate(t, {Q.PUNCT}, ''),
    'label': CASE WHEN suffix(t, '.') THEN 1 WHEN suffix(t, ',') THEN 2 ELSE 0 END}}), lambda s: s.word <> '') AS p FROM utt)"""

SQL = {
    "normalise": f"SELECT doc_id, {Q.norm('text')} AS normal FROM documents",
    "normalise_cased": r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[^\p{L}.,''’;:!?-]+', ' ', 'g')) AS normal FROM documents",
    "scorer_normalise": "SELECT conv_id, turn, lower(text) AS lowered FROM conversations",
    "fold_rare": Q.query(
        f"d AS MATERIALIZED (SELECT doc_id, {Q.norm('text')} AS sentence FROM documents)",
        _CHARS.format(src="d"), _ALLOWED,
        """SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(sentence, ''), lambda c:
             CASE WHEN list_contains(cs, c) THEN c WHEN list_contains(cs, strip_accents(c)) THEN strip_accents(c) ELSE ' ' END), ''), '\\s+', ' ', 'g')) AS folded
           FROM d, allowed""".replace("\\\\", "\\"),
    ),
    "charset_ratio": Q.query(
        Q.SENT, _CHARS.format(src="sent"), _ALLOWED,
        """SELECT doc_id, sent_no, round(r, 9) AS ratio, length(sentence) >= 8 AND contains(sentence, ' ') AND r <= 0.02::DOUBLE AS acceptable
           FROM (SELECT *, length(translate(sentence, s, '')) / length(sentence) AS r FROM sent, allowed)""",
    ),
    "to_sentences": Q.query(Q.SENT, "SELECT * FROM sent"),
    "lang_from_id": Q.query(
        Q.UTT,
        """SELECT lang, CASE WHEN p IN ('en', 'fr', 'de') THEN p END AS from_id, count(*) AS n
           FROM (SELECT lang, lower(trim(split_part(utt_id, '_', 1))) AS p FROM utt) GROUP BY ALL""",
    ),
    "lang3": r"""SELECT page_id, substr(lower(trim(' ' || upper(f) || '-X')), 1, 3) AS lang3 FROM (
        SELECT page_id, CASE WHEN contains(c, '/') THEN regexp_extract(c, '^([^/]*)/', 1) ELSE '(root)' END AS f FROM (
          SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS c FROM pages))""",
    "id_shape_profile": Q.query(
        """ids AS (SELECT CASE WHEN doc_id % 7 = 0 THEN lang || '_' || doc_id
             ELSE 'ID_' || translate(substr(md5(doc_id::VARCHAR), 1, 6), '0123456789abcdef', 'GHIJKLMNOPABCDEF') END AS utt_id FROM documents)""",
        "ok AS (SELECT * FROM ids WHERE regexp_matches(utt_id, '^ID_[A-Z]{6}$'))",
        "letters AS (SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(replace(utt_id, 'ID_', ''), '')) AS letter FROM ok) GROUP BY letter)",
        """SELECT letter, n, round(n / sum(n) OVER (), 9) AS share, round(n / sum(n) OVER () - 1 / 26, 9) AS excess,
             (SELECT count(*) FROM ids) AS ids, (SELECT count(*) FROM ok) AS matching FROM letters""",
    ),
    "strip_punct": f"SELECT doc_id, {Q.strip_punct('text')} AS bare FROM documents",
    "strip_marks": f"SELECT doc_id, {Q.squeeze('translate(text, ' + chr(39) + '.,' + chr(39) + ', ' + chr(39) * 2 + ')')} AS bare FROM documents",
    "punct_labels": Q.query(
        Q.SENT,
        f"""SELECT doc_id, sent_no, array_to_string(list_transform(p, lambda s: s.word), ' ') AS words,
              array_to_string(list_transform(p, lambda s: s.label), '') AS labels FROM (
            SELECT doc_id, sent_no, list_filter(list_transform(string_split(sentence, ' '), lambda t: {{'word': translate(t, {Q.PUNCT}, ''),
              'label': CASE WHEN suffix(t, '.') THEN '1' WHEN suffix(t, ',') THEN '2' ELSE '0' END}}), lambda s: s.word <> '') AS p FROM sent)""",
    ),
    "finish": Q.query(
        Q.SENT,
        """SELECT doc_id, sent_no, CASE WHEN lang IN ('fr', 'es') AND NOT regexp_matches(sentence, '[.?!]$') THEN sentence || '.' ELSE sentence END AS finished FROM sent""",
    ),
    "append_period_variants": Q.query(
        Q.SENT,
        """SELECT doc_id, sent_no, t || '.' AS always, CASE WHEN trim(t) <> '' THEN t || '.' ELSE t END AS nonblank,
             CASE WHEN t <> '' AND NOT regexp_matches(t, '[.?!]$') THEN t || '.' ELSE t END AS guarded
           FROM (SELECT doc_id, sent_no, CASE WHEN sent_no % 5 = 0 THEN '' ELSE sentence END AS t FROM sent)""",
    ),
    "capfirst": rf"""SELECT doc_id, l[1] || array_to_string(list_transform(l[2:], lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), '') AS capped FROM (
        SELECT doc_id, string_split(regexp_replace({Q.norm('text')}, '(^\s*|[.?!]\s+)([a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents)""",
    "fill_blank": f"""SELECT source, count(*) FILTER (trim(t) = '') AS blanks, {checksum_sql("CASE WHEN trim(t) = '' THEN 'a' ELSE t END")} AS digest
        FROM (SELECT source, regexp_replace(text, '[^0-9 ]+', '', 'g') AS t FROM documents) GROUP BY source""",
    "chat_messages": Q.query(
        Q.UTT,
        """SELECT utt_id, 'system,user,assistant' AS roles, 'text:transcribe ' || lang || '/audio/text:write the words/text:' || ref AS content FROM utt""",
    ),
    "chat_conversations": """SELECT conv_id, count(*) AS turns, string_agg(coalesce(role, ''), ',' ORDER BY turn, role, text) AS roles,
        md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id""",
    "ngrams": Q.query(
        Q.SENT,
        """SELECT doc_id, sent_no, array_to_string(list_transform(range(1, len(p) - 1), lambda i: array_to_string(p[i:i+2], ' ')), '|') AS grams
           FROM (SELECT doc_id, sent_no, list_concat(['<s>'], string_split(sentence, ' '), ['</s>']) AS p FROM sent)""",
    ),
    "context_features": Q.query(
        Q.UTT, _LABELLED,
        f"""feats AS (SELECT unnest(fs) AS f FROM (
              SELECT unnest(list_transform(range(1, n + 1), lambda i: {_feature_sql()})) AS fs FROM (
                SELECT lang, list_transform(p, lambda s: lower(s.word)) AS ws, len(p) AS n FROM lab)))""",
        f"SELECT split_part(f, '=', 1) AS family, count(*) AS n, {checksum_sql('f')} AS digest FROM feats GROUP BY family",
    ),
    "char_vocab": Q.query(
        Q.SENT, _CHARS.format(src="sent"),
        """all_c AS (SELECT c AS char, n, 0 AS tail FROM chars WHERE n >= 25
             UNION ALL SELECT '|', 0, 1 UNION ALL SELECT '[UNK]', 0, 2 UNION ALL SELECT '[PAD]', 0, 3)""",
        "SELECT char, row_number() OVER (ORDER BY tail, char) - 1 AS id, n FROM all_c",
    ),
    "word_vocab": Q.query(
        Q.SENT,
        """w AS (SELECT lang, word, sum(k)::BIGINT AS n FROM (SELECT lang, CASE WHEN source = 'src0' THEN 10 ELSE 1 END AS k,
             unnest(string_split(sentence, ' ')) AS word FROM sent) GROUP BY ALL)""",
        "SELECT * FROM w WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 400000",
    ),
    "text_profile": Q.query(
        f"""m AS MATERIALIZED (SELECT lang, text, len(regexp_extract_all(text, {_WORD_RE})) AS w, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS u,
             length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS a FROM documents)""",
        "s AS MATERIALIZED (SELECT lang AS scope, * FROM m UNION ALL SELECT 'overall', * FROM m)",
        f"""v AS (SELECT scope, count(DISTINCT word) AS vocab_words FROM (SELECT scope, unnest(regexp_extract_all(text, {_WORD_RE})) AS word FROM s) GROUP BY scope)""",
        "c AS (SELECT scope, count(DISTINCT ch) AS distinct_chars FROM (SELECT scope, unnest(string_split(text, '')) AS ch FROM s) WHERE ch <> '' GROUP BY scope)",
        """p AS (SELECT scope, count(*) AS n_utterances, sum(w)::BIGINT AS n_words, round(avg(w), 6) AS mean_words, round(quantile_cont(w, 0.5), 6) AS p50_words,
             round(quantile_cont(w, 0.95), 6) AS p95_words, max(w) AS max_words, sum(u) > 0 AS has_uppercase, round(sum(u) / greatest(1, sum(a)), 6) AS uppercase_ratio
             FROM s GROUP BY scope)""",
        "SELECT * FROM p LEFT JOIN v USING (scope) LEFT JOIN c USING (scope)",
    ),
    "char_profile": Q.query(
        "c AS (SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL)",
        "s AS (SELECT lang AS scope, ch, n FROM c UNION ALL SELECT 'overall', ch, sum(n)::BIGINT FROM c GROUP BY ch)",
        r"""SELECT * FROM (SELECT scope, CASE WHEN regexp_matches(ch, '^\p{P}$') THEN 'punctuation' WHEN regexp_matches(ch, '^\p{Nd}$') THEN 'digit'
              WHEN regexp_matches(ch, '^\p{L}$') AND unicode(ch) > 127 THEN 'non_ascii_letter' END AS kind, ch AS char, n FROM s) WHERE kind IS NOT NULL""",
    ),
    "text_samples": f"""SELECT lang, doc_id, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {Q.draw(1337, 'doc_id')}, doc_id) AS rank
        FROM documents) WHERE rank <= 5""",
    "split_filter": Q.query(
        Q.UTT,
        f"""SELECT utt_id, lang, ref AS transcription, 'validation' AS original_split FROM utt
            WHERE {Q.unit(Q.draw('split', 'utt_id'))} >= 0.85::DOUBLE AND length(trim(ref)) > 1""",
    ),
    "trainable_pairs": Q.query(
        Q.UTT,
        f"""SELECT * FROM (SELECT utt_id, lang, length(ref) AS n_labels, length(ref) * (900 + {Q.whole(Q.draw('pace', 'utt_id'))} % 600) AS n_samples FROM utt)
            WHERE n_samples BETWEEN 16000 AND 320000 AND n_labels > 0 AND n_labels * 1.5 < n_samples / 320""",
    ),
    "routing_map_files": Q.query(Q.UTT, "SELECT utt_id, lang FROM utt"),
    "explode_routing_map": """SELECT event_type, key, count(*) AS n, sum((props ->> key)::BIGINT)::BIGINT AS total
        FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL""",
    "file_manifest_profile": Q.query(
        r"""l AS MATERIALIZED (SELECT *, lower(regexp_extract(name, '(\.[^.]+)$', 1)) AS extension, regexp_replace(name, '\.[^.]+$', '') AS stem FROM (
             SELECT c, CASE WHEN contains(c, '/') THEN regexp_extract(c, '^([^/]*)/', 1) ELSE '(root)' END AS folder,
               regexp_extract(regexp_replace(c, '/+$', ''), '([^/]*)$', 1) AS name FROM (
               SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS c FROM pages)))""",
        "w AS (SELECT doc_id::VARCHAR AS id FROM documents)", "g AS (SELECT DISTINCT stem AS id FROM l)",
        """SELECT 'extension' AS section, extension AS item, count(*) AS n FROM l GROUP BY extension
           UNION ALL SELECT 'folder', folder, count(*) FROM l GROUP BY folder
           UNION ALL SELECT 'collisions', stem, count(*) FROM l GROUP BY stem HAVING count(*) > 1
           UNION ALL SELECT 'metadata', extension, count(*) FROM l WHERE extension IN ('.csv', '.tsv', '.json', '.jsonl', '.txt', '.yaml', '.yml') GROUP BY extension
           UNION ALL SELECT 'expected', 'wanted', count(*) FROM w UNION ALL SELECT 'expected', 'got', count(*) FROM g
           UNION ALL SELECT 'expected', 'overlap', count(*) FROM w JOIN g USING (id)
           UNION ALL SELECT 'expected', 'missing', count(*) FROM w ANTI JOIN g USING (id)
           UNION ALL SELECT 'expected', 'unexpected', count(*) FROM g ANTI JOIN w USING (id)""",
    ),
}
