"""DuckDB fragments the oracle queries share; each mirrors one view of `plans.views`."""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"
PUNCT = "'!\"&''(),-./:;?«»“”'"
# The accented letters of the tables, spelled as characters normalised text cannot hold,
# since DuckDB's levenshtein compares bytes.
ACCENTED = "'éóèñçüêäößíÉÓÈÑÇÜÊÄÖÍ'"
ASCII = "'0123456789#$%&*+/<=>@'"


def norm(x: str) -> str:
    return (
        rf"trim(regexp_replace(lower(translate(nfc_normalize({x}), '’ʼ‘´`', '''''''''''')), "
        r"'[^\p{L}.,''’;:!?-]+', ' ', 'g'))"
    )


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def strip_punct(x: str) -> str:
    return squeeze(f"translate({x}, {PUNCT}, '')")


def ws(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END)"


def nw(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE length({x}) - length(replace({x}, ' ', '')) + 1 END)"


def whole(h: str, part: int = 0) -> str:
    return f"('0x' || substr({h}, {1 + 8 * part}, 8))::BIGINT"


def unit(h: str, part: int = 0) -> str:
    return f"({whole(h, part)} / 4294967296::DOUBLE)"


def draw(seed, *keys: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(keys) + "))"


def pick(h: str, part: int, size: str) -> str:
    return f"({whole(h, part)} % {size} + 1)"


def query(*parts: str) -> str:
    """`WITH` all but the last part, which is the select."""
    *ctes, select = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def sentences(name: str = "sent", source: str = "documents", text: str = "text", cols: str = "doc_id, lang, source") -> str:
    return rf"""{name}_p AS (
  SELECT {cols}, unnest(l) AS piece, unnest(range(len(l)))::INTEGER AS sent_no FROM (
    SELECT {cols}, string_split(replace(regexp_replace(nfc_normalize({text}), '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)) AS l
    FROM {source})),
{name} AS MATERIALIZED (
  SELECT * FROM (SELECT {cols}, sent_no, {norm('piece')} AS sentence FROM {name}_p) WHERE sentence <> '')"""


SENT = sentences()
UTT = (
    SENT
    + """,
utt AS MATERIALIZED (
  SELECT lang || '_' || doc_id || '_' || sent_no AS utt_id, lang, source, doc_id, sent_no, sentence AS ref
  FROM sent WHERE length(sentence) > 1)"""
)
VOCAB = f"""vocab AS MATERIALIZED (
  SELECT word, row_number() OVER (ORDER BY md5(word)) - 1 AS idx FROM (
    SELECT DISTINCT unnest(string_split({strip_punct('ref')}, ' ')) AS word FROM utt) WHERE word <> '')"""


def hyps(name: str = "hyps", rate: float = 0.25, system: str = "s1", source: str = "utt", text: str = "ref") -> str:
    seed, u, r = f"1337/{system}", unit("h"), f"{rate!r}::DOUBLE"
    return f"""{name}_n AS MATERIALIZED (SELECT count(*) AS n FROM vocab),
{name}_at AS MATERIALIZED (
  SELECT utt_id, i, w, h, {whole('h', 1)} % n AS k FROM (
    SELECT *, {draw(seed, 'utt_id', 'i')} AS h FROM (SELECT utt_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT utt_id, {ws(text)} AS ws FROM {source}))), {name}_n),
{name}_said AS MATERIALIZED (
  SELECT utt_id, string_agg(CASE WHEN {u} < {r} * 0.7::DOUBLE THEN word WHEN {u} < {r} * 0.9::DOUBLE THEN NULL
    WHEN {u} < {r} THEN w || ' ' || word ELSE w END, ' ' ORDER BY i) AS said
  FROM {name}_at JOIN vocab ON idx = k GROUP BY utt_id),
{name}_spare AS MATERIALIZED (SELECT utt_id, {whole(draw(seed, 'utt_id', "'empty'"), 1)} % n AS k FROM {source}, {name}_n),
{name} AS MATERIALIZED (
  SELECT s.*, coalesce(said, word) AS hyp FROM {source} s LEFT JOIN {name}_said USING (utt_id)
  JOIN {name}_spare e ON e.utt_id = s.utt_id JOIN vocab ON idx = k)"""


def edits(name: str, pairs: str, cols: str, ref: str = "ref", hyp: str = "hyp") -> str:
    """Edit counts. Word distance: words of both sides get one ASCII symbol each, words of one
    side only share a symbol per side; pairs with more common words than ASCII holds go through
    the recurrence row by row."""
    sym = "chr(CASE WHEN list_position(common, w) > 0 THEN list_position(common, w)::INTEGER + 2 ELSE {} END)"
    code = lambda side, other: f"array_to_string(list_transform({side}, lambda w: {sym.format(other)}), '')"
    return f"""{name}_w AS MATERIALIZED (
  SELECT *, list_distinct(list_intersect(rw, hw)) AS common FROM (
    SELECT {cols}, row_number() OVER () AS rid, trim(lower({ref})) AS r, trim(lower({hyp})) AS h,
      {ws('r')} AS rw, {ws('h')} AS hw FROM {pairs})),
{name}_dp AS (
  SELECT rid, rw, hw, 0::BIGINT AS i, range(0, len(hw) + 1) AS row FROM {name}_w WHERE len(common) > 125
  UNION ALL
  SELECT rid, rw, hw, i + 1, list_transform(range(1, len(t) + 1), lambda j:
      list_min(list_transform(range(1, j + 1), lambda k: t[k] - k)) + j)
  FROM (SELECT rid, rw, hw, i, list_concat([i + 1], list_transform(range(2, len(row) + 1), lambda j:
          least(row[j] + 1, row[j - 1] + CASE WHEN rw[i + 1] = hw[j - 1] THEN 0 ELSE 1 END))) AS t
        FROM {name}_dp WHERE i < len(rw))),
{name}_long AS MATERIALIZED (SELECT rid, row[len(row)] AS d FROM {name}_dp WHERE i = len(rw)),
{name} AS MATERIALIZED (
  SELECT {cols}, CASE WHEN len(common) <= 125 THEN levenshtein({code('rw', 1)}, {code('hw', 2)}) ELSE d END::BIGINT AS word_edits,
    len(rw)::BIGINT AS ref_words,
    levenshtein(translate(r, {ACCENTED}, {ASCII}), translate(h, {ACCENTED}, {ASCII}))::BIGINT AS char_edits,
    length(r)::BIGINT AS ref_chars
  FROM {name}_w LEFT JOIN {name}_long USING (rid))"""


SUMS = "count(*) AS n, " + ", ".join(
    f"sum({c})::BIGINT AS {c}" for c in ("word_edits", "ref_words", "char_edits", "ref_chars")
)
RATES = (
    "round(word_edits / ref_words, 6) AS wer, round(char_edits / ref_chars, 6) AS cer, "
    "round(0.5::DOUBLE * (1 - word_edits / ref_words) + 0.5::DOUBLE * (1 - char_edits / ref_chars), 6) AS multi"
)
MULTI = "(0.5::DOUBLE * (1 - sum(word_edits) / sum(ref_words)) + 0.5::DOUBLE * (1 - sum(char_edits) / sum(ref_chars)))"
HYPS = UTT + ",\n" + VOCAB + ",\n" + hyps()
EDITS = HYPS + ",\n" + edits("ed", "hyps", "utt_id, lang")
