"""Profiles of text, ids and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.draws import SEED, draw
from tessitura.functions.text import SPACE, is_blank, lang_from_id
from tessitura.functions.words import let, n_words, ngrams, tokens, words
from tessitura.operators.sampling import top_by_count

NOT_SPACE = "[^" + SPACE[1:]


def both_scopes(per_lang: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Roll already aggregated per-language rows up to `overall` as well."""
    cols = [F.col("lang"), *[F.col(k) for k in keys]]
    rolled = per_lang.groupingSets([cols, cols[1:]], *cols).agg(
        F.grouping("lang").alias("_all"), *[F.sum(s).alias(s) for s in sums]
    )
    scope = F.when(F.col("_all") == 1, "overall").otherwise(F.col("lang"))
    return rolled.select(scope.alias("scope"), *keys, *sums)


def char_counts(rows: DataFrame, text: str) -> DataFrame:
    """`(scope, char, n)` per language and overall."""
    per = (
        rows.select("lang", F.explode(F.split(F.col(text), "")).alias("char"))
        .where(F.col("char") != "")
        .groupBy("lang", "char")
        .agg(F.count("*").alias("n"))
    )
    return both_scopes(per, ["char"], ["n"])


def char_profile(rows: DataFrame, text: str) -> DataFrame:
    """Punctuation, digits and non-ASCII letters with their counts, per scope."""
    kind = (
        F.when(F.col("char").rlike(r"^\p{P}$"), "punctuation")
        .when(F.col("char").rlike(r"^\p{Nd}$"), "digit")
        .when(F.col("char").rlike(r"^\p{L}$") & (F.ascii("char") > 127), "non_ascii_letter")
    )
    return char_counts(rows, text).withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "scope", "kind", "char", "n"
    )


def text_profile(rows: DataFrame, text: str) -> DataFrame:
    """Sizes, word counts and letter case per language and overall.

    Percentiles are exact: they are taken over the histogram of words per row.
    """
    measured = rows.where(F.col(text).isNotNull()).select(
        "lang",
        F.regexp_count(text, F.lit(NOT_SPACE + "+")).cast("bigint").alias("w"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("bigint").alias("upper"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("bigint").alias("alpha"),
    )
    hist = measured.groupBy("lang", "w").agg(
        F.count("*").alias("n"), F.sum("upper").alias("upper"), F.sum("alpha").alias("alpha")
    )
    sizes = (
        both_scopes(hist, ["w"], ["n", "upper", "alpha"])
        .groupBy("scope")
        .agg(
            F.sum("n").alias("n_utterances"),
            F.sum(F.col("w") * F.col("n")).alias("n_words"),
            (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean_words"),
            F.percentile("w", F.lit(0.5), F.col("n")).alias("p50_words"),
            F.percentile("w", F.lit(0.95), F.col("n")).alias("p95_words"),
            F.max("w").alias("max_words"),
            (F.sum("upper") > 0).alias("has_uppercase"),
            (F.sum("upper") / F.greatest(F.lit(1), F.sum("alpha"))).alias("uppercase_ratio"),
        )
    )
    seen = rows.select("lang", F.explode(tokens(F.col(text))).alias("word")).distinct()
    vocab = both_scopes(seen.withColumn("n", F.lit(1)), ["word"], ["n"]).groupBy("scope").agg(
        F.count("*").alias("vocab_words")
    )
    chars = char_counts(rows, text).groupBy("scope").agg(F.count("*").alias("distinct_chars"))
    return sizes.join(vocab, "scope", "left").join(chars, "scope", "left")


def text_samples(rows: DataFrame, text: str, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """`k` seeded sample texts per language; map tasks keep k rows each."""
    order = Window.partitionBy("lang").orderBy(draw(seed, F.col(key)), key)
    return rows.select("lang", key, text, F.row_number().over(order).cast("bigint").alias("rank")).where(F.col("rank") <= k)


def word_counts(rows: DataFrame, text: str, weight: Column | None = None, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Weighted occurrences of each word of single-spaced text."""
    exploded = rows.select(*by, (weight if weight is not None else F.lit(1)).alias("_w"), F.explode(words(F.col(text))).alias("word"))
    return exploded.groupBy(*by, "word").agg(F.sum("_w").cast("bigint").alias("n"))


def word_vocab(rows: DataFrame, text: str, weight: Column | None = None, min_count: int = 2, cap: int = 400_000) -> DataFrame:
    """Words seen at least `min_count` times, the `cap` most frequent per language."""
    return top_by_count(word_counts(rows, text, weight).where(F.col("n") >= min_count), ["lang"], "word", "n", cap)


def id_shape_profile(ids: DataFrame, pattern: str, prefix: str, key: str = "utt_id") -> DataFrame:
    """Do ids of one shape hide structure: letter shares against the uniform 1/26."""
    shaped = ids.select(F.col(key).rlike(pattern).alias("ok"), F.expr(f"replace({key}, '{prefix}', '')").alias("body"))
    letters = (
        shaped.where("ok").select(F.explode(F.split("body", "")).alias("letter")).where(F.col("letter") != "")
        .groupBy("letter").agg(F.count("*").alias("n"))
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return letters.select(
        "letter",
        "n",
        share.alias("share"),
        (share - 1 / 26).alias("excess"),
        shaped.agg(F.count("*")).scalar().alias("ids"),
        shaped.agg(F.count_if("ok")).scalar().alias("matching"),
    )


def mix_from_ids(ids: DataFrame, langs: list[str], key: str = "utt_id") -> DataFrame:
    """Language mix of a table that has ids only, from their prefixes."""
    counted = ids.groupBy(lang_from_id(F.col(key), langs).alias("lang")).agg(F.count("*").alias("n"))
    known = counted.where(F.col("lang").isNotNull())
    return known.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def punct_density(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Marks per row and per 1,000 words, closing marks, apostrophes and blanks."""
    t = F.coalesce(F.col(text), F.lit(""))

    def many(mark: str) -> Column:
        return F.sum(F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit(""))))

    stripped = F.regexp_replace(t, f"{SPACE}+$", "")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.regexp_count(t, F.lit(NOT_SPACE + "+"))).alias("words"),
        many(".").alias("periods"),
        many(",").alias("commas"),
        (many("'") + many("’")).alias("apostrophes"),
        F.count_if(F.endswith(stripped, F.lit("."))).alias("end_period"),
        F.count_if(stripped.rlike("[.?!]$")).alias("end_any"),
        F.count_if(is_blank(t)).alias("blanks"),
    )
    return sums.withColumns(
        {
            "periods_per_row": F.col("periods") / F.col("n"),
            "commas_per_row": F.col("commas") / F.col("n"),
            "periods_per_1000": F.try_divide(1000 * F.col("periods"), F.col("words")),
            "commas_per_1000": F.try_divide(1000 * F.col("commas"), F.col("words")),
            "end_period_share": F.col("end_period") / F.col("n"),
        }
    )


def suspicious_rows(rows: DataFrame, text: str, by: list[str], long_words: int = 200) -> DataFrame:
    """Blank-like values, mean length, loops longer than `long_words` words, leaked bracket tokens."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.regexp_count(t, F.lit(NOT_SPACE + "+"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.trim(t).isin("", "nan", "a")).alias("blank_like"),
        F.avg(F.length(t)).alias("mean_chars"),
        F.max(w).cast("bigint").alias("max_words"),
        F.count_if(w > long_words).alias("loops"),
        F.count_if(t.rlike(r"[\[\]<>]")).alias("bracketed"),
    )


def repetition_rate(rows: DataFrame, text: str, key: str, n: int = 4) -> DataFrame:
    """Share of n-grams that repeat an n-gram of the same row, per language."""
    grams = ngrams(words(F.col(text)), n, sentinels=False)
    per = rows.select("lang", let(grams, lambda g: F.struct(F.size(g).alias("total"), F.size(F.array_distinct(g)).alias("kinds"))).alias("g"))
    sums = per.groupBy("lang").agg(F.sum("g.total").alias("grams"), F.sum(F.col("g.total") - F.col("g.kinds")).alias("repeats"))
    return sums.withColumn("rate", F.try_divide("repeats", "grams"))


def repeated_gram_share(rows: DataFrame, text: str, n: int = 4) -> DataFrame:
    """Share of n-gram occurrences whose n-gram occurs more than once in the whole file."""
    grams = rows.select("lang", F.explode(ngrams(words(F.col(text)), n, sentinels=False)).alias("gram"))
    counted = grams.groupBy("lang", "gram").agg(F.count("*").alias("c"))
    sums = counted.groupBy("lang").agg(F.sum("c").alias("grams"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("repeated"))
    return sums.withColumn("rate", F.col("repeated") / F.col("grams"))


def token_jaccard(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Mean Jaccard similarity of two systems' token sets, and the pooled one."""
    x, y = words(F.col(a)), words(F.col(b))
    sets = pairs.select(*by, F.size(F.array_intersect(x, y)).alias("both"), F.size(F.array_union(x, y)).alias("either"))
    return sets.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("either") == 0, 1.0).otherwise(F.try_divide("both", "either"))).alias("mean_jaccard"),
        F.try_divide(F.sum("both"), F.sum("either")).alias("pooled_jaccard"),
    )


def glued_token_rate(pairs: DataFrame, ref: str, hyp: str, by: list[str]) -> DataFrame:
    """Share of hypothesis tokens that are two neighbouring reference tokens run together."""
    glued = let(
        words(F.col(ref)),
        lambda r: F.when(
            F.size(r) >= 2,
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.concat(F.element_at(r, i), F.element_at(r, i + 1)))
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    staged = pairs.select(*by, words(F.col(hyp)).alias("_h"), glued.alias("_g"))
    counted = staged.select(
        *by, F.size("_h").alias("tokens"), F.size(F.filter("_h", lambda w: F.array_contains(F.col("_g"), w))).alias("glued")
    )
    sums = counted.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.sum("glued").alias("glued"))
    return sums.withColumn("rate", F.try_divide("glued", "tokens"))


def oov_rate(hyps: DataFrame, vocab: DataFrame, text: str = "hyp") -> DataFrame:
    """Share of hypothesis tokens missing from a vocabulary (`lang, word`).

    Tokens are counted before the join, so it meets each word once and a frequent
    word weighs no more than a rare one.
    """
    counted = word_counts(hyps, text)
    joined = counted.join(vocab.select("lang", "word", F.col("word").alias("_known")), ["lang", "word"], "left")
    sums = joined.groupBy("lang").agg(
        F.sum("n").alias("tokens"), F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0)).alias("oov")
    )
    return sums.withColumn("rate", F.col("oov") / F.col("tokens"))


def file_parts(path: Column) -> dict[str, Column]:
    """Extension, top folder and stem of a path or URL without host, query and fragment."""
    clean = F.regexp_replace(F.regexp_replace(path, r"^[a-z]+://[^/]*/?", ""), r"[?#].*$", "")
    name = F.regexp_extract(F.regexp_replace(clean, r"/+$", ""), r"([^/]*)$", 1)
    return {
        "extension": F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)),
        "folder": F.when(F.contains(clean, F.lit("/")), F.regexp_extract(clean, r"^([^/]*)/", 1)).otherwise("(root)"),
        "stem": F.regexp_replace(name, r"\.[^.]+$", ""),
    }


DATA_FILES = (".csv", ".tsv", ".json", ".jsonl", ".txt", ".yaml", ".yml")  # fixed values


def file_manifest_profile(paths: DataFrame, expected: DataFrame | None = None, path: str = "path") -> dict[str, DataFrame]:
    """Listing profile: extensions, top folders, colliding stems, metadata members, expected ids.

    Entries that are directories (trailing slash) count like files only when the
    path names a page; pass them filtered otherwise.
    """
    parts = file_parts(F.col(path))
    listed = paths.select(F.col(path).alias("path"), *[c.alias(n) for n, c in parts.items()])
    stems = listed.groupBy("stem").agg(F.count("*").alias("n"))
    found = {
        "extension": listed.groupBy("extension").agg(F.count("*").alias("n")),
        "folder": listed.groupBy("folder").agg(F.count("*").alias("n")),
        "collisions": stems.where(F.col("n") > 1),
        "metadata": listed.where(F.col("extension").isin(*DATA_FILES)).groupBy("extension").agg(F.count("*").alias("n")),
    }
    if expected is not None:
        found["expected"] = id_reconcile(expected.select(F.col(expected.columns[0]).alias("id")), stems.select(F.col("stem").alias("id")))
    return found


def id_reconcile(wanted: DataFrame, got: DataFrame, key: str = "id") -> DataFrame:
    """Sizes of two id sets, their overlap, and what either side lacks."""
    a = wanted.select(key).distinct().withColumn("_a", F.col(key))
    b = got.select(key).distinct().withColumn("_b", F.col(key))
    sums = a.join(b, key, "full_outer").agg(
        F.count("_a").alias("wanted"),
        F.count("_b").alias("got"),
        F.count_if(F.col("_a") == F.col("_b")).alias("overlap"),
        F.count_if(F.col("_b").isNull()).alias("missing"),
        F.count_if(F.col("_a").isNull()).alias("unexpected"),
    )
    return sums.withColumn("disjoint", F.col("overlap") == 0)


def align_files(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """Two submissions row by row: identical, identical but for case, changed."""
    return align_several(a, b, key, text, {"b": text}).drop("against")


def align_several(a: DataFrame, b: DataFrame, key: str, text: str, others: dict[str, str]) -> DataFrame:
    """`align_files` of a submission and several that are columns of one table, `against` which name: they meet once."""
    joined = a.select(key, F.col(text).alias("x")).join(b.select(key, *[F.col(c).alias(f"y{k}") for k, c in enumerate(others.values())]), key)
    sums = []
    for k in range(len(others)):
        y = F.col(f"y{k}")
        same, folded = F.col("x") == y, F.lower("x") == F.lower(y)
        sums += [F.count("*").alias(f"rows{k}"), F.count_if(same).alias(f"identical{k}"), F.count_if(folded & ~same).alias(f"case_only{k}"), F.count_if(~folded).alias(f"changed{k}")]
    names = ("rows", "identical", "case_only", "changed")
    each = [F.struct(*[F.col(f"{c}{k}").alias(c) for c in names], F.lit(n).alias("against")) for k, n in enumerate(others)]
    return joined.agg(*sums).select(F.inline(F.array(*each)))
