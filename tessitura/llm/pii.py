"""Personal data in texts: exact base patterns, and wider candidates chosen by boosted trees.

Everything stays in the row, in SQL functions: a pattern's matches and the pieces between them give positions,
high-recall generators propose spans with format and context features, and the fitted trees become one SQL
expression over those features. Only the fit reads candidates across rows.

The trees learn from a bounded sample of candidates, chosen by a hash, what the base patterns confirm or other
evidence supports: with obfuscation undone a check holds (domain, octets, Luhn, count of digits), and the form or a
word before it tells the kind. Each kind's threshold is the lowest score at which, over the candidates outside base
spans of the documents kept back from the sample, the wanted share has such evidence.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Stand-ins for a dot between name characters and a lone separator between digits: noncharacters.
DOT, GAP = "﷐", "﷑"
MATCHES = "array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"
SAMPLE_CANDIDATES = 20_000
PRECISION = 0.95
TREES, DEPTH = 20, 4

# Groups repeated over a whole text would recurse in the matcher, so dots and gaps that a match may cross are
# first replaced by marks of the same length; each class is then taken in one possessive run.
NAME = rf"A-Za-z0-9._%+\-{DOT}"
EMAIL = rf"(?:(?<![{NAME}])|\G)[{NAME}]++@[A-Za-z0-9\-]++{DOT}[A-Za-z0-9\-{DOT}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?"
CARD = rf"[0-9][0-9{GAP}]++"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"

#: Generators of candidates: bounded repeats only.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+\-])[a-z0-9._%+\-]{1,64} {0,2}(?:@|＠|\(at\)|\[at\]|\{at\}) {0,2}[a-z0-9\-]{1,63}"
    r"(?:(?:(?:\.| {0,2}(?:\(dot\)|\[dot\]|\{dot\}) {0,2})[a-z0-9\-]{2,63}){1,5}|(?: {1,2}\. {1,2}[a-z0-9\-]{2,63}){1,5})",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/\-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9](?:[ ().\-/]{0,3}[0-9]){6,14}(?![0-9A-Za-z])",
}
GUARD = {"email": r"(?i)@|＠|[(\[{]at[)\]}]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CUES = {
    "email": r"(?i)mail|contact|write|reach|address",
    "ip": r"(?i)\bip\b|host|server|address|client|from",
    "card": r"(?i)card|visa|credit|debit|account|pay",
    "phone": r"(?i)phone|tel|call|fax|mobile|cell|contact|whatsapp",
}
#: What obfuscation writes for an at sign and a dot.
AT = r"(?i) *(?:＠|\(at\)|\[at\]|\{at\}) *"
POINT = r"(?i) *(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\)) *"
LABEL = r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?"
MAILBOX = rf"(?i)^[a-z0-9_%+\-](?:[a-z0-9._%+\-]*[a-z0-9_%+\-])?@(?:{LABEL}\.)+(?:[a-z]{{2}}|com|org|net|edu|gov|mil|int|info|biz|name|app|dev|online|site|example|test)$"
CARD_FORM = r"^[0-9]{4}(?:[ ._/\-]{1,2}[0-9]{4}){3}$|^3[0-9]{3}[ ._/\-]{1,2}[0-9]{6}[ ._/\-]{1,2}[0-9]{5}$"
PHONE_FORM = r"^\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}$|^[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}$|^(?:\+|00)[1-9][ ().0-9\-]{8,}$"
#: Dates and spans of years are no phone numbers.
DATE = r"^(?:19|20)[0-9]{2}[ ./\-]+[0-9]{1,2}[ ./\-]+[0-9]{1,2}$|^[0-9]{1,2}[ ./\-]+[0-9]{1,2}[ ./\-]+(?:19|20)[0-9]{2}$|^(?:19|20)[0-9]{2}[ /\-]+(?:19|20)[0-9]{2}$"
FEATURES = ("length", "digits", "letters", "dots", "spaces", "hyphens", "brackets", "slashes", "plus", "various", "cue", "joined", "followed", "quoted", "valid", "form")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before, after>> of a pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(MATCHES).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"), F.right(pair["piece"], F.lit(24)).alias("before"),
                       F.left(pair["next"], F.lit(2)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = F.transform(found, lambda m, i: F.struct(F.get(pieces, i).alias("piece"), m.alias("match"), F.get(pieces, i + 1).alias("next")))
    return F.aggregate(pairs, zero, step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled and its digits summed."""
    backwards = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(backwards, lambda d: d != ""), lambda d: d.cast("int"))
    worth = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the base patterns, by start and kind."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    plain = F.translate(text, DOT + GAP, "??")
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9\-])\.(?=[A-Za-z0-9\-])", DOT)
    gapped = F.regexp_replace(plain, r"(?<=[0-9])[ \-](?=[0-9])", GAP)
    digits = lambda m: F.regexp_replace(m["match"], "[^0-9]", "")
    between = lambda m, low, high: F.length(digits(m)).between(low, high)
    emails = _matches(dotted, EMAIL)
    ips = F.filter(_matches(text, IP), lambda m: m["match"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))
    cards = F.filter(_matches(gapped, CARD), lambda m: F.when(between(m, 12, 19), luhn(digits(m))).otherwise(False))
    phones = F.filter(_matches(text, PHONE), lambda m: between(m, 9, 15))
    some = F.regexp_like(text, F.lit("[0-9]"))
    return F.array_sort(F.concat(
        F.when(F.contains(text, F.lit("@")), _spans(emails, 0)).otherwise(empty),
        F.when(some & F.contains(text, F.lit(".")), _spans(ips, 1)).otherwise(empty),
        F.when(some, _spans(cards, 2)).otherwise(empty),
        F.when(some & F.contains(text, F.lit("+")), _spans(phones, 3)).otherwise(empty),
    ))


def candidate_spans(text: Column) -> Column:
    """array<struct<start, kind, end, features...>> of the generators; spans may overlap."""

    def described(kind: int):
        def row(m: Column) -> Column:
            s, before, after = m["match"], m["before"], m["after"]
            digits = F.regexp_replace(s, "[^0-9]", "")
            flag = lambda c: c.cast("double")
            valid, form = _evidence(s, digits, kind)
            values = {
                "length": F.length(s), "digits": F.length(digits), "letters": _count(s, "[A-Za-z]"), "dots": _count(s, r"[.]"),
                "spaces": _count(s, " "), "hyphens": _count(s, "-"), "brackets": _count(s, r"[()\[\]{}]"), "slashes": _count(s, "[/_]"),
                "plus": flag(F.startswith(s, F.lit("+"))), "various": F.size(F.array_distinct(F.split(digits, ""))),
                "cue": flag(before.rlike(CUES[KINDS[kind]])), "joined": flag(before.rlike(r"[A-Za-z0-9=#&/]$")),
                "followed": flag(after.rlike(r"^[A-Za-z0-9=#%/]")), "quoted": flag(before.rlike("[\"'=:]\\s?$")),
                "valid": flag(valid), "form": flag(form),
            }
            return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"),
                            *(values[f].cast("double").alias(f) for f in FEATURES))

        return row

    fields = ",".join(f"{f}:double" for f in FEATURES)
    empty = F.array().cast(f"array<struct<start:bigint,kind:int,end:bigint,{fields}>>")
    return F.concat(*(
        F.when(F.regexp_like(text, F.lit(GUARD[name])), F.transform(_matches(text, WIDE[name]), described(k))).otherwise(empty)
        for k, name in enumerate(KINDS)
    ))


def _evidence(match: Column, digits: Column, kind: int) -> tuple[Column, Column]:
    """Whether a candidate passes its kind's check with obfuscation undone, and whether its form alone tells the kind."""
    if KINDS[kind] in ("email", "ip"):
        undone = F.regexp_replace(F.regexp_replace(match, AT, "@"), POINT, ".")
        pattern = MAILBOX if KINDS[kind] == "email" else rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"
        return F.replace(undone, F.lit(" "), F.lit("")).rlike(pattern), ~F.contains(undone, F.lit(" "))
    if KINDS[kind] == "card":
        return F.when(digits.rlike("^[2-6]") & F.length(digits).between(12, 19), luhn(digits)).otherwise(False), match.rlike(CARD_FORM)
    return F.length(digits).between(7, 15) & ~match.rlike(DATE), match.rlike(PHONE_FORM)


def supported(c: Column) -> Column:
    """Whether evidence apart from the base patterns says that a candidate is personal data."""
    return (c["valid"] > 0) & ((c["form"] > 0) | (c["cue"] > 0)) & (c["joined"] == 0) & (c["followed"] == 0)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


class Redactor(NamedTuple):
    """Trees as (weight, nested tuples of (feature, cut, low, high)), and a threshold per kind; no trees: nothing is added."""

    trees: list[tuple[float, object]]
    thresholds: tuple[float, ...]

    def score(self, c: Column) -> Column:
        """The probability that a candidate is personal data."""
        names = ("kind", *FEATURES)

        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, cut, low, high = node
            return F.when(c[names[feature]] <= cut, value(low)).otherwise(value(high))

        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(weight) * value(tree)
        return 1 / (1 + F.exp(-2 * margin))


def _parsed(debug: str) -> list[tuple[float, object]]:
    """The trees of a fitted model from its description."""
    lines = [line.strip() for line in debug.splitlines()[1:] if line.strip()]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        at += 1  # the Else line
        return int(feature), float(cut), low, node()

    trees = []
    while at < len(lines):
        weight = float(re.search(r"weight ([-\d.eE]+)", lines[at])[1])
        at += 1
        trees.append((weight, node()))
    return trees


def train(found: DataFrame, sample: int = SAMPLE_CANDIDATES, precision: float = PRECISION) -> Redactor:
    """Fits on rows of (id, base, candidates). With under 20 candidates of either label nothing is learned."""
    one = F.explode("candidates")
    rows = found.where(F.size("candidates") > 0).select("id", "base", one.alias("c"))
    confirmed = F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & overlap(b, F.col("c")))
    outside = ~F.exists("base", lambda b: overlap(b, F.col("c")))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("id"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rows = rows.select("c.*", (confirmed | supported(F.col("c"))).cast("double").alias("label"), outside.alias("outside"), draw.alias("draw"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if min(sizes.get(0.0, 0), sizes.get(1.0, 0)) < 20:
        return Redactor([], (2.0,) * len(KINDS))
    share = min(0.7, sample / sum(sizes.values()))
    whole = VectorAssembler(inputCols=["kind", *FEATURES], outputCol="features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label").fit(whole.transform(rows.where(F.col("draw") < share).limit(2 * sample)))
    redactor = Redactor(_parsed(model.toDebugString), ())
    columns = F.struct(F.col("kind"), *(F.col(f) for f in FEATURES))
    back = rows.where((F.col("draw") >= share) & F.col("outside")).select("kind", F.floor(redactor.score(columns) * 100).cast("int").alias("score"), "label")
    table = back.groupBy("kind", "score").agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()  # 101 rows a kind at most
    thresholds = []
    for k in range(len(KINDS)):
        mine, right, n, best = sorted((r for r in table if r["kind"] == k), key=lambda r: -r["score"]), 0.0, 0, 2.0
        for r in mine:
            right, n = right + r["right"], n + r["n"]
            if right >= precision * n and n >= 10:
                best = r["score"] / 100
        thresholds.append(best)
    return Redactor(redactor.trees, tuple(thresholds))


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", into: str = "personal", keep: list[str] | None = None,
                       redactor: Redactor | None = None) -> DataFrame:
    """The rows of `docs` (columns `keep`, all by default) with `into`: base and added, both
    array<struct<start, kind, end>> (code points, end exclusive, kind a number in KINDS) by start and kind.

    Base spans are the matches of each kind's pattern, leftmost and non-overlapping, that pass its check. Added
    spans are candidates at or above their kind's threshold that overlap no base span; of candidates that
    overlap each other the best scored, then first, stays. NULL reads as empty and has no spans. Rows are
    independent: repeated rows get equal spans. A column named like `into` is replaced.
    """
    names = [c for c in (keep or docs.columns) if c != into]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(F.struct(*names).alias("row"), F.col(doc_id).cast("string").alias("id"), base_spans(whole).alias("base"),
                        candidate_spans(whole).alias("candidates"))
    redactor = redactor or train(found.select("id", "base", "candidates"))
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    if redactor.trees:
        bar = F.array(*(F.lit(float(t)) for t in redactor.thresholds))
        new = F.filter("candidates", lambda c: ~F.exists("base", lambda b: overlap(b, c)))
        scored = F.transform(new, lambda c: F.struct(redactor.score(c).alias("score"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
        found = found.withColumn("scored", F.filter(scored, lambda c: c["score"] >= F.get(bar, c["kind"])))
        better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (
            (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"]))))
        added = F.filter("scored", lambda c: ~F.exists("scored", lambda d: overlap(c, d) & better(d, c)))
        added = F.array_sort(F.transform(added, plain))
    else:
        added = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.select("row.*", F.struct("base", added.alias("added")).alias(into))


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
