"""Sources mixed to target weights by systematic sampling, in DataFrame operations only.

Within a source every document has the same expected number of copies, target over size. With the
expected copies summed in order and one random offset added, a document is taken once for each whole
number that its own share of the sum crosses. Documents are ordered by size class, so that the words
taken follow the words offered at every size.

The prefix sum is over blocks first: a block is a source, a size class and a slice of a hash, so that a
source with a third of all rows is many blocks. Rows are numbered within blocks, and blocks by their
counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one block, about.
BLOCK_ROWS = 20_000
CLASSES_PER_OCTAVE = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A seeded number in [0, 1) from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def targets(sizes: DataFrame, weights: int = 3, ceiling: int = 3) -> DataFrame:
    """source, source_size and target from the total size of each source.

    Sources in code-point order, NULL last, weigh 1..weights in turn and share all words; a target stops at
    `ceiling` times its source and the excess goes to the others by weight, until none is above. That
    is one water level: sources whose ceiling per weight is below it are full. One row per source
    is ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % weights + 1).cast("long"))
    weighed = weighed.withColumn("full", F.col("source_size") * ceiling)
    filling = Window.orderBy((F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    so_far, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0).cast("long")
    level = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(so_far), zero)).cast("double")
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), zero))
    )
    rest = weighed.withColumn("level", level).withColumn("open", F.col("full") > F.col("level") * F.col("weight"))
    # The first source that the level does not fill, in this order, ends the filling.
    water = F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return rest.select(
        "source", "source_size",
        F.coalesce(F.least(F.col("full").cast("double"), water * F.col("weight")), F.col("full").cast("double")).alias("target"),
    )


def mix(
    docs: DataFrame, seed: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id", into: str = "mix",
    block_rows: int = BLOCK_ROWS, keep: list[str] | None = None,
) -> DataFrame:
    """The rows of `docs` (columns `keep`, all by default) with a struct `into`: size (words of the text),
    source_size, target (words wanted of its source) and copies (how often the mix takes the document).

    Copies are the floor or the ceiling of target / source_size, 3 at most, and depend on the seed, ids,
    sizes and sources alone, so reruns agree. NULL and empty texts have size 0; they are numbered like
    others and add no words. NULL is a source. Rows that share an id are documents of their own. A
    column named like `into` is replaced. An empty table gives an empty mix.
    """
    names = [c for c in (keep or docs.columns) if c != into]
    sized = docs.select(
        F.struct(*names).alias("row"), F.col(source).alias("source"), F.col(doc_id).cast("string").alias("id"), word_count(F.col(text)).alias("size"))
    draw = _unit(F.lit(seed), F.coalesce("id", F.lit("")))
    total = docs.count()
    sized = sized.withColumns({
        "class": F.floor(F.log2(F.col("size") + 1) * CLASSES_PER_OCTAVE).cast("int"),
        "draw": draw,
        "slice": F.floor(draw * max(1, -(-total // block_rows))).cast("long"),
    })
    block = ["source", "class", "slice"]
    counts = sized.groupBy(*block).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    wanted = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")))
    # Blocks of a source in order, numbered in two steps: classes first, then slices within a class.
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("source", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select(*block, F.coalesce(F.sum("n").over(within), F.lit(0)).alias("offset")).alias("b")
    same = lambda a, b, cs: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cs]
    blocks = blocks.join(classes.alias("c"), same("b", "c", ["source", "class"])).join(wanted.alias("w"), same("b", "w", ["source"])).select(
        *(F.col(f"b.{c}") for c in block), (F.col("base") + F.col("offset")).alias("first"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.lit(seed), F.lit("source"), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull().cast("string"))
    blocks = blocks.withColumns({"rate": rate, "u": offset}).alias("k")
    number = F.row_number().over(Window.partitionBy(*block).orderBy("draw", "size", "id"))
    numbered = sized.withColumn("number", number).alias("r")
    joined = numbered.join(blocks, same("r", "k", block))
    place = (F.col("first") + F.col("number")).cast("double")
    copies = F.floor(place * F.col("rate") + F.col("u")) - F.floor((place - 1) * F.col("rate") + F.col("u"))
    return joined.select("row.*", F.struct("size", "source_size", "target", F.least(copies, F.lit(3)).cast("long").alias("copies")).alias(into))


def emitted(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixed.where(F.col(f"{into}.copies") > 0)
    return taken.withColumn(into, F.explode(F.array_repeat(F.lit(1), F.col(f"{into}.copies").cast("int")))).drop(into)
