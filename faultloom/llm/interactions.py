"""How quality filters interact: what each removes alone, together and in any order.

Every filter gives the ids it fails. A text that occurs under a smaller key is
found by a left-semi join on hash, exact text and smaller key. The union of
all failing ids is summed to one set of bits per document, the documents to
counts per combination of bits, and the counts answer every order of the
filters: what a filter removes depends only on the set of filters before it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.llm.common import stored, text_or_empty

#: Filters by letter; the last one looks at the whole table.
LETTERS = "ABCDE"
LEAST_WORDS = 200
SEPARATORS = r"[ \t\n\x0B\f\r]+"
MARKS = r"[#$%&*|]"


def own_failures(text: Column) -> list[Column]:
    """Conditions A to D: few words, few distinct words, many capitals, marks of code or markup."""
    words = F.array_remove(F.split(text, SEPARATORS), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike(MARKS)]


def earlier_copies(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(k, part, h) of the rows whose text occurs under a smaller key.

    ``rows``: k, part, h, t; ``marked`` has the same k and h without texts. Only
    texts whose hash occurs twice go on from the first join. A row asks for the
    smallest key of its text, one row a text, so a group of copies costs its
    size; both sides are stored, so that a hot text is split between tasks. The
    shared hashes grow with the table, so they are merged with it at any size
    and never broadcast.
    """
    shared = stored(marked.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    again = stored(rows.join(shared.hint("merge"), "h", "left_semi"))
    first = stored(again.groupBy("h", "t").agg(F.min("k").alias("first")))
    a, b = again.alias("a"), first.alias("b").hint("merge")
    return a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.t") == F.col("b.t")) & (F.col("b.first") < F.col("a.k")), "left_semi").select("k", "part", "h")


def failing_bits(df: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """k, part, h, bits, n: the filters that rows of one key, part and text fail (bit 0 is A), and how many rows these are."""
    rows = df.select(
        F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_or_empty(text), 256)).alias("h"), text_or_empty(text).alias("t"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own_failures(F.col("t")))), F.lit(0))
    marked = stored(rows.select("k", "part", "h", bits.cast("int").alias("bits")))
    late = earlier_copies(rows, marked).select("k", "part", "h", F.lit(1 << LETTERS.index("E")).alias("bits"), F.lit(0).alias("n"))
    return marked.withColumn("n", F.lit(1)).unionByName(late).groupBy("k", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def _places() -> list[tuple[str, int, int, int]]:
    """(order, step, filter, filters before it as bits) for all orders."""
    out = []
    for order in permutations(range(len(LETTERS))):
        name, before = "".join(LETTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append((name, step, 1 << i, before))
            before |= 1 << i
    return out


def interactions(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source", quality: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null counts as the empty text, and as the empty part. Equal empty texts are
    copies of one another. Every row is a document: rows that repeat a key and
    its text fail together, and fail E only if a smaller key has the text. A
    row without a key fails no E, makes no other row fail it and has no label.
    A document is good or toxic if any of its label rows says 1. An empty table
    gives no rows. Other columns are neither read nor renamed.
    """
    one = lambda c: F.max(F.when(F.col(f"`{c}`") == 1, 1).otherwise(0))
    known = stored(labels.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("label_of")).agg(one(quality).alias("good"), one(toxic).alias("toxic")))
    failed = failing_bits(df, text, key, part)
    combos = failed.join(known, failed.k == known.label_of, "left").groupBy(
        "part", "bits", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))
    # 80 pairs of a filter and a set before it serve all 600 places
    places = _places()
    pairs = sorted({(f, before) for _, _, f, before in places})
    asked = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(b).alias("before")) for f, b in pairs])).alias("p")
    count = lambda cond: F.coalesce(F.sum(F.expr(f"IF({cond}, n, 0L)")), F.lit(0)).cast("long")
    here = "bits & f <> 0 AND bits & before = 0"
    facts = combos.select("*", asked).select("part", "bits", "good", "toxic", "n", "p.*").groupBy("part", "f", "before").agg(
        count("bits & (f | before) = 0").alias("kept"), count(here).alias("removed"), count("bits & f <> 0 AND bits & before <> 0").alias("redundant"),
        count("bits = f").alias("unique_fails"), count(f"{here} AND good = 1").alias("good_lost"), count(f"{here} AND toxic = 1").alias("toxic_lost"))
    # 600 rows, whatever the tables hold
    steps = F.broadcast(df.sparkSession.createDataFrame(places, "filter_order string, step int, f int, before int"))
    return facts.join(steps, ["f", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "f")).alias("shapley"))
