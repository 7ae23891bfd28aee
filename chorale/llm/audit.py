"""Filter interaction audit: what each of five filters does in each of the 120 orders, by recursive enumeration over mask cells.

Every document gets the bits of the filters it fails; documents are counted by (part, bits), at most 32 cells a part. A recursive
query then extends filter prefixes with the letters not yet used, carries each cell and the bits applied so far along, and every
level of the recursion emits that step's metrics. The work after the counting does not depend on the number of documents.

Filters: A fewer than 50 words; B distinct words below 65 % of the words; C capitals A-Z above 5 % of the code points; D holds any of
`#$%&*|`; E the text is that of a document with a smaller id. Words are `[^\\x20\\x09-\\x0D]+`.

Null text: empty (fails A; E as any other text). Null source: the part ''. Null doc_id: neither smaller than another nor preceded by
one, without labels. Rows that repeat an id and a text count each and do not fail E by one another. Several label rows of an id: a
label counts if any of them has it. An empty table has no parts and gives no rows. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
#: Letter and bit of each filter.
FILTERS = [("A", 1), ("B", 2), ("C", 4), ("D", 8), ("E", 16)]
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
TEXT_SALT = 997

WALK = """
WITH RECURSIVE walk(part, mask, n, good, toxic, prefix, bit, applied, step) AS (
  SELECT part, mask, n, good, toxic, '', 0, 0, 0 FROM {cells}
  UNION ALL
  SELECT part, mask, n, good, toxic, concat(prefix, next.letter), next.bit, applied | bit, step + 1
  FROM walk LATERAL VIEW explode(filter(FILTERS, f -> (applied | bit) & f.bit = 0)) unused AS next
)
SELECT part, prefix, right(prefix, 1) AS letter, step,
  sum(IF(mask & (applied | bit) = 0, n, 0L)) AS kept,
  sum(IF(mask & applied = 0 AND mask & bit <> 0, n, 0L)) AS removed,
  sum(IF(mask & applied <> 0 AND mask & bit <> 0, n, 0L)) AS redundant,
  sum(IF(mask = bit, n, 0L)) AS unique_fails,
  sum(IF(mask & applied = 0 AND mask & bit <> 0, good, 0L)) AS good_lost,
  sum(IF(mask & applied = 0 AND mask & bit <> 0, toxic, 0L)) AS toxic_lost
FROM walk WHERE step > 0 GROUP BY part, prefix, step
"""

ORDERS = """
WITH RECURSIVE orders(prefix) AS (
  SELECT '' UNION ALL
  SELECT concat(prefix, letter) FROM orders LATERAL VIEW explode(filter(LETTERS, f -> NOT contains(prefix, f))) unused AS letter
)
SELECT prefix AS filter_order, step, left(prefix, step) AS prefix FROM orders LATERAL VIEW explode(sequence(1, SIZE)) s AS step WHERE length(prefix) = SIZE
"""


def failures(docs: DataFrame) -> DataFrame:
    """part, doc_id, text_key (SHA-256), mask (bits of A to D) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.btrim(text, F.lit(WHITE)).alias("bare"))
    words = F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", r"[\x20\x09-\x0D]+"))
    counted = rows.select("part", "doc_id", "text", words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.length("text").cast("long"), F.col("text").rlike(r"[#$%&*|]")]
    mask = sum(F.when(f, bit).otherwise(0) for f, (_, bit) in zip(fails, FILTERS, strict=False))
    return counted.select("part", "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"), mask.cast("int").alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail. Equal rows are counted before every shuffle, so copies are no hot key."""
    rows = failures(docs).groupBy("part", "doc_id", "text_key", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("is_good"), F.max((F.col("toxic") == 1).cast("long")).alias("is_toxic"))
    # rows without an id match nothing; the second key spreads them
    left = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text_key", "part"), F.lit(TEXT_SALT))).otherwise(F.pmod("doc_id", F.lit(1))))
    labelled = left.join(marks.withColumn("spread", F.pmod("doc_id", F.lit(1))), ["doc_id", "spread"], "left")
    good, toxic = (F.col("n") * F.coalesce(c, F.lit(0)) for c in ("is_good", "is_toxic"))
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", good.alias("good"), toxic.alias("toxic"))))
    by_part = labelled.groupBy("text_key", "part", "mask").agg(F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), own.alias("own"))
    least = by_part.groupBy("text_key").agg(F.min("own.doc_id").alias("low"))
    met = by_part.join(least, "text_key")
    # of a text's rows, the ones with the smallest id and the ones without an id do not fail E
    first = F.col("own.doc_id") == F.col("low")
    alone = [F.coalesce(F.when(first, F.col(f"own.{c}")), F.lit(0)) + (F.col("n_null") if c == "n" else 0) for c in ("n", "good", "toxic")]
    two = F.array(
        F.struct(F.col("mask"), *(a.alias(c) for a, c in zip(alone, ("n", "good", "toxic"), strict=True))),
        F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - a).alias(c) for a, c in zip(alone, ("n", "good", "toxic"), strict=True))),
    )
    return met.select("part", F.inline(two)).where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the walk has 326 rows a cell, however many parts there are
    counted = cut_lineage(cells(docs, labels))  # at most 32 rows a part; every level of the recursion reads it
    steps = cut_lineage(spark.sql(WALK.replace("FILTERS", "array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {bit})" for x, bit in FILTERS) + ")"), cells=counted))
    orders = spark.sql(ORDERS.replace("LETTERS", "array(" + ", ".join(f"'{x}'" for x, _ in FILTERS) + ")").replace("SIZE", str(len(FILTERS))))
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * F.factorial(len(FILTERS) - F.col("step"))).alias("shapley"))
    placed = steps.drop("step").join(F.broadcast(orders), "prefix")  # 600 rows, whatever the input
    return placed.join(shares, ["part", "letter"]).select("part", "filter_order", "step", *METRICS, "shapley")
