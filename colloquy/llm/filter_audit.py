"""What each filter removes, in every order in which the filters may run.

Five conditions judge a whole text: A, under 200 words; B, fewer distinct words than half its
words; C, more than three capitals A-Z in a hundred code points; D, one of ``#$%&*|``; E, the
same text under a smaller id anywhere in the table, removed there or not.

A to D are functions of the text alone and come from one scan.  E is an existential self-join: a
left-semi join on hash, exact text and smaller id.  Its right side is one row per different text
(the least id), summed before the shuffle, so no two rows of a group of copies ever meet as a
pair; only texts whose hash comes under several ids are read for it.  A group of more than
``part_rows`` copies is dealt over several keys by its ids, and its one right row goes to each
of them, so that a group with a third of all rows spreads.  The ids that the join leaves are
united with the ids that fail A to D, and bits are combined per id.

All that the orders need is how many rows of a part fail which of the 32 combinations: a filter
removes, at its step, the rows that fail it and none before it.  So the 600 rows of a part come
from 96 sums, whatever the number of documents.  Over all orders a row that fails k filters is
removed by each of them in 120 / k orders.

Defined cases: a null text is empty, so it fails A alone, or A and E; a text without words has as
many distinct words as words and passes B; an empty text passes C; rows that share id and text are
judged alike and none is E because of the other; a row without an id is never E, nor a reason for
E, and has no labels; several labels of a document count as good, or toxic, if one of them says
so; a null language is the empty part; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.common import query, stored, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COMBINATIONS = 1 << len(FILTERS)
PART_ROWS = 8_192
KEY = ["doc_id", "h1", "h2", "part"]


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(text: Column) -> Column:
    """The bits of A to D."""

    def of(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
        fails = {
            "A": n < 200,
            "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
            "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
            "D": text.rlike(r"[#$%&*|]"),
        }
        return sum((F.when(c, bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # bound once: the word list is used several times
    return F.element_at(F.transform(F.array(words), of), 1)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, part, text): only the columns that count, so others cannot clash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(7), text).alias("h2"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )


def repeats(rows: DataFrame, notes: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The keys of E: rows whose whole text stands under a smaller id."""
    groups = notes.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("c"))
    parts = F.ceil(F.col("c") / part_rows).cast("long")
    groups = stored(groups.where("low < high").select("h1", "h2", parts.alias("parts")), "shared-texts")
    asked = rows.where("doc_id is not null").join(groups, ["h1", "h2"])
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    # texts of equal hash may differ, so the text is part of the key here too
    first = asked.groupBy("h1", "h2", "text").agg(F.min("doc_id").alias("first_id"), F.first("parts").alias("parts"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    a, b = asked.alias("a"), first.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("h1", "h2", "salt", "text")]
    smaller = F.col("b.first_id") < F.col("a.doc_id")
    found = a.join(b, [*same, smaller], "left_semi")
    return found.select(*KEY, F.lit(bit("E")).alias("bits"), F.lit(0).cast("long").alias("n"))


def failures(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, h1, h2, part, bits, n): of each different row the filters that it fails, and how many such rows."""
    rows = keyed(docs)
    one = F.lit(1).cast("long")
    notes = stored(rows.select(*KEY, text_failures(F.col("text")).alias("bits"), one.alias("n")), "failures")
    both = notes.unionAll(repeats(rows, notes, part_rows))
    return both.groupBy(*KEY).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, rows, good, toxic): one array of 32 counts each, by combination of bits."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    # rows without an id have no labels; their hash deals them out
    key = F.coalesce("doc_id", "h1")
    marked = failed.join(known, (key == F.col("label_id")) & F.col("doc_id").isNotNull(), "left")
    counts = {"rows": F.lit(True), "good": F.col("is_good"), "toxic": F.col("is_toxic")}
    per_bits = marked.groupBy("part", "bits").agg(
        *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in counts.items()]
    )
    return per_bits.groupBy("part").agg(
        *[
            F.array(*[F.sum(F.when(F.col("bits") == b, F.col(k)).otherwise(0)) for b in range(COMBINATIONS)]).alias(k)
            for k in counts
        ]
    )


def steps() -> Column:
    """Every (filter_order, step, the filter's bit, the bits before it): 600 fixed structs."""
    orders = F.array(*[F.lit(o) for o in ORDERS])
    code = F.create_map(*[x for f in FILTERS for x in (F.lit(f), F.lit(bit(f)))])

    def of_order(order: Column) -> Column:
        bits = F.transform(F.split(order, ""), lambda f: F.element_at(code, f))

        def of_step(step: Column) -> Column:
            before = F.aggregate(F.slice(bits, F.lit(1), step - 1), F.lit(0), lambda acc, x: acc + x)
            return F.struct(order.alias("filter_order"), step.alias("step"), F.element_at(bits, step).alias("own"), before.alias("before"))

        return F.transform(F.array(*[F.lit(i) for i in range(1, len(FILTERS) + 1)]), of_step)

    return F.flatten(F.transform(orders, of_order))


def audit(docs: DataFrame, labels: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per part, order of the filters and step, with what is kept, removed and lost there."""
    counts = combinations(failures(docs, part_rows), labels)
    rows = counts.withColumn("s", F.explode(steps())).select("part", "rows", "good", "toxic", "s.*")
    every = F.array(*[F.lit(b) for b in range(COMBINATIONS)])
    own, before = F.col("own"), F.col("before")

    def total(array: str, wanted) -> Column:
        chosen = F.filter(every, wanted)
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(F.col(array), b + 1))

    def here(b: Column) -> Column:
        return (b.bitwiseAND(own) != 0) & (b.bitwiseAND(before) == 0)

    # of a row that fails k filters, each of them removes it in 120 / k orders
    orders = F.array(*[F.lit(len(ORDERS) // max(1, b.bit_count())).cast("long") for b in range(COMBINATIONS)])
    shapley = F.aggregate(
        F.filter(every, lambda b: b.bitwiseAND(own) != 0),
        F.lit(0).cast("long"),
        lambda acc, b: acc + F.element_at(F.col("rows"), b + 1) * F.element_at(orders, b + 1),
    )
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("rows", lambda b: b.bitwiseAND(own + before) == 0).alias("kept"),
        total("rows", here).alias("removed"),
        total("rows", lambda b: (b.bitwiseAND(own) != 0) & (b.bitwiseAND(before) != 0)).alias("redundant"),
        F.element_at("rows", own + 1).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), judged AS (
  SELECT doc_id, part, 'A' AS f, len(ws) < 200 AS fails FROM words
  UNION ALL SELECT doc_id, part, 'B', 100 * len(list_distinct(ws)) < 50 * len(ws) FROM words
  UNION ALL SELECT doc_id, part, 'C', 100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 3 * length(body) FROM words
  UNION ALL SELECT doc_id, part, 'D', regexp_matches(body, '[#$%&*|]') FROM words
  UNION ALL SELECT doc_id, part, 'E', doc_id > min(doc_id) OVER (PARTITION BY body) FROM words
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(f), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(f),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(f), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(f),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(f)
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), marks AS (
  SELECT doc_id, part, coalesce(string_agg(f, '' ORDER BY f) FILTER (WHERE fails), '') AS failed
  FROM judged GROUP BY doc_id, part
), label AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), grouped AS (
  SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM marks LEFT JOIN label USING (doc_id) GROUP BY part, failed
), placed AS (
  SELECT g.*, filter_order, s.step, substr(filter_order, s.step, 1) AS own,
         contains(failed, substr(filter_order, s.step, 1)) AS hit,
         regexp_matches(substr(filter_order, 1, s.step - 1), '[_' || failed || ']') AS earlier
  FROM grouped g, orders, (VALUES (1), (2), (3), (4), (5)) s(step)
), told AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT hit AND NOT earlier THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN hit AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND earlier THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT earlier THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN hit AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
"""


@query("op13_filter_audit", SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
