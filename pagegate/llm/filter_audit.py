"""Which filter removes what, in every order: audit of five filters by the Hart-Mas-Colell potential.

A document fails a filter or not, so five bits say all that any order of filters does to it. In the removal game a
coalition of filters removes v(S) documents: those that fail one of S at least. Documents are counted once by their bits; from
there on each part has 32 coalitions, whatever its size.

The potential is P(nothing) = 0 and P(S) = (v(S) + sum of P(S without i) for i in S) / |S|. A filter's Shapley value is P(all) less
P(all without it). Kept 120-fold it is a whole number at every coalition, and equals the documents that the filter removes
summed over all 120 orders. Steps are differences of coalitions: a filter after others removes v(others and it) - v(others).

Conditions of failure (a word is a maximal run of other characters than space and \\x09-\\x0D; case counts):
A fewer than 100 words; B distinct words below 80 % of words; C capitals A-Z above 10 % of code points; D one of #$%&*|;
E a smaller doc_id has the same text anywhere in the table. A null text is empty; so it fails A, and E beside another empty one.
Rows with one id and one text are not smaller than each other; a null id is neither smaller nor larger, so such a row never fails E
nor makes another fail. A null lang is the part ''. Repeated rows count each. Of several labels of one document, any that says 1
counts; a document without label is neither good nor toxic. Other columns are not read. An empty table gives an empty result.

Copies are counted by digest before they are dealt (partial sums on both exchanges), so a text that a third of all rows
share is a few rows when it meets. The largest row is a document's words.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegate.llm.tables import table

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
SCALE = 120  # 5!; makes every potential of five filters whole
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def members(coalition: int) -> list[int]:
    return [k for k in range(len(FILTERS)) if coalition >> k & 1]


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and fails: the bits of A to D, which a text alone decides."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bare = F.trim(F.col("text"), F.lit(BLANKS))
    words = text.withColumn("words", F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, BLANK)))
    n = F.size("words")
    tests = (
        n < 100,
        100 * F.size(F.array_distinct("words")) < 80 * n,
        100 * F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 10 * F.char_length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    )
    bits = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return words.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.alias("fails"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), n, good, toxic: long counts of documents."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    kind = ["digest", "fails", "part", "good", "toxic"]
    rows = own_failures(docs).join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    # rows of one id are counted where the join has left them; then copies of a text
    by_id = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    copies = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    free = F.col("no_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = copies.withColumn("first", first).withColumn("free", free).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct(F.col("fails"), F.col("free").alias("n")), F.struct((F.col("fails") + F.lit(16)).alias("fails"), (F.col("n") - F.col("free")).alias("n")))).alias("x"),
    ).filter("x.n > 0")
    return split.groupBy("part", F.col("x.fails").alias("fails")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic")
    )


def coalitions(counts: DataFrame) -> DataFrame:
    """One row per part: total, alone (per filter: fails nothing else), and for each coalition 0..31 what it removes: of all, good, toxic."""

    def hit(s: int) -> Column:
        return F.col("fails").bitwiseAND(s) != 0

    def removed(value: str) -> Column:
        return F.array(F.lit(0).cast("long"), *[F.sum(F.when(hit(s), F.col(value)).otherwise(0)) for s in range(1, ALL + 1)])

    alone = F.array(*[F.sum(F.when(F.col("fails") == (1 << k), F.col("n")).otherwise(0)) for k in range(len(FILTERS))])
    return counts.groupBy("part").agg(F.sum("n").alias("total"), alone.alias("alone"), *[removed(c).alias(f"v_{c}") for c in ("n", "good", "toxic")])


def with_shapley(games: DataFrame) -> DataFrame:
    """Adds shapley: for each filter 120 times its Shapley value in the removal game, from the potential of every coalition."""
    out = games.withColumn("p0", F.lit(0).cast("long"))
    for size in range(1, len(FILTERS) + 1):  # a coalition's potential needs those with one filter less
        level = {}
        for s in (s for s in range(1, ALL + 1) if len(members(s)) == size):
            smaller = " + ".join(f"p{s & ~(1 << k)}" for k in members(s))
            level[f"p{s}"] = F.expr(f"({SCALE} * get(v_n, {s}) + {smaller}) div {size}")  # leaves no rest
        out = out.withColumns(level)
    shapley = F.array(*[F.col(f"p{ALL}") - F.col(f"p{ALL & ~(1 << k)}") for k in range(len(FILTERS))])
    return out.withColumn("shapley", shapley).drop(*[f"p{s}" for s in range(ALL + 1)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    games = with_shapley(coalitions(failures(docs, labels)))
    n = len(FILTERS)
    order = games.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])))
    places = order.withColumn("places", F.expr(f"transform(sequence(1, {n}), i -> instr('{FILTERS}', substr(filter_order, i, 1)) - 1)"))
    step = places.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("own", F.expr("get(places, step - 1)"))
    before = step.withColumn("before", F.expr("aggregate(slice(places, 1, step - 1), 0, (s, k) -> s | shiftleft(1, k))"))
    now = before.withColumn("now", F.expr("before | shiftleft(1, own)")).withColumn("it", F.expr("shiftleft(1, own)"))

    def more(value: str) -> Column:
        return F.expr(f"get(v_{value}, now) - get(v_{value}, before)")

    return now.select(
        "part", "filter_order", "step", F.expr("total - get(v_n, now)").alias("kept"), more("n").alias("removed"),
        (F.expr("get(v_n, it)") - more("n")).alias("redundant"), F.expr("get(alone, own)").alias("unique_fails"),
        more("good").alias("good_lost"), more("toxic").alias("toxic_lost"), F.expr("get(shapley, own)").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Walks through every order one filter at a time; the Shapley values are plain sums over all orders.
OP13_SQL = r"""
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
     'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS f
  FROM w LEFT JOIN marks USING (doc_id)
),
kinds AS (
  SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
    || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM d GROUP BY ALL
),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
named AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM steps),
rows AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN translate(fails, earlier || own, '') = fails THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN translate(fails, earlier, '') = fails AND contains(fails, own) THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN translate(fails, earlier, '') <> fails AND contains(fails, own) THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN translate(fails, earlier, '') = fails AND contains(fails, own) THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN translate(fails, earlier, '') = fails AND contains(fails, own) THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM kinds, named GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM rows
"""
