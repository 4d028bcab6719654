"""Interleaving of sources to target weights by Pfair scheduling, with Spark expressions only.

Documents of a source are shuffled by a keyed digest and cut into blocks of `block` rows. Integer weights w
with sum P make a period of P slots in which a source gets w slots. Its j-th block of the period is released at
floor(j*P/w) and due at ceil((j+1)*P/w); every slot goes to the released block with the earliest deadline (ties:
the source's name). Weights sum to one processor, so all deadlines are met: after any slot, while sources last,
a source has had its share to within less than one block. The period repeats, so only P slots are ever worked
out (P <= `period` + number of sources), and every block finds its slot by an equal join.

No document is dropped or repeated: where a source has run out, its slots stay empty and the others go on.
A null source counts as the source ''. Repeated rows are rows of their own. Columns of any name pass through;
the added ones replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagegate.llm.tables import table
from pagegate.operators.prefix import rank_within

BLOCK, PERIOD, SEED = 16, 1000, "mix-1"


def root_weights(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """source, weight: shares of a period in proportion to the square root of a source's rows, 1 at least.
    Whole numbers only, so every engine finds the same."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    roots = counts.select("source", F.floor(F.sqrt("n") * 1000).alias("root"))
    total = roots.agg(F.sum("root").alias("total"))
    # one row beside one row for each source
    return roots.join(F.broadcast(total)).select("source", F.greatest(F.expr(f"(root * {period}) div total"), F.lit(1).cast("long")).alias("weight"))


def period_slots(weights: DataFrame) -> DataFrame:
    """source, turn (0 .. weight - 1), slot (0 .. period - 1), weight, period: one period by earliest deadline first."""
    row = weights.filter("weight > 0").agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("s"), F.sum("weight").alias("period"))
    row = row.filter("period is not null")

    def slot(acc: Column, t: Column) -> Column:
        s, period = F.col("s"), F.col("period")
        due = F.filter(
            F.transform(
                acc["turn"],
                lambda j, i: F.struct(
                    F.ceil(((j + 1) * period) / F.get(s, i)["weight"]).alias("deadline"), i.alias("i"),
                    ((j < F.get(s, i)["weight"]) & (F.floor((j * period) / F.get(s, i)["weight"]) <= t)).alias("ready"),
                ),
            ),
            lambda x: x["ready"],
        )
        best = F.array_min(due)["i"]
        return F.struct(
            F.transform(acc["turn"], lambda j, i: F.when(i == best, j + 1).otherwise(j)).alias("turn"), F.concat(acc["out"], F.array(best)).alias("out")
        )

    zero = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("turn"), F.expr("cast(array() as array<int>)").alias("out"))
    order = row.select("s", "period", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), zero, slot, lambda a: a["out"]).alias("out"))
    slots = order.select("period", "s", F.posexplode("out").alias("slot", "i")).select(
        F.get("s", F.col("i"))["source"].alias("source"), F.get("s", F.col("i"))["weight"].alias("weight"), "period", F.col("slot").cast("long").alias("slot")
    )
    turn = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return slots.withColumn("turn", turn.cast("long"))


def interleave(docs: DataFrame, weights: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """All rows with mix_block (of the source), mix_slot, and mix_position, which orders the mixture."""
    added = ("mix_block", "mix_slot", "mix_position")
    kept = docs.drop(*added)
    rows = kept.select(
        F.coalesce("source", F.lit("")).alias("src"), F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id")).cast("binary")).alias("draw"),
        F.col("doc_id").alias("id"), F.struct("*").alias("row"),
    )
    ranked = rank_within(rows, ["src"], ["draw", "id"], "place").withColumn("nth", F.floor((F.col("place") - 1) / block))
    plan = period_slots(weights).withColumnRenamed("source", "src")
    sizes = plan.groupBy("src", "weight", "period").agg(F.count("*").alias("n")).drop("n")
    numbered = ranked.join(sizes, "src").withColumn("turn", F.expr("nth % weight"))
    placed = numbered.join(plan.select("src", "turn", "slot"), ["src", "turn"])
    at = F.expr("(nth div weight) * period + slot")
    return placed.select(
        "row.*", F.col("nth").alias("mix_block"), at.alias("mix_slot"), (at * block + F.expr(f"(place - 1) % {block}")).alias("mix_position")
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return interleave(docs, root_weights(docs))


OP5_SQL = f"""
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
roots AS (SELECT source, CAST(floor(sqrt(n) * 1000) AS BIGINT) AS root FROM counts),
weights AS (SELECT source, greatest((root * {PERIOD}) // (SELECT sum(root)::BIGINT FROM roots), 1) AS weight FROM roots),
w AS (SELECT list(source ORDER BY source) AS names, list(weight ORDER BY source) AS ws, sum(weight)::BIGINT AS p FROM weights),
steps AS (
  SELECT 0::BIGINT AS t, list_transform(ws, lambda x: 0::BIGINT) AS j, NULL::BIGINT AS pick FROM w
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: j[i] + CASE WHEN i = best THEN 1 ELSE 0 END), best
  FROM (
    SELECT t, j, ws, list_min(list_transform(
      list_filter(range(1, len(ws) + 1), lambda i: j[i] < ws[i] AND (j[i] * p) // ws[i] <= t),
      lambda i: ((j[i] + 1) * p + ws[i] - 1) // ws[i] * 100000 + i)) % 100000 AS best
    FROM steps, w WHERE t < p)
),
slots AS (SELECT names[pick] AS src, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM steps, w WHERE pick IS NOT NULL),
ranked AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS place FROM documents
)
SELECT r.doc_id, r.source, r.place // {BLOCK} AS mix_block,
  (r.place // {BLOCK}) // g.weight * w.p + s.slot AS mix_slot,
  ((r.place // {BLOCK}) // g.weight * w.p + s.slot) * {BLOCK} + r.place % {BLOCK} AS mix_position
FROM ranked r JOIN weights g ON g.source = r.src CROSS JOIN w
JOIN slots s ON s.src = r.src AND s.turn = (r.place // {BLOCK}) % g.weight
"""
