"""Hash trees over the rows of groups, and the search for what differs between two of them.

A row has a key; its key's digest says where it hangs. All rows whose digests begin with the same DIGITS hex digits share a
leaf node, whose digest is over their (key, content, count) in order; an inner node is over the nodes whose prefix begins with
its own. Two trees of one group are equal exactly when their roots are, and `differing` follows only the branches whose
digests differ, level by level, so that in the end the rows of few leaf nodes have to be read.

A group of any size is 16**DIGITS leaf nodes at most; none of its nodes gathers more than a 16**DIGITS-th of its rows
or 16 nodes. Repeated rows are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegate.functions.digest import sha256

DIGITS = 3
C = F.col


def field_text(c: Column) -> Column:
    """A value with its length in front, `-` for null, so that no two lists of values read alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest_of(*names: str) -> Column:
    return sha256(F.concat(*[field_text(C(n)) for n in names]))


def hung(rows: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Rows once each with n (how often), k (digest of the key) and d (digest of all but the group, columns by name)."""
    own = sorted(c for c in rows.columns if c not in group)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("k", digest_of(*key)).withColumn("d", digest_of(*own))


def tree(leaves: DataFrame, group: list[str], digits: int = DIGITS) -> DataFrame:
    """group, level (0: the root), prefix, digest, n of every node; `leaves` as from `hung`."""
    line = F.concat_ws(":", "k", "d", C("n").cast("string"))
    at = leaves.groupBy(*group, F.substring("k", 1, digits).alias("prefix")).agg(sha256(F.array_join(F.sort_array(F.collect_list(line)), ",")).alias("digest"), F.sum("n").alias("n"))
    out = at.withColumn("level", F.lit(digits))
    for level in range(digits - 1, -1, -1):
        line = F.concat_ws("=", "prefix", "digest")
        at = at.groupBy(*group, F.substring("prefix", 1, level).alias("up")).agg(sha256(F.array_join(F.sort_array(F.collect_list(line)), ",")).alias("digest"), F.sum("n").alias("n"))
        at = at.withColumnRenamed("up", "prefix")
        out = out.unionByName(at.withColumn("level", F.lit(level)))
    return out.select(*group, "level", "prefix", "digest", "n")


def differing(a: DataFrame, b: DataFrame, group: list[str], digits: int = DIGITS) -> DataFrame:
    """group and prefix of the leaf nodes in which two trees differ. Below equal nodes nothing is looked at."""
    open_: DataFrame | None = None
    for level in range(digits + 1):
        sides = []
        for nodes, name in ((a, "da"), (b, "db")):
            own = nodes.filter(C("level") == level).select(*group, "prefix", C("digest").alias(name))
            if open_ is not None:
                up = open_.withColumnRenamed("prefix", "up")
                own = own.withColumn("up", F.substring("prefix", 1, level - 1)).join(up, [*group, "up"], "left_semi").drop("up")
            sides.append(own)
        open_ = sides[0].join(sides[1], [*group, "prefix"], "full_outer").filter(~C("da").eqNullSafe(C("db"))).select(*group, "prefix")
    return open_


def changes(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """group, k, change (added, lost, changed) of the keys whose rows are not the same in `a` and in `b` (both `hung`)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*group, "k").agg(F.sort_array(F.collect_list(F.concat_ws(":", "d", C("n").cast("string")))).alias(name))

    j = side(a, "of_a").join(side(b, "of_b"), [*group, "k"], "full_outer").filter(~C("of_a").eqNullSafe(C("of_b")))
    change = F.when(C("of_a").isNull(), "added").when(C("of_b").isNull(), "lost").otherwise("changed")
    return j.select(*group, "k", change.alias("change"))
