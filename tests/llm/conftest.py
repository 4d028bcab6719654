import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHING = ("id", "key", "node", "part", "hash", "size", "row", "src", "slot", "place", "words", "sig", "comp", "n", "b", "hits", "features")
LONG = " ".join(f"word{k % 977} filler{k % 313}" for k in range(30_000))
EDGE = (
    (1, "One line that repeats itself in other rows, as it must. " * 6), (2, None), (3, ""), (4, "One line that repeats itself in other rows, as it must. " * 6),
    (4, "One line that repeats itself in other rows, as it must. " * 6), (None, "A row without an id has a text of its own."), (6, LONG), (7, "   \t\n "),
    (8, "Überraschung! naïve café 北京 🎉 mail a.b@c.example.org or +1 (988) 555-2485"), (9, "short"),
)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def widened(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING) if c not in df.columns])


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    df = spark.createDataFrame([(*r, "en", None if r[0] == 3 else "s1", None if r[1] is None else len(r[1])) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    return widened(df)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def edge_dir(spark, edge, tmp_path_factory):
    """The edge rows as tables of a folder, with small tables beside them."""
    d = str(tmp_path_factory.mktemp("spark-edge"))
    edge.write.parquet(f"{d}/documents.parquet")
    widened(spark.createDataFrame([(1, 0, 1), (4, None, 1), (6, 1, 0), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")).write.parquet(f"{d}/labels.parquet")
    items = [(1, "a b c d e f g h i j k l m n o p"), (2, None), (3, ""), (4, "One line that repeats itself in other rows, as it must. One line that repeats"), (5, "short")]
    widened(spark.createDataFrame(items, "item_id long, text string")).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("spark-empty"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
