import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for the Python workers
sys.path.insert(0, ROOT)

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(PROSE[(seed * 7 + i * i + seed * i) % 20] + ("." if i % 9 == 8 else "") for i in range(n))


TRICKY = [
    (1, prose(1, 120), "en", "a", 5), (2, prose(1, 120), "en", "a", 5), (3, prose(3, 130), "de", "a", 5),
    (4, None, "en", "b", None), (5, "", None, "b", 0), (6, " \t\n ", "en", None, 4), (7, "é", "fr", "", 1),
    (None, prose(9, 90), "en", "a", 1), (8, "Word " * 4000, "en", "c", 20000), (9, prose(9, 90), None, None, 1),
    (3, prose(3, 130), "de", "a", 5), (3, prose(3, 130), "de", "a", 5), (10, "x" * 70000, "de", "c", 70000),
    (11, "a <|endoftext|> b 日本語 😀\r\nline\nline\n", "xx", "😀", 9), (12, "||| %%% ### $$$", "en", "￿", 3),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls everywhere, empty and long texts, copies, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(TRICKY, DOCUMENTS)
    return docs.select("*", F.lit(1).alias("TEXT"), F.lit("s").alias("size"), F.lit(2).alias("rank"), F.lit(3).alias("block"), F.lit(None).cast("string").alias("word"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, None), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")


def table(name: str, folder: str):
    import duckdb
    return duckdb.sql(f"SELECT * FROM '{folder}/{name}.parquet'").fetchall()
