"""How the reference queries read the tables, and fragments of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.functions.expressions import REFUSE


#: How RE2 finds the word "the" as a token of its own.
THE = r"(?:^|[^\pL\pN\pM_.+-])the(?:$|[^\pL\pN\pM_.]|\.(?:$|[^\pN]))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_sql(x: str) -> str:
    return f"(('0x' || substr(sha256({x}), 1, 8))::BIGINT % 10)"


def split_sql(x: str) -> str:
    b = bucket_sql(x)
    return f"(CASE WHEN {b} < 2 THEN 'test' WHEN {b} = 2 THEN 'val' ELSE 'train' END)"


def refuses_sql(x: str) -> str:
    """The keyword rule for RE2, which knows ASCII word borders only: the characters at the borders
    are consumed instead."""
    first, last = REFUSE.split(r"\b.{0,40}\b")
    no_word = r"[^\pL\pN\pM_\n]"
    pattern = f"{first}{no_word}(?:.{{0,38}}{no_word})?{last}".replace("'", "''")
    return f"regexp_matches({x}, '{pattern}', 'i')"
