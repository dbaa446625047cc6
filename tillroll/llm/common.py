"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir, ship_package

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Write the rows to the cluster's checkpoint folder and read them back.

    Later jobs read the files; a lost executor costs a reread, not a recompute.
    ``tasks``: the most files, for tables that are small for their number of shuffle partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df.coalesce(tasks) if tasks else df).checkpoint(eager=True)


def fold(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n (null ids: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


#: values of ``draw``
DRAWS = 1 << 62


def draw(*values):
    """62 bits of the values' hash: rows below ``share_of_draws(wanted, n)`` are about ``wanted`` of n different ones.

    Rows with the same values are drawn together, and a null does not change the hash: give
    what tells rows apart (an id that may be null with the text), and bound repeated rows.
    """
    return F.pmod(F.xxhash64(*values), F.lit(DRAWS))


def share_of_draws(wanted: int, n: int) -> int:
    """The share wanted / n (at most 1) of all draws, in whole numbers: not rounded to 0 at any input size."""
    return DRAWS if n <= wanted else DRAWS * wanted // n


def task_partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
