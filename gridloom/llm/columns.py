"""Names for an operator's own columns beside those of the user's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Each wanted name, with a number behind it if ``taken`` has it (Spark compares names without regard to case)."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        k, own = 1, name
        while own.lower() in used:
            k += 1
            own = f"{name}_{k}"
        used.add(own.lower())
        out.append(own)
    return out


def own(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_place(df: DataFrame, run) -> DataFrame:
    """``df.mapInArrow`` with the schema of ``df``; columns go by number meanwhile, as ``mapInArrow`` cannot take names with dots."""
    text_batches(df.sparkSession)
    numbered = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*df.columns)


#: Bytes of an Arrow batch where texts go to Python: rows are large, and a batch is held several times on its way.
BATCH = "8m"


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches for this session, unless it has set their size itself.

    The size is read when a query runs, which is after its operator has returned, so it cannot be set for one query.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, BATCH)
