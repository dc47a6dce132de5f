"""What the operators of this subpackage share: table access, lineage cuts, batch bounds."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.lineage import cut

__all__ = ["ARROW_ROWS", "WORD_PATTERN", "arrow_rows", "cut", "free", "partitions", "table", "whole_text"]

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Words of a text: runs of anything but space and U+0009 to U+000D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts fits a Python worker."""
    spark.conf.set(ARROW_ROWS, str(rows))


def free(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have yet, whatever their case, from these stems."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def whole_text(column: str = "text"):
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
