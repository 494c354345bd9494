"""What the chunk table holds: repositories and their refs.

Both lists come from partition columns, so no data column is read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repositories(chunks: DataFrame) -> DataFrame:
    return chunks.select("repository").distinct().orderBy("repository")


def refs(chunks: DataFrame, repository: str) -> DataFrame:
    return chunks.where(F.col("repository") == repository).select("ref").distinct().orderBy("ref")


def wrong_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector does not fit the table."""
    from gleanery.functions.vectors import has_dim

    return chunks.where(~has_dim(F.col("summary_vec"), dim))
