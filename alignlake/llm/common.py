"""Small helpers shared by the operators: batches of texts and the tables they come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text handed to a Python worker at once; long texts make larger batches.
TEXT_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``TEXT_ROWS`` rows; results are computed later, so the setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def map_texts(
    df: DataFrame,
    each: Callable[[list, list], dict[str, list]],
    schema: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``each(keys, texts as bytes or None)`` makes the columns of ``schema`` for one batch."""
    small_batches(df.sparkSession)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [None if t is None else bytes(t) for t in part.column(1).to_pylist()]
            out = each(part.column(0).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
