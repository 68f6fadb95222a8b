"""Parsing streams.

Every step is a stateless expression on one row, so the same plan runs on a streaming DataFrame: bind a contract to
spark.readStream output and write parsed_df with writeStream.  persist() is for batches only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_parsed_stream(df: DataFrame, config: Any, *, key_columns: Sequence[str], sink: str, checkpoint: str, path: str | None = None, options: dict[str, str] | None = None, available_now: bool = False, **parse_options: Any) -> StreamingQuery:
    """Parse a streaming DataFrame into a sink in append mode."""
    from ..service import parser

    parsed = parser.parse_dataframe(df, config, key_columns=key_columns, **parse_options).parsed_df
    writer = parsed.writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint).options(**options or {})
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path) if path else writer.start()
