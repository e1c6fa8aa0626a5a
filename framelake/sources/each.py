"""Small documents, such as scripts, selectors and headers, parsed one by one in the tasks that hold them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import struct


def parsed(texts: DataFrame, parse: Callable[[str], list[tuple]], schema: str, key: str = "source") -> DataFrame:
    """(key, …schema): the rows that `parse` makes of each text of (key, text); a ValueError means that it has none."""
    ddl = f"{key} {dict(texts.dtypes)[key]}, {schema}"
    arrow = to_arrow_schema(struct(ddl))
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [dict(zip(names, (k, *r))) for r in parse(text or "")]
                except ValueError:
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return texts.select(key, "text").mapInArrow(run, ddl)
