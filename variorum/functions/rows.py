"""Rows that a Python reader finds in a text, without a list of them in between."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a batch.
MOST = 20_000


def read(docs: DataFrame, text: str, reader: Callable[[str], Iterable[tuple]], row: T.StructType) -> DataFrame:
    """``doc_id`` and the fields of ``row`` of each tuple that the reader finds; null texts have none. Texts are read one by
    one and rows handed on in batches, so no more of them is held than one text has and one batch."""
    types, names = [to_arrow_type(f.dataType) for f in row.fields], ["doc_id", *row.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []

            def made() -> Iterator[pa.RecordBatch]:
                for a in range(0, len(rows), MOST):
                    columns = zip(*rows[a : a + MOST])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[a : a + MOST], pa.int32())), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=names)

            texts = b.column(1)
            for i in range(b.num_rows):
                s = texts[i].as_py()
                if s is None:
                    continue
                found = list(reader(s))
                rows += found
                at += [i] * len(found)
                if len(rows) >= MOST:
                    yield from made()
                    at, rows = [], []
            yield from made()

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join([f"doc_id {kind}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in row.fields)])
    return docs.select("doc_id", F.col(text)).mapInArrow(run, fields)
