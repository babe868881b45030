"""What was exploded from a row is put together again where it stands: parts of one document follow each other, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .dense import _by_length, cosine_of_rows


def gathered(rows: DataFrame, key: str, gather: list[str], *, keep: list[str] | None = None, vector: str | None = None) -> DataFrame:
    """One row for each run of rows of one ``key``.

    It has the key, the first row's ``keep``, and for each of ``gather`` its
    values as an array; arrays are joined. With ``vector`` it has ``sims`` too:
    the cosine of each row's vector with the next one's, null at the end. Rows
    must come from the explosion of rows with keys of their own, without a
    shuffle in between.
    """
    first = [key, *(keep or [])]
    rows = rows.select(*first, *gather, *([vector] if vector else []))
    listed = lambda f: f.dataType if isinstance(f.dataType, T.ArrayType) else T.ArrayType(f.dataType)
    schema = T.StructType([rows.schema[c] for c in first] + [T.StructField(c, listed(rows.schema[c])) for c in gather] + ([T.StructField("sims", T.ArrayType(T.DoubleType()))] if vector else []))

    def put_together(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        starts = _starts(table.column(key))
        bounds = np.append(starts, table.num_rows)
        column = lambda c: table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0)
        out = [column(c).take(pa.array(starts)) for c in first]
        for c in gather:
            values, at = column(c), bounds
            if pa.types.is_list(values.type):
                size = np.asarray(values.value_lengths().fill_null(0), np.int64)
                values, at = values.flatten(), np.append(0, np.cumsum(size))[bounds]
            out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values))
        if vector:
            sims, known = cosine_of_rows(_by_length(column(vector)), table.num_rows)
            known[bounds[1:] - 1] = False
            out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sims, mask=~known)))
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last run of a batch may go on in the next one.
            last = int(_starts(pa.chunked_array([batch.column(key)]))[-1])
            if held and not (last == 0 and batch.column(key)[0] == held[-1].column(key)[0]):
                cut = last if last else 0
                yield put_together([*held, *([batch.slice(0, cut)] if cut else [])])
                held = []
            elif not held and last:
                yield put_together([batch.slice(0, last)])
            held.append(batch.slice(last) if last else batch)
        if held:
            yield put_together(held)

    return rows.mapInArrow(task, schema)


def _starts(key: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal keys begin; nulls are equal."""
    code = key.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))
