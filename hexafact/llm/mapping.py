"""Adding computed columns to a table, slice by slice."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hexafact.llm.text import SLICE_BYTES, each_slice

#: rows, bytes, offsets -> the new columns, each as long as rows
SliceFunction = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict]


def free(taken: Sequence[str], name: str) -> str:
    """``name``, or it with underscores after it, so that no column in ``taken`` is called so."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def add_columns(df: DataFrame, fn: SliceFunction, new: Sequence[T.StructField], text: str = "text", keep: Sequence[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """``df``'s columns (or those in ``keep``) and the new ones; a column of ``df`` with a new one's name is replaced."""
    taken = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in taken]
    needed = list(dict.fromkeys([*(f.name for f in kept), text]))
    schema = T.StructType([*kept, *new])
    names = [f.name for f in kept]
    kinds = [to_arrow_type(f.dataType) for f in new]
    labels = [f.name for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches, text, limit):
            found = fn(rows, data, offs)
            columns = [rows.column(rows.schema.get_field_index(n)) for n in names]
            made = [found[k] if isinstance(found[k], pa.Array) else pa.array(found[k], kind) for k, kind in zip(labels, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, *labels])

    return df.select(*(f"`{n}`" for n in needed)).mapInArrow(run, schema)
