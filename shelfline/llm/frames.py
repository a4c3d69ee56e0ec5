"""Arrow functions that add columns to a table in the task that reads it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PART_BYTES = 4 << 20


def sheltered(df: DataFrame, work: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """`work` over `df` with its columns under names that no operator uses, and the own names again on the result.

    `work` gets the renamed table and the new name of each column. It may add columns, which go.
    """
    own = [f"own{i}" for i in range(len(df.columns))]
    done = work(df.toDF(*own), dict(zip(df.columns, own, strict=True)))
    return done.select(*own).toDF(*df.columns)


def add_columns(
    df: DataFrame, kernel: Callable[[pa.RecordBatch], list[pa.Array]], fields: str, without: tuple[str, ...] = ()
) -> DataFrame:
    """`df` with the columns of `fields`, made batch by batch by `kernel`. Nothing is shuffled or reordered.

    The new names must not be in `df`; its own columns pass through, whatever they are called, but for those of
    `without`. A batch of long rows is worked on and handed on in parts of about `PART_BYTES`.
    """
    extra = T.StructType.fromDDL(fields)
    names = extra.fieldNames()
    if set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(set(names) & set(df.columns))} exist")
    kept = [i for i, c in enumerate(df.columns) if c not in without]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, int(whole.num_rows * PART_BYTES / max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in kept), *kernel(batch)], [*(batch.schema.names[i] for i in kept), *names]
                )

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in kept), *extra.fields]))
