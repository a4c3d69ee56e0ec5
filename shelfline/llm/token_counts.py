"""Token counts of documents: lengths only, by an Arrow function over batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.encoding import counted, filled


def count_tokens(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of every row, in one pass without a shuffle.

    Only lengths come back from the workers. A null text counts as empty; an empty table gives an empty
    result; repeated rows and null ids are counted one by one; other columns are not read. Texts of any
    length are counted whole, in parts cut where the vocabulary allows it.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            n = counted(vocabulary, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(lengths, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
