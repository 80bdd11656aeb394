"""Operator 5: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from crease.llm.bpe import ByteBpeCounter
from crease.llm.common import held, map_batches, read_table, texts_of

def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a byte-level BPE .json, present on every worker; one that is cut into words or normalised otherwise, or has
    other added tokens, is refused. A count is the bytes of a text's pre-tokens less the merges
    that a heap over a linked list makes; no ids are emitted. Special strings in a text count as one token each. A null
    text is empty (0 tokens); a null key stays null; repeated rows and repeated keys each give a row; other columns of
    docs are left out. An unbroken run of any length takes O(n log n).
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def start():
        count = held(("counter", path), lambda: ByteBpeCounter(path)).count

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch, text)
            tokens = [count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

        return each

    return map_batches(docs.select(key, text), schema, start)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
