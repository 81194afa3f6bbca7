"""Token counts: pre-tokens proved to be one token are counted directly, only the rest is merged.

Null texts count as empty, 0 tokens.  Repeated rows each get their row; an empty table gives none.
Whole texts of any length are counted, and other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.pretokens import prove_whole_tokens, worker_pretokens


def _tokens(ids: bytes) -> int:
    return len(ids) // 4


def count_tokens(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``path`` names a file that is on every executor: a tokenizers file (.json) or a sentencepiece
    model (.model), which knows no pre-tokens and is asked for every text.  The proof is made once
    on the driver; what is broadcast holds at most one entry per vocabulary string.
    """
    pieces = path.endswith(".model")
    whole = docs.sparkSession.sparkContext.broadcast({} if pieces else prove_whole_tokens(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pieces:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            numbers = lambda texts: (len(model.encode(t)) if t else 0 for t in texts)
        else:
            encoder = worker_pretokens(path, whole.value, _tokens)
            numbers = lambda texts: map(sum, encoder.values(texts))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(numbers(texts)), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
