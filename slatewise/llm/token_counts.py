"""Operator 8: token counts of whole texts, lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.tokenization import BATCH_BYTES, Counts, safe_pieces
from slatewise.session import workers_see

#: Characters after which a long text is cut at the next safe boundary.
PIECE = 1 << 16


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, pattern: str = public_tokenizers.PATTERN, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    The count is that of the byte-level tokenizer file without begin, end or padding; special
    strings inside a text count as the library's default has it, one token. Texts reach Python in
    Arrow batches, long ones are cut at safe boundaries, the pieces are regrouped into batches of equal bytes for the
    library, and only counts go back. A run without such a boundary is counted as a stream. A null or empty text has 0
    tokens; repeated rows and null ids are counted row by row; further columns of `docs` are
    ignored, whatever their names; an empty table gives an empty table.

    No shuffle: the input's own splits are balanced by bytes.
    """
    workers_see(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts.of(path, pattern)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            held, size = [], 0  # (row, piece) of one batch
            for row, text in enumerate(batch.column(1)):
                for piece in safe_pieces(text.as_py() or "", PIECE):
                    held.append((row, piece))
                    size += len(piece.encode()) if len(piece) > 64 else len(piece)
                    if size >= BATCH_BYTES:
                        for r, c in counts.count_batch(held):
                            n[r] += c
                        held, size = [], 0
            for r, c in counts.count_batch(held):
                n[r] += c
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(lengths, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
