"""Token counts as the tokenizer library gives them, with overlap resynchronisation for huge documents.

Documents of up to HUGE characters are encoded whole, in batches. A longer one is encoded in overlapping chunks with
character offsets. Two neighbouring chunks are spliced at a token boundary that both have and that is proven stable: no
piece of the vocabulary holds the two characters around it side by side, so no merge can ever cross it and the two sides
encode independently of what lies beyond. Without such a boundary the overlap is doubled, up to the whole document, so
the count is exact in every case. Null counts as empty (0 bytes, 0 tokens). Repeated rows give repeated results;
null ids are carried as null, extra columns do not matter, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bounded_arrow

HUGE, CHUNK, OVERLAP = 16_384, 8_192, 256
SPACE = "▁"


class PieceCounter:
    """Counts pieces of a sentencepiece model, given as its bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        n = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        byte = [self.model.is_byte(i) for i in range(n)]
        self.normal = np.array([not (b or self.model.is_control(i) or self.model.is_unknown(i)) for i, b in enumerate(byte)])
        # Characters that a piece stands for: a fallback byte counts if it begins a character.
        self.chars = np.array([(int(p[3:5], 16) & 0xC0 != 0x80) if b else len(p) for p, b in zip(pieces, byte, strict=True)], np.int64)
        self.inside = {x for p, ok in zip(pieces, self.normal, strict=True) if ok for x in zip(p, p[1:])}

    def _ends(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Where tokens of a chunk begin that begins at `at`, as positions in the document, and how many tokens lie before each."""
        ids = np.array(self.model.encode(text), np.int64)
        n = self.chars[ids]
        begins = np.concatenate([[0], np.cumsum(n)]) - 1  # the library puts one space before the text
        if begins[-1] != len(text):
            return None  # the normaliser has changed the text's length: offsets say nothing
        starts = np.append(n > 0, True)
        return begins[starts] + at, np.flatnonzero(starts)

    def _stable(self, text: str, p: int) -> bool:
        a, b = text[p - 1].replace(" ", SPACE), text[p].replace(" ", SPACE)
        return (a, b) not in self.inside

    def count(self, text: str) -> int:
        if len(text) <= HUGE:
            return len(self.model.encode(text))
        low, high, overlap, grow = 0, CHUNK, OVERLAP, CHUNK
        left, total, base = self._ends(text[:high], 0), 0, 0  # base: tokens of the left chunk that stand before its own cut
        while left is not None and high < len(text):
            at, end = max(low + 1, high - overlap), min(len(text), high + CHUNK)
            right = self._ends(text[at:end], at)
            if right is None:
                break
            common = np.intersect1d(left[0], right[0])
            cut = next((p for p in common[::-1].tolist() if at < p < high and self._stable(text, p)), None)
            if cut is None:
                if overlap >= high - low:  # nothing stable in all of the left chunk: it gets longer
                    high, grow = min(len(text), high + grow), 2 * grow
                    left = self._ends(text[low:high], low)
                overlap *= 2
                continue
            total += int(left[1][np.searchsorted(left[0], cut)]) - base
            base = int(right[1][np.searchsorted(right[0], cut)])
            low, high, left, overlap, grow = at, end, right, OVERLAP, CHUNK
        return len(self.model.encode(text)) if left is None or high < len(text) else total + int(left[1][-1]) - base

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if t and len(t) <= HUGE]
        for i, ids in zip(small, self.model.encode([texts[i] for i in small], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if t and len(t) > HUGE:
                out[i] = self.count(t)
        return out


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. The model file (under 1 MB) is read once, on the driver."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model.value)
        for batch in batches:
            n = pa.array(counter.counts(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
