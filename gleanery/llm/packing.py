"""Packing by power-of-two decomposition.

A document of n tokens is cut into floor(n / max_len) pieces of ``max_len`` and one piece for each binary digit of the rest, so
every piece has a power of two as its length, is a sequence of its own and needs no padding. Pieces of equal length form a bucket;
within a bucket, sequences are numbered in blocks, so that no task ever holds a whole bucket.

A null text is empty; every document, even an empty one, ends with the end id. Repeated rows are documents of their own. A null
doc_id is kept as null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import common, tokens

MAX_LEN = 1024
END_ID = 0
#: Blocks of the numbering of a bucket.
BLOCKS = 4096
#: Of a sparing task: words that it keeps in mind, and characters of the texts that it encodes together.
SPARING_WORDS, SPARING_CHARS = 200_000, 250_000


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Descending powers of two that add up to ``n``."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, *, max_len: int = MAX_LEN, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = True, sparing: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for: a row for each piece of each document.

    A ``sparing`` task keeps fewer words in mind, and none for what its worker does next: less memory for more time, and the same pieces.
    """
    path = tokenizer_path or tokens.tokenizer_path()
    piece_lengths(0, max_len)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.tokenizer(path, SPARING_WORDS) if sparing else tokens.tokenizer(path)
        for part, texts in common.slices(batches, "text", SPARING_CHARS if sparing else tokens.SLICE_CHARS):
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, ids in zip(part.column(0).to_pylist(), known.encode(texts)):
                ids = np.append(ids, np.int32(end_id)).astype("<i4")
                start = 0
                for length in piece_lengths(len(ids), max_len):
                    own = ids[start : start + length]
                    row = (doc_id, start, length, zlib.crc32(own.tobytes()), len(ids), *([own] if with_ids else []))
                    for column, value in zip(rows, row):
                        column.append(value)
                    start += length
            arrays = [pa.array(c, pa.int64()) for c in rows[:5]]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in rows[5]])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *rows[5]])))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])
        if sparing:
            known.clear()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, *, max_len: int = MAX_LEN, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = True, sparing: bool = False) -> DataFrame:
    """Pieces with their bucket (the length's logarithm), sequence_id and offset (always 0: a piece is a whole sequence).

    A sequence_id holds its bucket, its block and its place there, so it is unique without counting the whole table. Blocks come
    from a hash of the piece, which spreads even the pieces of one document or one repeated text.
    """
    buckets = max_len.bit_length()
    cut = pieces(docs, max_len=max_len, end_id=end_id, tokenizer_path=tokenizer_path, with_ids=with_ids, sparing=sparing)
    cut = cut.withColumn("bucket", F.log2("length").cast("int")).withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BLOCKS)))
    place = F.row_number().over(Window.partitionBy("bucket", "_block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    number = (place.cast("long") * BLOCKS + F.col("_block")) * buckets + F.col("bucket")
    return cut.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long")).drop("_block")


def op1_pack_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), with_ids=False)
