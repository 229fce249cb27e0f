"""Token ids in files of directly addressable codes.

An id is cut into chunks of ``CHUNKS`` bits, low ones first. Level k holds chunk k of all
ids that have one, a bitmap tells which of them go on in level k + 1, and a directory
counts the set bits before every ``BLOCK`` bits, so any id is found with one
rank per level and nothing else is decoded. A file covers a run of documents in
ascending doc_id; files are rows (number, documents, tokens, body) of a Parquet table in
ascending number.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.llm import exchange as ex
from quillforge.llm.stages import shared_folder
from quillforge.llm.tokenize import encoder, vocabulary

MAGIC = b"QFDAC\x01\x00\x00"
CHUNKS = (8, 8, 16)
BLOCK = 512
END = 2
FILE_BYTES = 4_000_000
BROADCAST_FILES = 100_000
_HEAD = struct.Struct("<8sQQ")
_LEVEL = struct.Struct("<QQ")
_SET = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of whole documents: their ids, their token counts, and the levels of the token ids."""
    out = [_HEAD.pack(MAGIC, len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes()]
    rest = ids.astype(np.uint32)
    for k, bits in enumerate(CHUNKS):
        kind = "<u1" if bits == 8 else "<u2"
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(kind)
        more = (rest >> np.uint32(bits)) > 0 if k < len(CHUNKS) - 1 else np.zeros(0, bool)
        bitmap = np.packbits(more)
        bitmap = np.append(bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8))
        ones = np.append(0, np.cumsum(_SET[bitmap].reshape(-1, BLOCK // 8).sum(1, dtype=np.int64))) if len(bitmap) else np.zeros(1, np.int64)
        out += [_LEVEL.pack(len(rest), len(bitmap)), chunk.tobytes(), bitmap.tobytes(), ones.astype("<u4").tobytes()]
        if k < len(CHUNKS) - 1:
            rest = rest[more] >> np.uint32(bits)
    return b"".join(out)


@dataclass
class TokenFile:
    """A parsed file; ``get`` finds one id, ``all`` decodes everything."""

    doc_ids: np.ndarray
    counts: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def parse(cls, body: bytes) -> TokenFile:
        magic, docs, tokens = _HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        doc_ids, counts = np.frombuffer(body, "<i8", docs, at), np.frombuffer(body, "<u8", docs, at + 8 * docs)
        at += 16 * docs
        levels = []
        for bits in CHUNKS:
            n, m = _LEVEL.unpack_from(body, at)
            at += _LEVEL.size
            width = bits // 8
            chunk = np.frombuffer(body, f"<u{width}", n, at)
            bitmap = np.frombuffer(body, np.uint8, m, at + n * width)
            blocks = m * 8 // BLOCK + 1
            ones = np.frombuffer(body, "<u4", blocks, at + n * width + m)
            at += n * width + m + 4 * blocks
            levels.append((chunk, bitmap, ones))
        if at != len(body) or len(levels[0][0]) != tokens or int(counts.sum()) != tokens:
            raise ValueError("cut token file")
        return cls(doc_ids, counts, levels)

    def get(self, i: int) -> int:
        value, shift = 0, 0
        for (chunk, bitmap, ones), bits in zip(self.levels, CHUNKS, strict=True):
            value |= int(chunk[i]) << shift
            shift += bits
            if not len(bitmap) or not bitmap[i >> 3] >> (7 - (i & 7)) & 1:
                break
            block = i // BLOCK
            low = block * BLOCK // 8
            i = int(ones[block]) + int(_SET[bitmap[low : i >> 3]].sum()) + int(_SET[bitmap[i >> 3] >> (8 - (i & 7))] if i & 7 else 0)
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for (chunk, bitmap, _), bits in zip(reversed(self.levels), reversed(CHUNKS), strict=True):
            more = np.unpackbits(bitmap, count=len(chunk)).astype(bool) if len(bitmap) else np.zeros(len(chunk), bool)
            here = chunk.astype(np.uint32)
            here[more] |= value << np.uint32(bits)
            value = here
        return value


def write_tokens(docs: DataFrame, path: str, name: str, end: int = END, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text (null: empty), append ``end``, and write files in ascending doc_id under ``path``.

    Rows with equal ids come in the order of a hash of their text, null ids first (stored as
    the smallest 64-bit integer). Extra columns are dropped; an empty table writes no file.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = ex.deal(slim, file_bytes)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        shard = ex.in_order(table)
        got = encoder(vocabulary(name)).encode(["" if t is None else t for t in shard.table.column("text").to_pylist()])
        counts = np.diff(got.offsets) + 1
        ids = np.insert(got.ids, got.offsets[1:], np.uint32(end))
        doc_ids = shard.table.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        return pa.table({"number": [key[0].as_py()], "documents": [len(doc_ids)], "tokens": [len(ids)], "body": pa.array([pack(doc_ids, counts, ids)], pa.binary())})

    dealt.rows.groupBy("__shard").applyInArrow(write, "number long, documents long, tokens long, body binary").write.option("compression", "zstd").parquet(path)


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` and the number of ids in all files before each."""
    files = spark.read.parquet(path)
    totals = files.select("number", "tokens").withColumn("part", F.floor(F.col("number") / 1024))
    parts = totals.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("outer"))
    inner = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    starts = totals.withColumn("inner", inner).join(before, "part").select(F.col("number").alias("file"), (F.col("inner") + F.col("outer")).alias("start"))
    if starts.count() <= BROADCAST_FILES:  # 16 bytes a file; beyond that the bodies are shuffled
        starts = F.broadcast(starts)
    return files.join(starts, F.col("number") == F.col("file"), "inner").drop("file")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                f = TokenFile.parse(body.as_buffer().to_pybytes())
                ids = memoryview(f.all().astype("<u4").tobytes())
                ends = np.cumsum(f.counts.astype(np.int64))
                begins = ends - f.counts.astype(np.int64)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                doc = pa.array(f.doc_ids, mask=f.doc_ids == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([doc, pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return token_files(spark, path).select("body", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write all documents' ids to files in the shared folder and describe them from what is read back."""
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, "word_bpe_49k.json")
    return read_documents(spark, path)
