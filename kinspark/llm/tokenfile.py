"""Token-id files: frequency-ranked ids in byte-aligned code with separate control bytes.

Ids are replaced by their rank in the corpus (the most frequent is 0) and
written in one to four bytes; two bits an id, four ids a control byte, say how
many. A block holds whole documents::

    b"KTF1", uint32 documents, uint64 ids,
    int64 doc_id each, uint8 1 where doc_id is null, uint32 ids each,
    control bytes, data bytes                      (all little-endian)

Blocks stand in ascending order of doc_id (file, then block), stored by Spark's
own writer so that any file system it knows will do. Reading looks control
bytes up in a table of lengths and offsets.

Defined results: null text is empty (the end id alone); null doc_ids come first;
repeated rows are written as often as they occur; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import END_ID, texts_of
from .pretokens import library_encoder
from .scratch import partitions, settled, ship

MAGIC = b"KTF1"
#: Ids of a file; with fewer ids than make a file for every shuffle partition, files are smaller.
FILE_IDS, LEAST_IDS = 32_000_000, 1_000_000
BLOCK_IDS = 1_000_000


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens and the compressed ids (uint16 where the vocabulary allows, else uint32)."""
    width = id_type(tokenizer)

    def run(batches):
        encoder, squeeze = library_encoder(tokenizer, added=True), zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            counts, blobs = [], []
            for ids, edge in encoder.encode(texts_of(batch)):
                raw = ids.astype(width)
                counts += (np.diff(edge) + 1).tolist()
                blobs += [squeeze(raw[a:b].tobytes() + end) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "ids"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def unpacked(blob: bytes, width: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), width)


def id_type(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def frequency_order(tokens: DataFrame, width: str) -> np.ndarray:
    """Ids by falling frequency over all documents; as long as the ids in use."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                n = np.bincount(unpacked(blob, width))
                if len(n) > len(total):
                    n, total = total, n
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(found, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_codes(values: np.ndarray) -> bytes:
    """Control bytes, then data bytes."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes() + data.tobytes()


#: Sizes of the four values that a control byte describes.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def read_codes(raw: np.ndarray, n: int) -> np.ndarray:
    """The n values that write_codes wrote."""
    groups = -(-n // 4)
    size = SIZES[raw[:groups]].reshape(-1)[:n]
    data = np.concatenate([raw[groups:], np.zeros(4, np.uint8)])
    at = np.cumsum(size, dtype=np.int64) - size
    value = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        value[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return value


def write_block(doc_ids: list, ids: list[np.ndarray], rank: np.ndarray) -> bytes:
    n = np.array([len(x) for x in ids], "<u4")
    known = np.array([d or 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + np.array([len(n)], "<u4").tobytes() + np.array([n.sum()], "<u8").tobytes()
    return head + known.tobytes() + null.tobytes() + n.tobytes() + write_codes(rank[np.concatenate(ids)])


def read_block(blob: bytes, order: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids of each, all ids joined."""
    if blob[:4] != MAGIC:
        raise ValueError("this isn't a block of token ids")
    docs = int(np.frombuffer(blob, "<u4", 1, 4)[0])
    total = int(np.frombuffer(blob, "<u8", 1, 8)[0])
    known = np.frombuffer(blob, "<i8", docs, 16).tolist()
    null = np.frombuffer(blob, np.uint8, docs, 16 + 8 * docs)
    n = np.frombuffer(blob, "<u4", docs, 16 + 9 * docs).astype(np.int64)
    ids = order[read_codes(np.frombuffer(blob, np.uint8, -1, 16 + 13 * docs), total)]
    return [None if x else d for d, x in zip(known, null, strict=True)], n, ids


def write_files(tokens: DataFrame, order: np.ndarray, width: str, files: int) -> DataFrame:
    """Blocks (file, block, n_ids, payload); files are ranges of doc_id in ascending order."""
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches):
        file, block, doc_ids, ids, size = 0, 0, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([write_block(doc_ids, ids, rank)], pa.binary())],
                ["file", "block", "n_ids", "payload"],
            )

        for batch in batches:
            for f, d, blob in zip(*(batch.column(c).to_pylist() for c in ("file", "doc_id", "ids")), strict=True):
                file = f
                doc_ids.append(d)
                ids.append(unpacked(blob, width))
                size += len(ids[-1])
                if size >= BLOCK_IDS:
                    yield flush()
                    block, doc_ids, ids, size = block + 1, [], [], 0
        if ids:
            yield flush()

    order_by = ["doc_id", "draw"]  # so that rows without doc_id are spread too
    ranged = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("draw")).repartitionByRange(files, *order_by).sortWithinPartitions(*order_by)
    return ranged.withColumn("file", F.spark_partition_id()).mapInArrow(run, "file int, block int, n_ids long, payload binary")


def read_files(blocks: DataFrame, order: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks alone."""
    spark = blocks.sparkSession
    totals = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()  # a row for every FILE_IDS ids
    base, rows = 0, []
    for r in totals:
        rows.append((r["file"], base))
        base += r["n"]
    bases = F.broadcast(spark.createDataFrame(rows, "file int, base long"))
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before")).join(bases, "file")
    offsets = offsets.select("file", "block", (F.col("base") + F.col("before")).alias("base"))

    def run(batches):
        for batch in batches:
            for file, block, blob in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "payload")), strict=True):
                doc_ids, n, ids = read_block(blob, order)
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), file, np.int32)), pa.array(np.full(len(n), block, np.int32)), pa.array(doc_ids, pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    ["file", "block", "doc_id", "own", "n_tokens", "ids_crc32"],
                )

    read = blocks.select("file", "block", "payload").mapInArrow(run, "file int, block int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return read.join(offsets, ["file", "block"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Tokenise, write the files, and say what they hold."""
    width = id_type(tokenizer)
    tokens = settled(tokenised(docs, tokenizer, end_id), "tokens")
    order = frequency_order(tokens, width)
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, -(-total // FILE_IDS), min(partitions(docs.sparkSession), total // LEAST_IDS))
    return read_files(settled(write_files(tokens, order, width, files), "token-file"), order)
