"""Token ids in binary blocks with one shared zstandard dictionary, written in ascending doc_id order.

Layout of a block (little-endian), kept in the binary column ``block`` of a Parquet data set, so that any store that Spark
reads will do:

    4 bytes   b"TKB1"
    1 byte    bytes of an id (2 if the vocabulary has at most 65,536 entries, else 4)
    3 bytes   zero
    16 bytes  BLAKE2b hash of the dictionary (zeros: none)
    4 bytes   number n of documents
    n * 12    for each document: 8 bytes offset of its frame from the end of the index, 4 bytes number of ids
    rest      one zstandard frame for each document, compressed with the dictionary

Beside the block stand the doc_ids, the range of them and the ids written before it in its part, so reading one short
document touches the blocks of its range, slices one frame and decompresses that alone. The dictionary is trained on a
bounded sample of documents; it changes the size of the files, never what is read back.

Nulls count as empty texts; rows with a null doc_id come first; repeated rows are all kept. Rows are dealt out by ranges of
doc_id and then of a hash of the text, so many rows with one doc_id (or none) are split unless their texts are equal too;
rows with one doc_id stand in the order of that hash. An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacancia.llm import storage, tokens

MAGIC, HEAD = b"TKB1", "<4sB3x16sI"
INDEX = np.dtype([("at", "<u8"), ("n", "<u4")])
#: A block is closed at so many documents or bytes of frames.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: The dictionary: its size, and the sample it is trained on (documents, the smallest hashes first; of a longer text, a passage
#: of so many characters at a hashed place).
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 64 << 10, 1500, 8000
LEVEL = 3

_BLOCKS = "part int, block_no int, first_doc bigint, last_doc bigint, n_docs int, n_tokens bigint, tokens_before bigint, doc_ids array<bigint>, block binary"
_READ = "part int, doc_id bigint, start_in_part bigint, ids binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode every whole text, append ``end_id``, and write the blocks and the dictionary below ``path``."""
    tokenizer = tokenizer or tokens.default_tokenizer()
    spark = docs.sparkSession
    storage.ship(spark)
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    spark.createDataFrame([(_hash(dictionary), dictionary)], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(storage.shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(_packer(dictionary, tokenizer, end_id), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """Trained from id arrays of a bounded sample; empty if the corpus is too small for one."""
    sample = storage.hashed_sample(docs, "doc_id", SAMPLE_DOCS).where(F.length("text") > 0)
    at = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int")
    sample = sample.select(F.substring("text", at + 1, F.lit(SAMPLE_CHARS)).alias("text"))

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            ids, counts = encoder.encode(batch.column(0))
            parts = [np.append(x, encoder.dtype.type(end_id)).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["ids"])

    samples = [r["ids"] for r in sample.select("text").mapInArrow(serialized, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 100 else b""
    except zstandard.ZstdError:  # too few or too uniform samples
        return b""


def _hash(dictionary: bytes) -> bytes:
    return hashlib.blake2b(dictionary, digest_size=16).digest() if dictionary else bytes(16)


def _packer(dictionary: bytes, tokenizer: str, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
        state = {"no": 0, "before": 0}
        doc_ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            index = np.zeros(len(frames), INDEX)
            index["n"] = counts
            index["at"] = np.concatenate([[0], np.cumsum([len(f) for f in frames])[:-1]])
            block = struct.pack(HEAD, MAGIC, encoder.dtype.itemsize, _hash(dictionary), len(frames)) + index.tobytes() + b"".join(frames)
            known = [d for d in doc_ids if d is not None]
            row = (part, state["no"], min(known, default=None), max(known, default=None), len(frames), sum(counts), state["before"], list(doc_ids), block)
            state["no"] += 1
            state["before"] += sum(counts)
            doc_ids.clear(), counts.clear(), frames.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in batches:
            ids, n = encoder.encode(batch.column(1))
            begin = 0
            for doc_id, k in zip(batch.column(0).to_pylist(), n.tolist(), strict=True):
                frame = press.compress(np.append(ids[begin : begin + k], encoder.dtype.type(end_id)).tobytes())
                begin += k
                doc_ids.append(doc_id), counts.append(k + 1), frames.append(frame)
                size += len(frame)
                if len(frames) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield close()
                    size = 0
        if frames:
            yield close()

    return pack


def frames_of(block: bytes, dictionaries: dict[bytes, bytes], which: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(position, ids) of the block's documents, or of those at the given positions."""
    magic, width, digest, n = struct.unpack_from(HEAD, block)
    if magic != MAGIC or digest not in dictionaries:
        raise ValueError("not a token block, or its dictionary is missing")
    index = np.frombuffer(block, INDEX, n, struct.calcsize(HEAD))
    base, at = struct.calcsize(HEAD) + n * INDEX.itemsize, index["at"].tolist()
    at.append(len(block) - base)
    raw = dictionaries[digest]
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    for i in range(n) if which is None else which:
        data = unpress.decompress(block[base + at[i] : base + at[i + 1]])
        yield i, np.frombuffer(data, "<u2" if width == 2 else "<u4")


def _dictionaries(spark: SparkSession, path: str) -> dict[bytes, bytes]:
    return {bytes(r["hash"]): bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}  # one row for each write


def _decode(spark: SparkSession, path: str, wanted: list[int] | None):
    storage.ship(spark)
    known = _dictionaries(spark, path)
    keep = None if wanted is None else frozenset(wanted)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, doc_ids, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                which = None if keep is None else [i for i, d in enumerate(doc_ids) if d in keep]
                counts = np.frombuffer(block, INDEX, len(doc_ids), struct.calcsize(HEAD))["n"].astype(np.int64)
                starts = before + np.cumsum(counts) - counts
                rows = [(part, doc_ids[i], int(starts[i]), ids.astype("<u4").tobytes()) for i, ids in frames_of(block, known, which)]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "doc_id", "start_in_part", "ids"])

    return decode


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32 bit)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each written part
    offsets = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = blocks.select("part", "tokens_before", "doc_ids", "block").mapInArrow(_decode(spark, path, None), _READ)
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), _count().alias("n_tokens"), "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens, ids of a few documents: only blocks whose range holds one are read, only their frames decompressed."""
    blocks = spark.read.parquet(f"{path}/blocks")
    near = F.lit(False)
    for d in doc_ids:
        near = near | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
    rows = blocks.where(near).select("part", "tokens_before", "doc_ids", "block").mapInArrow(_decode(spark, path, list(doc_ids)), _READ)
    return rows.select("doc_id", _count().alias("n_tokens"), "ids")


def _count() -> Column:
    return (F.length("ids") / 4).cast("long")
