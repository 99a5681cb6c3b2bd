"""Line de-duplication with two Bloom filters for once-seen and twice-seen hashes.

1. Every task sends the 64-bit hashes of its line keys, each once and those it has met twice apart, to the slice of the
   filters that they belong to. A slice adds them to its once-seen filter; what was there already goes to its twice-seen
   filter. Slices have a fixed size, so none grows with the corpus; their number follows the number of lines.
2. The twice-seen filter goes to all tasks, which scan the texts again. Only lines whose key it may hold are suspected
   repeats and are shuffled, as 128-bit digests.
3. Suspects are confirmed exactly: documents are counted for each digest, and the largest doc_id that holds it is chosen.
   Counts are pre-aggregated, and a key that a third of all documents hold is dealt out by (key, doc_id) first.
4. The digests of keys to drop come back by doc_id; each row drops its own lines with these keys.

The filter has FILTER_BITS bits for each line but at most MAX_FILTER_BYTES, which bounds what is broadcast. Where a corpus
has more lines than that serves (some 30 million), more lines are suspected and shuffled, in the end all of them at about
30 bytes each; what is kept stays the same, as every suspect is confirmed.

A null or empty text is one empty line. Very long texts are read whole. Rows with a null doc_id are left as they are and hold
no key. Rows that repeat a doc_id count as one document, whose keys are those of all its rows: where a key goes, it goes from
each of them, and whatever else they hold stays. An empty table gives no rows. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm import storage

LEAST_CHARS, LEAST_DOCS = 20, 3
FILTER_BITS, MAX_FILTER_BYTES = 16, 64 << 20
#: Small slices, so that at full size 2048 tasks share the hashes.
SLICE_BITS = 1 << 18
BLANK = b" \t\n\x0b\x0c\r"


def keys_of(text: str | None) -> Iterator[tuple[int, bytes]]:
    """(line number, key) of the lines whose key is long enough."""
    for i, line in enumerate(text.encode().split(b"\n")) if text else ():
        key = line.strip(BLANK).lower()  # lower() of bytes changes A-Z alone
        if len(key) >= LEAST_CHARS and (len(key) >= 4 * LEAST_CHARS or len(key.decode()) >= LEAST_CHARS):
            yield i, key


def digest_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _slice_and_bits(hashes: np.ndarray, slices: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice of a hash and its two bits there, of ``bits`` (a power of two, at most 2 ** 22)."""
    mask = np.uint64(bits - 1)
    return ((hashes >> np.uint64(44)) % np.uint64(slices)).astype(np.int64), (hashes & mask).astype(np.int64), (hashes >> np.uint64(22) & mask).astype(np.int64)


def twice_seen(docs: DataFrame) -> list[tuple[int, bytes]]:
    """The twice-seen filter, slice by slice."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n = docs.agg(F.coalesce(F.sum(lines), F.lit(0))).first()[0]
    size = SLICE_BITS
    slices = int(min(max(1, -(-n * FILTER_BITS // size)), max(1, MAX_FILTER_BYTES * 8 // size)))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((h for t in batch.column(0).to_pylist() for h in {xxhash.xxh3_64_intdigest(k) for _, k in keys_of(t)}), np.uint64)
            once, count = np.unique(got, return_counts=True)
            at, _, _ = _slice_and_bits(once, slices, size)
            order = np.argsort(at, kind="stable")
            once, count, cuts = once[order], count[order], np.searchsorted(at[order], np.arange(slices + 1))
            rows = [(s, once[a:b].tobytes(), once[a:b][count[a:b] > 1].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["slice", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(size, bool), np.zeros(size, bool)
        for batch in batches:
            for once, twice in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                _, a, b = _slice_and_bits(np.frombuffer(once, np.uint64), slices, size)
                met = seen[a] & seen[b]
                again[a[met]] = again[b[met]] = True
                seen[a] = seen[b] = True
                _, a, b = _slice_and_bits(np.frombuffer(twice, np.uint64), slices, size)
                again[a] = again[b] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(again).tobytes()], pa.binary())], names=["slice", "bits"])

    rows = docs.select("text").mapInArrow(hashes, "slice int, once binary, twice binary")
    merged = rows.groupBy("slice").applyInArrow(merge, "slice int, bits binary")
    found = {r["slice"]: bytes(r["bits"]) for r in merged.collect()}  # at most MAX_FILTER_BYTES
    return [found.get(s, bytes(size // 8)) for s in range(slices)]


def repeats(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, drop: the digests of the keys whose lines go."""
    spark = docs.sparkSession
    storage.ship(spark)
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    bits = spark.sparkContext.broadcast(twice_seen(docs))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = bits.value
        size = 8 * len(slices[0])
        joined = np.frombuffer(b"".join(slices), np.uint8)
        for batch in batches:
            docs_, digests = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list({k for _, k in keys_of(text)})
                if not own:
                    continue
                s, a, b = _slice_and_bits(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), len(slices), size)
                a, b = a + s * size, b + s * size
                maybe = (joined[a >> 3] >> (7 - (a & 7)) & joined[b >> 3] >> (7 - (b & 7)) & 1).astype(bool)
                found = [digest_of(key) for key, m in zip(own, maybe.tolist(), strict=True) if m]
                docs_ += [doc_id] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "key"])

    found = storage.written(docs.mapInArrow(suspects, "doc_id bigint, key binary"), "line-suspects")
    confirmed = found.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_docs)
    confirmed = storage.written(confirmed, "line-repeats")  # joined by an exchange of its own, so that a hot key can be split
    gone = found.join(confirmed.select("key", "keeper"), "key").where(F.col("doc_id") < F.col("keeper"))
    return gone.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def dedup(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The given columns, text without the lines that go, and n_lines (before), n_dropped."""
    drop = repeats(docs, least_docs)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    gone_name, whole = storage.free_name(docs, "drop"), docs.select(*columns)
    joined = whole.join(drop.withColumnRenamed("drop", gone_name).hint("merge"), "doc_id", "left").select(*columns, gone_name)
    schema = joined.select(*columns, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    place = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(gone_name).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                keys = set(gone or ())
                at = {i for i, key in keys_of(text) if digest_of(key) in keys} if keys else ()
                n_dropped.append(len(at))
                if at:
                    text = "\n".join(line for i, line in enumerate(lines) if i not in at)
                texts.append(text)
            arrays = [batch.column(c) for c in columns]
            arrays[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, schema)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def digest_sql(least_docs: int = LEAST_DOCS) -> str:
    return (
        "with l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)), "
        r"k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l), "
        f"r as (select key, max(doc_id) as keeper from k where length(key) >= {LEAST_CHARS} group by key having count(distinct doc_id) >= {least_docs}), "
        "j as (select k.*, coalesce(doc_id <> keeper, false) as gone from k left join r using (key)) "
        "select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from j group by doc_id"
    )
