"""Vector codes by product quantisation, with codebooks from Lloyd's rounds over cover trees.

A component c of a vector becomes the integer floor(256 c); vectors are cut into 16 consecutive parts of equal length. For
each part the codebook starts as that part of the vectors with the 64 smallest vec_ids. A round assigns every part to the
nearest entry (squared distance, ties to the lower index) and replaces each entry by the floor of its parts' mean.

1. Tasks cut their rows into blocks and build a cover tree for each part of a block (``cover_tree``). Trees are written to
   the shared folder once, with the columns that are carried along; every round and the last assignment read them.
2. In a round, the codebooks (a number of integers that depends on the length of vectors alone) go to all tasks. Whole
   subtrees fall to one entry where the triangle inequality says so, and count by their cumulative sums; only ambiguous
   nodes descend to exact comparisons. A task returns one row for each part and entry.
3. Everything is in integers, so results don't depend on blocks, order or retries.

Rows whose vector is null, or holds a null, a NaN or an infinity, are left out, and so are rows whose vector has another
length than most have (ties: the longer). A length that 16 doesn't divide is cut as evenly as can be, the i-th part from
floor(i d / 16) on. Of rows that repeat a vec_id, the smallest vector can start a codebook; rows with a null vec_id start none.
With fewer ids, codebooks are smaller; where all are null, they start from the 64 smallest distinct vectors. Integers beyond
2^30 / sqrt(d) in size count as that, so that errors fit a long. An empty table gives no rows. Equal rows are rows of their own. A hot vector is one weighted point of each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm import cover_tree, storage
from vacancia.llm.whitening import finite

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows of a block; its trees take some 20 bytes a component.
BLOCK = 4096


def _cuts(d: int) -> list[int]:
    return [i * d // PARTS for i in range(PARTS + 1)]


def _integers(vectors: pa.Array, d: int) -> np.ndarray:
    most = int(2**30 / max(d, 1) ** 0.5)
    return np.clip(np.floor(np.asarray(vectors.flatten(), np.float64) * SCALE), -most, most).astype(np.int64).reshape(len(vectors), d)


def first_vectors(rows: DataFrame, d: int, vec_id: str, vector: str) -> np.ndarray:
    """The integer vectors of the smallest vec_ids; a task returns its own smallest only."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, list[int]] = {}
        for batch in batches:
            x = _integers(batch.column(1), d)
            ids = batch.column(0).to_pylist()
            for i in np.lexsort(x.T[::-1]).tolist() if d else range(len(ids)):  # by vector, so the first of an id is its smallest
                if ids[i] not in best or best[ids[i]] > x[i].tolist():
                    best[ids[i]] = x[i].tolist()
            best = dict(sorted(best.items(), key=lambda kv: (kv[0] is None, kv[0] or 0))[:ENTRIES])
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.int64()))], names=["id", "x"])

    named = rows.where(F.col(vec_id).isNotNull())
    found = named.select(vec_id, vector).mapInArrow(smallest, "id bigint, x array<bigint>").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").limit(ENTRIES).collect()
    if not found:  # no row has an id
        found = rows.select(F.lit(0).cast("long").alias("id"), vector).mapInArrow(_distinct_smallest(d), "id bigint, x array<bigint>").select("x").distinct().orderBy("x").limit(ENTRIES).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(len(found), d)


def _distinct_smallest(d: int):
    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: set[tuple[int, ...]] = set()
        for batch in batches:
            best = set(sorted(best | set(map(tuple, _integers(batch.column(1), d).tolist())))[:ENTRIES])
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(best), pa.int64()), pa.array([list(x) for x in best], pa.list_(pa.int64()))], names=["id", "x"])

    return smallest


def tree_blocks(rows: DataFrame, d: int, vector: str, keep: list[str]) -> DataFrame:
    """carried (array of structs), trees (array of binaries): one row for each block, written once."""
    cuts = _cuts(d)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            x = _integers(table.column(vector), d)
            trees = [cover_tree.build(x[:, a:b]).packed() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            carried = pa.StructArray.from_arrays([table.column(c) for c in keep], keep)
            whole = pa.array([0, len(x)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, carried), pa.array([trees], pa.list_(pa.binary()))], names=["carried", "trees"])

        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                piece = batch.slice(at, BLOCK)
                if size + len(piece) > BLOCK:
                    yield made()
                    waiting, size = [], 0
                waiting.append(piece)
                size += len(piece)
        if size:
            yield made()

    schema = rows.select(F.array(F.struct(*keep)).alias("carried"), F.array(F.lit(b"")).alias("trees")).schema
    columns = list(dict.fromkeys([*keep, vector]))
    return storage.written(rows.select(*columns).mapInArrow(blocks, schema), "vector-trees")


def lloyd(blocks: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after the rounds."""
    for _ in range(rounds):
        now = books

        def partial(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = now) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
            for batch in batches:
                for trees in batch.column(0):
                    for part, tree in enumerate(trees.values):
                        sums[part] += cover_tree.totals(cover_tree.unpacked(tree.as_py()), books[part])
            rows = [(part, entry, row) for part, s in enumerate(sums) for entry, row in enumerate(s.tolist()) if row[0]]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64()))], names=["part", "entry", "sums"])

        cells = blocks.select("trees").mapInArrow(partial, "part int, entry int, sums array<bigint>").select("part", "entry", F.posexplode("sums").alias("at", "s"))
        totals: dict[tuple[int, int], dict[int, int]] = {}
        for r in cells.groupBy("part", "entry", "at").agg(F.sum("s").alias("s")).collect():  # as many as the codebooks have integers
            totals.setdefault((r["part"], r["entry"]), {})[r["at"]] = r["s"]
        books = [b.copy() for b in books]
        for (part, entry), s in totals.items():
            books[part][entry] = [s[i + 1] // s[0] for i in range(books[part].shape[1])]
    return books


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The carried columns (default: all but the vector), code (string) and error (long); the codebooks by part."""
    storage.ship(vectors.sparkSession)
    keep = [c for c in (carry if carry is not None else [c for c in vectors.columns if c != vector]) if c.lower() not in ("code", "error")]
    rows = vectors.where(finite(vector))
    lengths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = vectors.select(*keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema), []
    d = lengths["d"]
    cuts, rows = _cuts(d), rows.where(F.size(vector) == d)
    first = first_vectors(rows, d, vec_id, vector)
    blocks = tree_blocks(rows, d, vector, keep)
    books = lloyd(blocks, [first[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                carried = batch.column(0).slice(i, 1).flatten()
                index, error = np.zeros((len(carried), PARTS), np.uint8), np.zeros(len(carried), np.int64)
                for part, tree in enumerate(batch.column(1)[i].values):
                    index[:, part], squares = cover_tree.codes(cover_tree.unpacked(tree.as_py()), books[part])
                    error += squares
                code = [row.tobytes().hex() for row in index]
                yield pa.RecordBatch.from_arrays([*carried.flatten(), pa.array(code, pa.string()), pa.array(error)], names=[*keep, "code", "error"])

    return blocks.select("carried", "trees").mapInArrow(assign, schema), books


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for, in the units of the input."""
    return np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(code), strict=True)]) / SCALE


def digest(compressed: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """label_error sums the errors of equal labels; sums are by label first, so a hot label is a row of each task."""
    rows = storage.written(compressed.select("vec_id", "label", "code", "error"), "vector-codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sha = hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def digest_sql() -> str:
    """The same without trees: every part against every entry."""
    scalar = "list_inner_product({0}, {0}) - 2 * list_inner_product({0}, {1}) + list_inner_product({1}, {1})"
    square = f"cast({scalar.format('p.x', 'c.x')} as bigint)"

    def assigned(name: str, book: str) -> str:
        return f"{name} as (select vec_id, part, min({square} * {ENTRIES} + entry) as best from p join {book} c using (part) group by vec_id, part)"

    def updated(name: str, by: str, book: str) -> str:
        means = f"(select part, entry, i, cast(floor(cast(sum(v) as double) / count(*)) as bigint) as v from (select part, best % {ENTRIES} as entry, unnest(x) as v, generate_subscripts(x, 1) as i from {by} join p using (vec_id, part)) group by part, entry, i)"
        return f"{name} as (select part, entry, coalesce(m.x, c.x) as x from {book} c left join (select part, entry, list(cast(v as double) order by i) as x from {means} group by part, entry) m using (part, entry))"

    return (
        f"with v as (select vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * cast(e as double))) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0), "
        f"p as (select vec_id, label, part, list_slice(q, part * len(q) // {PARTS} + 1, (part + 1) * len(q) // {PARTS}) as x from v, range({PARTS}) r(part)), "
        f"c0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from p where vec_id in (select vec_id from v order by vec_id limit {ENTRIES})), "
        f"{assigned('a1', 'c0')}, {updated('c1', 'a1', 'c0')}, {assigned('a2', 'c1')}, {updated('c2', 'a2', 'c1')}, {assigned('a3', 'c2')}, "
        f"e as (select vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' order by part) as code, cast(sum(best // {ENTRIES}) as bigint) as error from a3 group by vec_id), "
        "s as (select sha256(string_agg(cast(cast(v as bigint) as varchar), ',' order by part, entry, i)) as codebooks_sha256 from (select part, entry, unnest(x) as v, generate_subscripts(x, 1) as i from c2)) "
        "select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from e join v using (vec_id), s"
    )
