"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Every run of ``window`` words of an item
is a pattern (an item with fewer words is one pattern), written with single blanks between words and at both ends. A text
is normalised the same way and scanned once; the end of each occurrence is mapped back to word numbers and, through the
word positions, to offsets in the original text.

The benchmark's characters are counted first. Patterns of up to BLOCK_CHARS form one automaton, built once in each Python
worker, and texts are scanned once. A larger benchmark, of whatever size, is dealt out in blocks of at most that many: its
items are cut into overlapping segments, each once for an item; segments are dealt to many small buckets by the hash of words
and item, the sizes of the buckets are counted, and buckets are put together up to the bound (only a bucket that a single
giant segment fills can be larger). The blocks are fetched and scanned one after the other, so a worker holds one automaton
at a time and builds it once. What the blocks find is kept for each
distinct text, put together, and joined back to the rows by the hash of the text. The result is the same.

Nulls have no words, in texts and in items. Very long texts are scanned whole. Repeated items count once. Items with a null id mark words but are not listed. Repeated item ids count as one
item; repeated documents are all reported. Empty tables give no hits or no rows. Columns besides doc_id and text, and
item_id and text, are ignored; those named by ``carry`` come along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm import storage

WINDOW = 10
#: Characters of the patterns of one automaton, about 350 MB in a worker. Words of a segment of an item where there are several.
BLOCK_CHARS, SEGMENT_WORDS = 8 << 20, 2_000
#: Buckets for each block.
FINE = 16
#: A word, in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_UPPER, _LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(_UPPER, _LOWER_CASE)
_SPANS = "array<struct<start: int, end: int>>"
_SCHEMA = f"doc_id bigint, n_words bigint, hits {_SPANS}, n_hit bigint, items array<string>"
_BUILT: dict[str, object] = {}


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


def patterns(items: list[tuple], window: int = WINDOW) -> dict[str, set]:
    """pattern: ids of the items, given as lists of words, that have it."""
    found: dict[str, set] = {}
    for item_id, w in items:
        for i in range(max(1, len(w) - window + 1)) if w else ():
            found.setdefault(f" {' '.join(w[i : i + window])} ", set()).update([] if item_id is None else [str(item_id)])
    return found


def automaton(items: list[tuple], window: int, key: str):
    """The automaton of a block, kept in the worker until another is asked for."""
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for pattern, ids in patterns(items, window).items():
            found.add_word(pattern, (pattern.count(" ") - 1, tuple(sorted(ids))))
        if len(found):
            found.make_automaton()
        _BUILT[key] = found
    return _BUILT[key]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER_CASE), F.lit(WORD), F.lit(0))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, hits (spans of the original text, code points), n_hit (words hit), items (ids as strings, sorted).

    ``carry`` names further columns of docs that come along, so that a filter needs no join.
    """
    spark = docs.sparkSession
    storage.ship(spark)
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    n = items.agg(F.coalesce(F.sum(_chars(window)), F.lit(0))).first()[0]
    wanted = docs.select("doc_id", "text", *[F.col(c).alias(f"_{c}") for c in carry])
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    if n <= BLOCK_CHARS:
        return wanted.mapInArrow(_scanner(_shared(spark, items, window), window, carry), _SCHEMA + more)
    return _in_blocks(wanted, items, n, window, carry, more)


def _chars(window: int) -> Column:
    """Characters of the patterns of ``words``, at most."""
    return (F.length(F.array_join("words", " ")) + 1) * window


def _shared(spark, items: DataFrame, window: int) -> Broadcast:
    """The items of a block, whose size is bounded."""
    rows = sorted(((r["item_id"], r["words"]) for r in items.collect()), key=repr)
    return spark.sparkContext.broadcast((hashlib.sha256(repr((window, rows)).encode()).hexdigest(), rows))


def _scanner(block: Broadcast, window: int, carry: tuple[str, ...]):
    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matches(batch.column(0), batch.column(1).to_pylist(), block.value, window)
            yield pa.RecordBatch.from_arrays([*found.columns, *batch.columns[2:]], names=[*found.schema.names, *carry])

    return scan_batches


def _in_blocks(wanted: DataFrame, items: DataFrame, n: int, window: int, carry: tuple[str, ...], more: str) -> DataFrame:
    """The same for a benchmark of several blocks."""
    spark = wanted.sparkSession
    buckets = FINE * -(-n // BLOCK_CHARS)
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)), F.lit(SEGMENT_WORDS))
    cut = items.select("item_id", F.explode(F.transform(begins, lambda i: F.slice("words", i, SEGMENT_WORDS + window - 1))).alias("words")).distinct()
    cut = storage.written(cut.withColumn("bucket", F.pmod(F.xxhash64("words", "item_id"), F.lit(buckets))), "benchmark-segments")
    blocks = _blocks([(r["bucket"], r["n"]) for r in cut.groupBy("bucket").agg(F.sum(_chars(window)).alias("n")).orderBy("bucket").collect()])  # FINE numbers for each block
    texts = wanted.select("text", _text_hash().alias("hash"))
    found = None
    for own in blocks:
        block = _shared(spark, cut.where(F.col("bucket").isin(own)).select("item_id", "words"), window)
        new = texts.mapInArrow(_finder(block, window), "hash binary, words array<int>, items array<string>")
        new = storage.written(new.dropDuplicates(["hash"]), "benchmark-hits")
        block.destroy()
        found = new if found is None else found.union(new)
    each = found.groupBy("hash").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    names = [c for c in wanted.columns if c not in ("doc_id", "text")]
    joined = wanted.withColumn("_hash", _text_hash()).join(each.withColumnRenamed("hash", "_hash"), "_hash", "left").select("doc_id", "text", "_words", "_items", *names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(t, hit or [], items or []) for t, hit, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            marked = _batch(batch.column(0), rows)
            yield pa.RecordBatch.from_arrays([*marked.columns, *batch.columns[4:]], names=[*marked.schema.names, *carry])

    return joined.mapInArrow(mark, _SCHEMA + more)


def _blocks(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Buckets put together, in their order, up to BLOCK_CHARS."""
    blocks, room = [], 0
    for bucket, n in sizes:
        if not blocks or n > room:
            blocks.append([])
            room = BLOCK_CHARS
        blocks[-1].append(bucket)
        room -= n
    return blocks


def _text_hash() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _finder(block: Broadcast, window: int):
    """The texts with hits: their hash, the numbers of the words hit, the items."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(block.value[1], window, block.value[0])
        for batch in batches:
            rows = []
            for text, digest_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hit, ids = occurrences(words(text), machine)
                if len(hit):
                    rows.append((digest_, hit.tolist(), sorted(ids)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            types = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["hash", "words", "items"])

    return find


def occurrences(own: list[str], machine) -> tuple[np.ndarray, set[str]]:
    """The numbers of the words hit, ascending, and the items."""
    items: set[str] = set()
    if not len(machine):
        return np.zeros(0, np.int64), items
    text, marks = f" {' '.join(own)} ", None
    for at, (n, ids) in machine.iter(text):
        if marks is None:
            blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
            marks = np.zeros(len(own), bool)
        last = int(np.searchsorted(blanks, at)) - 1
        marks[last - n + 1 : last + 1] = True
        items.update(ids)
    return np.zeros(0, np.int64) if marks is None else np.flatnonzero(marks), items


def matches(doc_ids: pa.Array, texts: list[str | None], block: tuple[str, list[tuple]], window: int) -> pa.RecordBatch:
    machine = automaton(block[1], window, block[0])
    rows = []
    for text in texts:
        own = words(text)
        hit, items = occurrences(own, machine)
        rows.append(_row(text, hit, sorted(items)) if len(hit) else (len(own), [], 0, []))
    return _batch(doc_ids, rows)


def _row(text: str | None, hit, items: list[str]) -> tuple:
    """Words, spans of the runs of words hit, words hit, items."""
    where = [m.span() for m in _WORD.finditer(text.translate(_LOWER))] if text else []
    hit = np.sort(np.asarray(hit, dtype=np.int64))
    ends = np.flatnonzero(np.diff(hit) != 1)
    runs = zip(hit[np.concatenate([[0], ends + 1])], hit[np.concatenate([ends, [-1]])], strict=True) if len(hit) else ()
    return len(where), [{"start": where[a][0], "end": where[b][1]} for a, b in runs], len(hit), items


def _batch(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, spans, n_hit, items = zip(*rows, strict=True) if rows else ((), (), (), ())
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    columns = [doc_ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "hits", "n_hit", "items"])


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def digest_sql(window: int = WINDOW) -> str:
    """The same in DuckDB's SQL: windows of documents joined with windows of items."""
    alphabet = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    found = rf"regexp_extract_all(translate(coalesce(text, ''), {alphabet}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return (
        f"with b as (select item_id, {found} as w from benchmark), "
        f"p as (select distinct item_id, least(len(w), {window}) as n, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') as g from "
        f"(select item_id, w, unnest(range(1, greatest(2, len(w) - {window} + 2))) as i from b where len(w) > 0)), "
        f"d as (select doc_id, {found} as w from documents), "
        "g as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from p))), "
        "m as (select doc_id, i, p.n, item_id from g join p on g.n = p.n and g.g = p.g), "
        "h as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from m) group by doc_id), "
        "t as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from m) group by doc_id) "
        "select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, "
        "coalesce(n_hit, 0) > 0 as contaminated from d left join h using (doc_id) left join t using (doc_id)"
    )
