"""Near-duplicate documents by a signature-coordinate inverted join, confirmed on full shingle sets.

A document is the set of its distinct five-word shingles (64-bit hashes). Documents with equal sets are one class from the
start, so groups of copies cost nothing further. A class has COORDINATES signature coordinates, each combining ROWS MinHash
values, so that a coordinate agrees with probability J ** ROWS. Classes are posted under each coordinate and value. Lists
with one member are skipped, collisions are counted over the others, and a class that collides in fewer than MATCHES lists is
skipped with all its pairs, none of which can agree in MATCHES coordinates. For the others the first
COORDINATES - MATCHES + 1 lists (prefix) hold every pair that does. Two classes with similarity 0.85 agree in 14.7 of the 24
coordinates on average and in fewer than MATCHES = 2 with probability 5e-9; at 0.8 that is 9e-7.

The threshold isn't applied to the pairs themselves, as a list may hold a large group and its pairs aren't written out: each
list has a leader (the class that collides most, so the middle of its group), and (leader, member) pairs, merged over all
lists, are confirmed exactly. A member that collides little with its leader may be similar to another member. So in a group
with members that aren't linked with the leader, each of those is compared with every other member, exactly and at once,
however large the group. The pairs are dealt out in tiles of bounded members and shingles. Members of a group are much alike,
and a tile writes down only where each differs from what most of its members hold: with those sets of differences d, two
members differ in |d(x)| + |d(y)| - 2 |d(x) & d(y)| shingles. Pairs stay quadratic in a group, but cost a few additions each
where differences are few; rows shuffled grow with the group times its number of blocks.

Components of the links come from alternating large-star and small-star steps, written to the shared folder each round.

Documents without words (null, empty, blank) have no shingles and no links. Rows with a null doc_id take no part and stay.
Rows that repeat a doc_id are one document. An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm import storage

SHINGLE = 5
#: Links need so many hundredths of the union in common, unless a caller says otherwise.
NEED = 85
COORDINATES, ROWS, MATCHES = 24, 3, 2
#: A group is cut into blocks, which meet in tiles: shingles of a block, members of a block of a group of up to BLOCKS blocks,
#: and how many times as many members a block of a larger group has.
SMALL, TILE, BLOCKS, LARGER = 1 << 19, 128, 8, 16
_SIGNED = "doc_id bigint, n_shingles bigint, node binary, coordinates array<bigint>"


def _odd(seed: str, n: int) -> np.ndarray:
    """n odd 64-bit multipliers, fixed by their seed."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}{i}") | 1 for i in range(n)], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes. bytes.lower() changes A-Z alone; bytes.split() cuts at blanks from 9 to 13 and 32."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    weights, n = _odd("shingle", SHINGLE), len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += h[i : i + n] * weights[i]
    return np.unique(_mixed(total))


def coordinates(hashes: np.ndarray) -> np.ndarray:
    """The signature of a set: COORDINATES values, each of ROWS MinHash values and its own number."""
    least = np.full(COORDINATES * ROWS, np.iinfo(np.uint64).max, np.uint64)
    factors = _odd("minhash", COORDINATES * ROWS)[:, None]
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, i : i + 2048] * factors).min(axis=1), out=least)
    weights = _odd("coordinate", ROWS)
    return _mixed((least.reshape(COORDINATES, ROWS) * weights).sum(axis=1, dtype=np.uint64) + _odd("number", COORDINATES)).view(np.int64)


def _node(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        signed = [coordinates(s).tolist() if len(s) else None for s in sets]
        columns = [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.binary()), pa.array(signed, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "coordinates"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])


def linked(a, b, both, need: int = NEED):
    """Whether sets of a and b elements with so many in both are linked; numbers, or arrays of them."""
    return 100 * both >= need * (a + b - both)


def _comparer(need: int):
    def compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes, sizes = [], []
            for m, le in zip(batch.column("m_hashes").to_pylist(), batch.column("l_hashes").to_pylist(), strict=True):
                member, leader = np.frombuffer(m, np.uint64), np.frombuffer(le, np.uint64)
                at = np.minimum(np.searchsorted(leader, member), len(leader) - 1)
                yes.append(linked(len(member), len(leader), int((leader[at] == member).sum()), need))
                sizes.append(len(member))
            columns = [batch.column("leader"), batch.column("node"), pa.array(yes, pa.bool_()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["leader", "node", "linked", "n"])

    return compare_batches


def _blocks(members: Column, shingles: Column) -> Column:
    """Into how many blocks so many members with so many shingles in all are dealt out."""
    blocks = F.greatest(F.ceil(shingles / SMALL), F.ceil(members / (TILE * LARGER)), F.least(F.ceil(members / TILE), F.lit(BLOCKS)))
    return F.least(members, blocks).cast("int")


def _tiles(few: DataFrame) -> DataFrame:
    """leader, tile, node, linked, probe, target: every probe is compared with every target of its tile.

    few: leader, node, linked, and the group's n_open and s_open (members not linked with the leader and their shingles), n_linked
    and s_linked. Between them, the tiles of a group hold every pair with a member that isn't linked with the leader.
    """
    n_open, n_linked = _blocks(F.col("n_open"), F.col("s_open")), _blocks(F.col("n_linked"), F.col("s_linked"))
    one = _blocks(F.col("n_open") + F.col("n_linked"), F.col("s_open") + F.col("s_linked")) == 1
    block = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), n_linked).otherwise(n_open)).cast("int")
    tile = lambda a, b, probe, target: F.struct(a.alias("a"), b.alias("b"), probe.alias("probe"), target.alias("target"))
    yes, no, upto = F.lit(True), F.lit(False), lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(upto(n_open), lambda b: tile(F.least("block", b), F.greatest("block", b), F.col("block") <= b, F.col("block") >= b))
    against = F.when(n_linked > 0, F.transform(upto(n_linked), lambda c: tile(F.col("block"), n_open + c, yes, no))).otherwise(F.slice(among, 1, 0))
    targets = F.transform(upto(n_open), lambda a: tile(a, n_open + F.col("block"), no, yes))
    single = F.array(tile(F.lit(0), F.lit(0), ~F.col("linked"), yes))
    rows = few.withColumn("block", block)
    rows = rows.select("leader", "node", "linked", F.explode(F.when(one, single).when(F.col("linked"), targets).otherwise(F.concat(among, against))).alias("t"))
    return rows.select("leader", F.struct("t.a", "t.b").alias("tile"), "node", "linked", "t.probe", "t.target")


def _differences(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, number of each row's elements), by row: elements, numbered, that a set holds and at most half of all sets
    do, or that it lacks and more than half hold."""
    hashes, element = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    usual = 2 * np.bincount(element, minlength=len(hashes)) > len(sets)
    held = usual[element]
    lacks = np.ones((len(sets), int(usual.sum())), bool)  # at most twice as many places as the sets have elements
    lacks[row[held], (np.cumsum(usual) - 1)[element[held]]] = False
    without, which = np.nonzero(lacks)
    row, element = np.concatenate([row[~held], without]), np.concatenate([element[~held], np.flatnonzero(usual)[which]])
    order = np.argsort(row, kind="stable")
    return row[order], element[order], np.bincount(row, minlength=len(sets))


def _settler(need: int):
    """Links that connect the members of one tile as far as their sets do. Those linked with the leader are one part already.

    Each probe counts, through lists of the targets that hold an element, in what its differences agree with all targets'.
    """

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("node", "linked", "probe", "target", "hashes")), strict=True)]
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        probes, targets = np.flatnonzero([r[2] for r in rows]), np.flatnonzero([r[3] for r in rows])
        part = np.where([r[1] for r in rows], len(rows), np.arange(len(rows)))
        out: list[tuple[bytes, bytes]] = []
        if len(probes) and len(targets):
            row, element, n = _differences(sets)
            column = np.full(len(rows), -1)
            column[targets] = np.arange(len(targets))
            listed = np.flatnonzero(column[row] >= 0)
            listed = listed[np.argsort(element[listed], kind="stable")]
            holders, last = column[row[listed]], int(element.max(initial=0)) + 1
            begin = np.concatenate([[0], np.cumsum(np.bincount(element[listed], minlength=last))])
            ends = np.cumsum(n)
            for i in probes.tolist():
                own = element[ends[i] - n[i] : ends[i]]
                first, many = begin[own], begin[own + 1] - begin[own]
                agree = np.bincount(holders[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=len(targets))
                both = sizes[i] + sizes[targets] - (n[i] + n[targets] - 2 * agree) >> 1
                near = targets[linked(sizes[i], sizes[targets], both, need) & (part[targets] != part[i])]
                if len(near):
                    parts, at = np.unique(part[near], return_index=True)
                    out += [(rows[i][0], rows[j][0]) for j in near[at].tolist()]
                    part[np.isin(part, parts)] = part[i]
                    if (part == part[i]).all():
                        break
        columns = list(zip(*out, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary())], names=["node", "leader"])

    return settle


def links(signed: DataFrame, docs: DataFrame, need: int = NEED) -> tuple[DataFrame, DataFrame]:
    """(classes: node, rep; links: node, leader). Links connect every pair of similar classes, not each pair directly."""
    known = signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("coordinates").alias("coordinates"))
    posted = classes.select("node", F.posexplode("coordinates").alias("at", "key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = storage.written(posted.join(storage.written(lists, "lists"), "key"), "postings")
    pairs = storage.written(_with_leaders(shared), "pairs")
    classes = known.groupBy("node").agg(F.min("doc_id").alias("rep"))
    wanted = pairs.select("node").union(pairs.select(F.col("leader").alias("node"))).distinct()
    ids = wanted.join(classes, "node").select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi").select("text").mapInArrow(_sets, "node binary, hashes binary")
    sets = storage.written(sets.dropDuplicates(["node"]), "shingle-sets", codec="none")
    both = pairs.join(sets.withColumnRenamed("hashes", "m_hashes"), "node").join(sets.select(F.col("node").alias("leader"), F.col("hashes").alias("l_hashes")), "leader")
    checked = storage.written(both.mapInArrow(_comparer(need), "leader binary, node binary, linked boolean, n bigint"), "checked")
    count, size = (lambda c, name: F.count_if(c).alias(name)), (lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name))
    yes, no = F.col("linked"), ~F.col("linked")
    open_ = checked.groupBy("leader").agg(count(no, "n_open"), size(no, "s_open"), count(yes, "n_linked"), size(yes, "s_linked")).where("n_open > 0 and n_open + n_linked > 1")
    open_ = storage.written(open_, "groups")  # joined by an exchange of its own, if any, so that a large group can be split
    tiles = _tiles(checked.join(open_, "leader")).join(sets, "node").groupBy("leader", "tile")
    settled = storage.written(tiles.applyInArrow(_settler(need), "node binary, leader binary"), "links")
    return classes, checked.where("linked").select("node", "leader").union(settled)


def _with_leaders(shared: DataFrame) -> DataFrame:
    """leader, node: each member of a list with the member of it that collides most over all lists.

    Members of fewer than MATCHES lists are skipped; the lists of the last MATCHES - 1 coordinates aren't needed then.
    """
    weight = shared.groupBy("node").agg(F.sum("members").alias("weight"), F.count("*").alias("_lists")).where(F.col("_lists") >= MATCHES).select("node", "weight")
    shared = shared.where(F.col("at") <= COORDINATES - MATCHES)
    leaders = shared.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    leaders = storage.written(leaders, "leaders")  # joined by an exchange of its own, so that a hot list can be split
    pairs = shared.join(leaders, "key").where("node <> leader").select("leader", "node").distinct()
    return pairs.join(weight.select("node"), "node", "left_semi").select("leader", "node")


def components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id reachable) for every id with an edge. edges: a, b (longs)."""
    edges = storage.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = storage.written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = storage.written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def groups(docs: DataFrame, need: int = NEED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs. need: hundredths of the union that a link needs."""
    storage.ship(docs.sparkSession)
    signed = storage.written(docs.select("doc_id", "text").mapInArrow(_sign, _SIGNED), "signatures")
    classes, found = links(signed, docs, need)
    named = found.join(classes.select("node", F.col("rep").alias("a")), "node").join(classes.select(F.col("node").alias("leader"), F.col("rep").alias("b")), "leader")
    copies = signed.select("doc_id", "node").join(classes, "node").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    roots = components(named.select("a", "b").union(copies))
    out = signed.select("doc_id", "n_shingles").join(roots.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def digest_sql() -> str:
    """The same by comparing shingle sets in DuckDB's SQL."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        rf"with recursive w as (select doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') as w from documents), "
        f"s as (select distinct doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) as i from w where len(w) > 0)), "
        "n as (select doc_id, count(*) as n from s group by doc_id), "
        "i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all), "
        f"e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {NEED} * (x.n + y.n - k)), "
        "u as (select a, b from e union all select b, a from e), "
        "c as (select doc_id, doc_id as root from documents union select u.b, c.root from c join u on u.a = c.doc_id), "
        "m as (select doc_id, min(root) as component_id from c group by doc_id) "
        "select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from documents left join n using (doc_id) left join m using (doc_id)"
    )
