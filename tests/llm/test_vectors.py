"""Vector codes and whitening against plain versions, on rows with nulls, gaps, ties, repeats, hot vectors and clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest

from vacancia.llm import cover_tree, vector_codes, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, x string, part int, carried int, deviation string, WHITENED string, i int"
D = 36  # not a multiple of 16


def vectors(n=900, seed=5):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(D)] for _ in range(12)]
    near = lambda c: [v + rng.gauss(0, 0.05) for v in c]
    rows = [(3 * i + 7, near(rng.choice(centres)), rng.choice([1, 2, None])) for i in range(n)]
    rows += [(rng.randrange(10_000), centres[0], 1) for _ in range(n // 2)]  # a third are one vector
    rows += [(10, near(centres[1]), 2), (10, near(centres[2]), 2), (None, near(centres[3]), None), (None, None, None), (1, None, 1)]
    rows += [(2, [float("nan")] + [0.0] * (D - 1), 1), (4, [float("inf")] * D, 1), (5, [None] + [0.0] * (D - 1), 1), (0, [], 3), (6, [0.5], 3), (9, [-0.0] * D, 3)]
    rng.shuffle(rows)
    return [(i, v, label, "c", "x", 1, 1, "d", "w", 1) for i, v, label in rows]


def usable(rows):
    return [r for r in rows if r[1] is not None and len(r[1]) == D and all(v is not None and math.isfinite(v) for v in r[1])]


@pytest.mark.parametrize("width", [0, 1, 4])
def test_cover_tree_finds_what_comparing_all_finds(width):
    rng = np.random.default_rng(width)
    for n, spread in ((1, 5), (13, 3), (700, 4), (900, 400)):
        given, entries = rng.integers(-spread, spread, (n, width)), rng.integers(-spread, spread, (9, width))
        entries[5] = entries[2]  # a tie
        tree = cover_tree.unpacked(cover_tree.build(given).packed())
        squares = ((given[:, None] - entries[None]) ** 2).sum(-1)
        entry, square = cover_tree.codes(tree, entries)
        assert (entry == squares.argmin(1)).all() and (square == squares.min(1)).all()
        totals = cover_tree.totals(tree, entries)
        for e in range(9):
            assert totals[e].tolist() == [(entry == e).sum(), *given[entry == e].sum(axis=0)]
        for node in range(len(tree.centre)):
            own = tree.points[tree.start[node] : tree.end[node]]
            assert ((own - tree.points[tree.centre[node]]) ** 2).sum(axis=1).max() <= tree.radius[node] ** 2 + 1e-6


def test_tight_clusters_fall_to_their_entries_as_whole_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (20, 4))
    tree = cover_tree.build(centres[rng.integers(0, 20, 4000)] + rng.integers(-20, 20, (4000, 4)))
    entry, start, end = cover_tree.nearest(tree, centres)
    assert (end - start)[(end - start) > 1].sum() > 0.9 * len(tree.points) and len(entry) < 400


def plain_codes(rows):
    good = usable(rows)
    x = np.floor(np.array([r[1] for r in good], np.float32).astype(float) * 256).astype(np.int64)
    ids = sorted({r[0] for r in good if r[0] is not None})[:64]
    first = [min(x[i].tolist() for i, r in enumerate(good) if r[0] == k) for k in ids]
    cuts = [i * D // 16 for i in range(17)]
    codes, errors, numbers = [""] * len(good), [0] * len(good), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        points, book = x[:, a:b].tolist(), [f[a:b] for f in first]
        for turn in range(3):
            best = [min((sum((p - q) ** 2 for p, q in zip(point, entry, strict=True)), e) for e, entry in enumerate(book)) for point in points]
            if turn < 2:
                for e in range(len(book)):
                    mine = [p for p, (_, k) in zip(points, best, strict=True) if k == e]
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else book[e]
        for i, (square, e) in enumerate(best):
            codes[i] += f"{e:02x}"
            errors[i] += square
        numbers += [v for entry in book for v in entry]
    sums = {}
    for r, e in zip(good, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    return sorted((str(r[0]), c, e, sums[r[2]], sha) for r, c, e in zip(good, codes, errors, strict=True))


def test_codes_equal_plain_lloyd_whatever_the_blocks(spark, monkeypatch):
    rows = vectors()
    expected = plain_codes(rows)
    for parts, block in ((1, 4096), (7, 50)):
        monkeypatch.setattr(vector_codes, "BLOCK", block)
        got = vector_codes.digest(*vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(parts))).collect()
        assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == expected


def test_codes_of_odd_tables(spark):
    few = [(i, [0.1 * i] * 16, 1) for i in range(3)]
    out, books = vector_codes.compress(spark.createDataFrame(few, "vec_id bigint, embedding array<double>, label int"))
    assert sorted(r["code"] for r in out.collect()) == ["00" * 16, "01" * 16, "02" * 16] and [len(b) for b in books] == [3] * 16
    assert vector_codes.decode("01" * 16, books).tolist() == [25 / 256] * 16
    no_ids = spark.createDataFrame([(None, [0.5] * 16), (None, [0.25] * 16)], "vec_id bigint, embedding array<double>")
    assert sorted(r["code"] for r in vector_codes.compress(no_ids)[0].collect()) == ["00" * 16, "01" * 16]
    empty = spark.createDataFrame([(1, None, 1, "a", "b", 1, 1, "d", "w", 1)], SCHEMA)
    assert vector_codes.digest(*vector_codes.compress(empty)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, [])], "vec_id bigint, embedding array<float>"))[0].first()["code"] == "00" * 16


def plain_whitening(rows):
    good = usable(rows)
    x = np.floor(np.array([r[1] for r in good], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    z = (n * fit - sums) / n
    values, components = np.linalg.eigh(z.T @ z / n)
    values, components = values[::-1][:16], components[:, ::-1][:, :16]
    deviation = [sum(int(v) ** 2 for v in n * row - sums) for row in x]
    return good, n, deviation, (n * x - sums) / n @ components / np.sqrt(values), values / (z**2).sum() * n


def test_whitening_equals_an_eigendecomposition(spark):
    rows = vectors()
    good, n, deviation, whitened, explained = plain_whitening(rows)
    got = whitening.digest(*whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5))).toPandas()
    assert len(got) == 16 * len(good) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    key = lambda v, d, w: (str(v), d, round(abs(w[0]), 6))
    mine = sorted(key(None if v is None or v != v else int(v), d, g["whitened"].to_numpy()) for (v, d), g in got.assign(vec_id=got["vec_id"].astype(object).where(got["vec_id"].notna(), None)).groupby(["vec_id", "deviation"], dropna=False) for _ in range(len(g) // 16))
    theirs = sorted(key(r[0], d, w) for r, d, w in zip(good, deviation, whitened, strict=True))
    assert [m[:2] for m in mine] == [t[:2] for t in theirs] and np.allclose([m[2] for m in mine], [t[2] for t in theirs], atol=1e-5)
    rows_ = whitening.whiten(spark.createDataFrame(rows, SCHEMA))[0]
    assert [c for c in rows_.columns if c.lower() == "whitened"] == ["whitened"] and "code" in rows_.columns


def test_whitening_of_nearly_and_fully_dependent_dimensions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 3)) * [5000, 50, 0.5]
    full = np.column_stack([base, base[:, 0], np.full(500, 7.0)])  # a repeated and a constant dimension
    df = spark.createDataFrame([(i, v) for i, v in enumerate(full.tolist())], "vec_id bigint, embedding array<double>")
    out, model = whitening.whiten(df)
    x = np.floor(full * 64)
    v = np.cov(np.unique(x, axis=0).T, bias=True)
    assert np.allclose(model.eigenvalues[:3], np.linalg.eigvalsh(v)[::-1][:3], rtol=1e-9) and model.eigenvalues[3:].tolist() == [0, 0] and model.identity_error < 1e-9
    first = out.first()["whitened"]
    assert len(first) == 5 and None not in first[:3] and first[3:] == [None, None]


def test_whitening_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>"
    one, model = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema))
    assert [(r["deviation"], r["whitened"]) for r in one.collect()] == [(0, [None, None])] * 2 and model.n == 1
    assert whitening.digest(one, model).where("explained is null and identity_error is null").count() == 4
    for rows in ([], [(1, None), (2, [])]):
        none = whitening.digest(*whitening.whiten(spark.createDataFrame(rows, schema)))
        assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], schema))[0]
    assert {r["vec_id"]: r["deviation"] for r in huge.collect()}[1] is None  # doesn't fit a long
