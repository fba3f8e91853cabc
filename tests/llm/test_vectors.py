"""Hard negatives, exact top-k and whitening against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_topk, hard_negatives, registry, whitening
from tidemark.llm import vector_blocks as V
from tests import oracle

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, x int, id int, block int, rank int"


def table(spark, rows, parts=3):
    floats = lambda v: None if v is None else [None if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, floats(v), label, 1, 2, 3, 4) for i, v, label in rows], SCHEMA).repartition(parts)


def rows_of(seed, n, dim, size=1.0):
    rng = np.random.default_rng(seed)
    return [(i * 5, (rng.normal(size=dim) * size).round(2).tolist(), int(rng.integers(0, 3))) for i in range(n)]


#: Nulls everywhere, non-finite components, ties, copies of rows and ids, short and empty vectors.
ODD = rows_of(1, 120, 6) + [
    (None, [1.0] * 6, 1), (3, None, 1), (50, [None, 1.0, 0, 0, 0, 0], 1), (100, [NAN, 1.0, 0, 0, 0, 0], 1), (150, [INF, 1.0, 0, 0, 0, 0], 1), (1, [1.0] * 6, None), (50, [1.0, 2.0], 1), (50, [1.0, 2.0], 1),
    (7, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (11, [], 2), (150, [], 2), (-50, [0.0] * 6, 0), (2, [-3.0, 0.5, 0, 0, 0, 1.0], 0), (9, [1.0, 2.0, 0, 0, 0, 0], 0), (13, [0.6, 1.2, 0, 0, 0, 0], 0),
]


def quantised(rows, dim, with_label):
    found = []
    for i, v, label in rows:
        if i is None or v is None or (with_label and label is None) or any(c is None or not math.isfinite(c) for c in v):
            continue
        found.append((i, [math.floor(256 * c) for c in v] + [0] * (dim - len(v)), label))
    return found


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_negatives(rows, dim):
    v, out = quantised(rows, dim, True), []
    v = [(i, x, (label + 1) % 10 if i % 7 == 0 else label) for i, x, label in v]
    for a, (ai, ax, al) in enumerate(v):
        if ai % 50:
            continue
        scored = sorted(((-dot(ax, x), i, label) for c, (i, x, label) in enumerate(v) if c != a))
        for s, p, _ in [t for t in scored if t[2] == al][:5]:
            ps = -s
            hard = [t for t in scored if t[2] != al and 50 * ps <= -100 * t[0] <= 95 * ps][:3]
            out += [(ai, p, r, t[1], ps, -t[0]) for r, t in enumerate(hard, 1)]
    return sorted(out)


def brute_top(rows, dim):
    v, out = quantised(rows, dim, False), []
    for a, (ai, ax, _) in enumerate(v):
        if ai % 50 == 0:
            scored = sorted((-dot(ax, x), i) for c, (i, x, _) in enumerate(v) if c != a)
            out += [(ai, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
    return sorted(out)


def mined(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(df, moved).collect()))


def found(df):
    return sorted(map(tuple, exact_topk.search(df).collect()))


CASES = {"odd": (ODD, 6), "one row": ([(0, [1.0], 1)], 1), "equal rows": ([(i * 25, [0.5, 0.5], i % 2) for i in range(40)], 2), "wide": (rows_of(2, 60, 150), 150), "large": (rows_of(3, 60, 4, 50000.0), 4), "empty": ([], 1), "only empty vectors": ([(0, [], 1), (1, [], 1)], 1)}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_searches_as_brute_force(spark, monkeypatch, case, block_bytes):
    rows, dim = CASES[case]
    monkeypatch.setattr(V, "BLOCK_BYTES", block_bytes)
    df = table(spark, rows)
    assert mined(df) == brute_negatives(rows, dim)
    assert found(df) == brute_top(rows, dim)


def test_small_slices_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "CELLS", 64)
    monkeypatch.setattr(V, "QUERY_ROWS", 3)
    monkeypatch.setattr(exact_topk, "TOGETHER", 2)
    monkeypatch.setattr(exact_topk, "OPEN", 1)
    df = table(spark, ODD, 2)
    assert mined(df) == brute_negatives(ODD, 6)
    assert found(df) == brute_top(ODD, 6)


def test_scores_beyond_a_long_are_refused(spark):
    df = table(spark, [(0, [1e9], 1), (1, [1e9], 1)])
    for search in (mined, found):
        with pytest.raises(ValueError, match="do not fit a long"):
            search(df)


def test_residue_products_are_exact():
    rng = np.random.default_rng(4)
    for size, dim in ((100, 64), (40_000, 64), (1 << 27, 30), (1000, 500)):
        a, c = rng.integers(-size, size + 1, (7, dim)), rng.integers(-size, size + 1, (9, dim))
        a[0], c[0], c[1] = size, size, -size
        primes = hard_negatives.basis(dim * size**2)
        got = hard_negatives.product(hard_negatives.residues(a, primes), hard_negatives.residues(c, primes), primes)
        assert (got == a @ c.T).all()


def test_lists_stop_early_and_bounds_hold():
    rng = np.random.default_rng(5)
    ids = np.arange(4000)
    vecs = (rng.normal(size=(4000, 64)) * 30).astype("<i2")
    block = V.Block.__new__(V.Block)
    block.key, block.ids, block.vecs = 0, ids, vecs
    lists = exact_topk.Lists(block, np.argsort(vecs, axis=0, kind="stable").T.astype("<i4").tobytes(), np.float64)
    steps, read = [], lists.read
    lists.read = lambda at, end, seen: steps.append((at, end)) or read(at, end, seen)
    scores = vecs.astype(int) @ vecs[:20].astype(int).T
    for j in range(20):
        scores[j, j] = V.LOW
    want = [sorted(zip(-scores[:, j], ids))[:5] for j in range(20)]
    floor = np.array([-w[-1][0] for w in want])
    got = {j: list(zip(-s, p)) for j, p, s in lists.top(vecs[:20], np.arange(20), floor, 5)}
    assert [got[j] for j in range(20)] == want
    assert len(steps) < 2 * exact_topk.STEPS, "the lists were read to their end"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_exact_topk"])
def test_queries_as_sql(spark, sf, name):
    assert oracle.compare(spark, oracle.connect(sf), registry.QUERIES[name], registry.ORACLE[name], sf) == ""


def brute_whiten(rows):
    good = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(1, max(len(v) for _, v in good))
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (dim - len(v)) for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x)]
    c = np.array([[n * a - b for a, b in zip(r, s)] for r in x], float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in good], [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], c, values[::-1], vectors[:, ::-1], values.sum()


@pytest.mark.parametrize("case", ["table", "odd"])
@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_whitening_as_brute_force(spark, sf, monkeypatch, case, block_bytes):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block_bytes if case == "odd" else block_bytes * 64)
    rows = ODD if case == "odd" else [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>"), "label").collect()]
    got = (whitening.whiten(table(spark, rows)) if case == "odd" else registry.op13_whitening(spark, sf)).collect()
    ids, deviations, c, values, vectors, trace = brute_whiten(rows)
    k = min(8, c.shape[1])
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)}
    for comp in range(k):
        mine = [r for r in got if r["component"] == comp + 1]
        want = c @ vectors[:, comp] / np.sqrt(values[comp])
        assert all(math.isclose(r["explained"], values[comp] / trace, rel_tol=1e-9) and r["identity_error"] < 1e-9 for r in mine)
        sides = []
        for sign in (1, -1):  # either sign, the same for all rows
            a = sorted((str(r["vec_id"]), r["deviation"], round(r["whitened"], 5) + 0.0) for r in mine)
            b = sorted((str(i), d, round(float(sign * w), 5) + 0.0) for i, d, w in zip(ids, deviations, want))
            sides.append(all(p[:2] == q[:2] and abs(p[2] - q[2]) < 1e-4 for p, q in zip(a, b)))
        assert any(sides)


def test_whitening_without_variance(spark):
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0], 1)])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    flat = whitening.whiten(table(spark, [(i, [float(i), 3.0], 1) for i in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in flat)
    assert whitening.whiten(table(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [(1, None, 1)])).count() == 0


def test_a_deviation_beyond_a_long_is_null(spark):
    assert {r["deviation"] for r in whitening.whiten(table(spark, [(1, [4e9], 1), (2, [-4e9], 1)])).collect()} == {None}


def test_blocks_and_queries_meet_without_a_broadcast(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("label"), V.whole("embedding", 256).alias("x"))
    shape = V.Shape(rows)
    blocks = V.pack(rows, shape)
    queries = V.queries_of(blocks, 50, shape).withColumn("extra", F.array("id"))
    met = V.meet(blocks, V.pack_queries(queries, 40))
    assert met.count() == blocks.count() * V.pack_queries(queries, 40).count()
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
