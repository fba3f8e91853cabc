"""N-gram Jaccard self-join by chosen paths.

Sets of word n-grams are split recursively.  At a node of the tree, shared
tokens are sampled: one or two coordinates of the sets' min-hash signatures,
1 / threshold of them on average, chosen by the node; sets that agree in a
coordinate go to the same child, so two sets that reach the threshold stay
together at least once per level in expectation.  A node with at most ``limit``
sets is compared by brute force, on the sets themselves; so is one that is
larger but dense (mostly mutual near copies, which no split would part), in
blocks, each pair of blocks once.  ``RUNS`` runs with other samples are made at
once, which suffices for trees of two levels; if the deepest node of all runs
lies deeper, as many more are made until a pair at the threshold is found with
probability ``recall`` at that depth.  (The formula takes samples for
independent; they are drawn from ``COORDINATES`` coordinates, so tests measure
recall against brute force as well.)

Work that is saved without losing a link: equal sets are one node with a weight;
nodes of different runs that hold the same candidates are compared once; a
comparison emits only links that join classes, never all pairs.  Classes are
the connected components, found by alternating star contractions.  As linked
sets are in one class, the numbers of links are then counted class by class, in
pairs of blocks, without emitting pairs.

Words are runs of letters, digits and underscores in lower case; a text of under
n words is one n-gram; a text without words (null, empty) has no set, no link,
and is its own class.  The class id is the class's smallest key; rows of equal
text and equal key are rows of their own; other columns are left out, so names
cannot clash.  Very long texts are read whole; a block holds at most ``block``
sets and about ``BLOCK_BYTES`` of them, and never less than one set.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Cache, checkpointed, small

COORDINATES = 64
SALTS = 4
#: Share of agreeing pairs from which a large node is compared in blocks and not split.
DENSE = 0.25
#: Columns of an incidence matrix, and sets in a block of a large node or class.
WIDTH = 1024
BLOCK = 2048
BLOCK_BYTES = 32 << 20
#: Runs that are made at once: enough for recall 0.999 at threshold 0.8 and two levels.
RUNS = 6
WORD = re.compile(r"\w+").findall
_rng = np.random.default_rng(20240229)
A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


_word = Cache(xxhash.xxh3_64_intdigest)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * P2
    x = (x ^ (x >> np.uint64(29))) * P1
    return x ^ (x >> np.uint64(32))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Distinct n-grams of a text as sorted unsigned 64-bit hashes."""
    words = WORD(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        grams = np.full(len(words) - k + 1, np.uint64(k))
        for i in range(k):
            grams = mix(grams * P1 + h[i : i + len(grams)])
    return np.unique(grams)


def signature(grams: np.ndarray) -> np.ndarray:
    """Min-hash per coordinate, as signed 32-bit integers."""
    least = np.full(COORDINATES, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 2048):
            np.minimum(least, (grams[at : at + 2048, None] * A).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def links(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of ``a`` and ``b`` reach the Jaccard threshold.

    Shared n-grams are counted exactly: those of many sets by a product of
    incidence matrices, those of few by adding up their own pairs.
    """
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(a) == 1 and len(b) == 1:
        shared = np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]], float)
    else:
        shared = np.zeros((len(a), len(b)), np.float32)
        va, vb = np.concatenate(a), np.concatenate(b)
        both = np.intersect1d(va, vb)
        sides = []
        for values, n in ((va, na), (vb, nb)):
            at = np.searchsorted(both, values)
            at[at == len(both)] = 0
            hit = both[at] == values if len(both) else np.zeros(len(values), bool)
            rows, cols = np.repeat(np.arange(len(n)), n)[hit], at[hit]
            order = np.argsort(cols, kind="stable")
            sides.append((rows[order], cols[order], np.bincount(cols, minlength=len(both))))
        (ra, ca, fa), (rb, cb, fb) = sides
        often = fa * fb > len(a) * len(b) / 200 + 4
        column = np.cumsum(often) - 1
        for start in range(0, int(often.sum()), WIDTH):
            parts = []
            for rows, cols, size in ((ra, ca, len(a)), (rb, cb, len(b))):
                here = often[cols] & (column[cols] >= start) & (column[cols] < start + WIDTH)
                matrix = np.zeros((size, WIDTH), np.float32)
                matrix[rows[here], column[cols[here]] - start] = 1
                parts.append(matrix)
            shared += parts[0] @ parts[1].T
        ea, eb = np.cumsum(fa), np.cumsum(fb)
        for g in np.flatnonzero(~often).tolist():
            shared[ra[ea[g] - fa[g] : ea[g]][:, None], rb[eb[g] - fb[g] : eb[g]]] += 1
    union = na[:, None] + nb[None, :] - shared
    return shared >= threshold * union - 1e-9


def _sets(df: DataFrame, text: str, n: int) -> DataFrame:
    """rid, set (its n-grams' upper 32 bits), its bytes and signature of each text with a word; once per partition and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in small(batches):
            out = []
            for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if rid in seen:
                    continue
                seen.add(rid)
                grams = ngram_set(t, n)
                if len(grams):
                    packed = np.unique((grams >> np.uint64(32)).astype("<u4")).tobytes()
                    out.append((rid, packed, len(packed), signature(grams)))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["rid", "grams", "size", "sig"])

    return df.select("rid", F.col(text).alias("t")).filter("rid is not null").mapInArrow(run, "rid long, grams binary, size long, sig array<int>")


def unpack(grams: bytes) -> np.ndarray:
    return np.frombuffer(grams, "<u4")


def grouped(df: DataFrame, by: list[str], each: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``each(key, rows)`` for every group, streamed over sorted partitions; ``df``: by + side, rid, grams.  Groups are bounded by the caller."""
    kinds = [pa.int64() if x.split()[1] == "long" else pa.int32() for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            out.clear()

        for b in small(batches):
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns):
                if row[: len(by)] != key:
                    if rows:
                        out += each(key, rows)
                    key, rows = row[: len(by)], []
                    if len(out) > 20_000:
                        yield from flush()
                rows.append(row[len(by) :])
        if rows:
            out += each(key, rows)
        if out:
            yield from flush()

    return df.repartition(*by).sortWithinPartitions(*by, "side", "rid").mapInArrow(run, schema)


def split_sides(rows: list[tuple], diagonal: bool) -> tuple[list[int], list[int], list[np.ndarray], list[np.ndarray]]:
    """Ids and sets of two blocks; of one block against itself on the diagonal."""
    left = [(r, g) for s, r, g in rows if s == 0]
    ids, grams = [r for r, _ in left], [unpack(g) for _, g in left]
    if diagonal:
        return ids, ids, grams, grams
    right = [(r, g) for s, r, g in rows if s == 1]
    return ids, [r for r, _ in right], grams, [unpack(g) for _, g in right]


def in_blocks(members: DataFrame, n, size, block: int) -> DataFrame:
    """Deal the sets of each group (of ``n`` sets and ``size`` bytes) to all pairs of its blocks: adds bi, bj, side."""
    blocks = F.ceil(F.greatest(n / F.lit(float(block)), size / F.lit(float(BLOCK_BYTES)), F.lit(1.0))).cast("int")
    own = F.pmod(F.xxhash64("rid", F.lit(11)), blocks).cast("int")
    pairs = members.withColumn("_n", blocks).withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return pairs.withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o")).withColumn("side", F.when(F.col("_b") > F.col("_o"), 1).otherwise(0)).drop("_n", "_b", "_o")


def components(edges: DataFrame) -> DataFrame:
    """(rid, root) of every rid that ``edges`` (a, b) name: alternating large-star and small-star steps until nothing changes."""
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = state(edges)
    while before[0]:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # b > a >= m
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpointed(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("rid"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("rid"), F.col("b").alias("root")).distinct())


def survival(threshold: float, depth: int) -> float:
    """Chance that two sets at the threshold share a node ``depth`` levels down, by the tree's branching."""
    second, p = 1 / threshold - 1, 1.0
    for _ in range(depth):
        p = 1 - (1 - threshold * p) * (1 - second * threshold * p)
    return p


def children(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (run, node, rid, size, sig) -> the next level's (run, node, rid, size)."""
    pick = lambda i, n: F.pmod(F.xxhash64("run", "node", F.lit(i)), F.lit(n)).cast("int")
    first, second, lucky = pick(1, COORDINATES), pick(2, COORDINATES), pick(3, 1000) < int(1000 * (1 / threshold - 1))
    at = F.when(lucky & (first != second), F.array(first, second)).otherwise(F.array(first))
    return rows.withColumn("c", F.explode(at)).select("run", F.xxhash64("run", "node", "c", F.element_at("sig", F.col("c") + 1)).alias("node"), "rid", "size")


NODE = ["run", "node", "rid", "n", "bytes"]


def _leaves(sigs: DataFrame, runs: range, threshold: float, limit: int, depth: int) -> tuple[DataFrame, int]:
    """Nodes to compare (run, node, rid, n, bytes), and the deepest level; ``sigs``: rid, size, sig.

    Large dense nodes of different runs and levels that hold the same near copies
    have the same core, the commonest values of three coordinates: they are put
    together by it and compared once.
    """
    # Numbers of sets are combined before the shuffle; nodes of one set go no further.
    of_node = (F.count("*").alias("n"), F.sum("size").alias("bytes"))
    level = children(sigs.withColumn("run", F.explode(F.array(*map(F.lit, runs)))).withColumn("node", F.lit(0).cast("long")), threshold)
    leaves, cores = [], []
    for d in range(1, depth + 1):
        sized = level.groupBy("run", "node").agg(*of_node).filter("n > 1")
        rows = checkpointed(level.join(sized, ["run", "node"]))
        big = rows.filter(F.col("n") > limit)
        if d == depth or big.isEmpty():
            leaves.append(rows.select(NODE))
            break
        leaves.append(rows.filter(F.col("n") <= limit).select(NODE))
        big = big.join(sigs.select("rid", "sig"), "rid").withColumn("v", F.slice("sig", 1, 3))
        joint = big.groupBy("run", "node", "n", "v").agg(F.count("*").alias("c"))
        # Share of pairs that agree in all three coordinates.
        stat = joint.groupBy("run", "node").agg((F.sum(F.col("c") * F.col("c")) / (F.max("n") * F.max("n"))).alias("density"), F.max(F.struct("c", "v")).alias("top"))
        stat = checkpointed(stat.select("run", "node", F.when(F.col("density") >= DENSE, F.xxhash64("top.v")).alias("core")))  # a row per large node
        big = big.join(stat, ["run", "node"])
        cores.append(big.filter("core is not null").select("core", "rid", "size"))
        level = children(big.filter("core is null").select("run", "node", "rid", "size", "sig"), threshold)
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    if cores:
        together = cores[0]
        for more in cores[1:]:
            together = together.union(more)
        together = checkpointed(together.distinct())
        sized = together.groupBy("core").agg(*of_node)
        out = out.union(together.join(sized, "core").select(F.lit(-1).alias("run"), F.col("core").alias("node"), "rid", "n", "bytes"))
    return out, d


def _spanning(rows: list[tuple], threshold: float, diagonal: bool) -> list[tuple[int, int]]:
    """Links of a node (or of two blocks of one) that join its sets: a star per class, so at most one fewer than the sets."""
    ids, others, a, b = split_sides(rows, diagonal)
    if not ids or not others or diagonal and len(ids) < 2:
        return []
    if diagonal and len(ids) == 2:
        return [(ids[0], ids[1])] if links(a[:1], b[1:], threshold)[0, 0] else []
    hit = links(a, b, threshold)
    return stars(ids, ids if diagonal else others, hit, hit if diagonal else hit.T)


def stars(ids: list[int], others: list[int], hit: np.ndarray, back: np.ndarray) -> list[tuple[int, int]]:
    """The classes of a link matrix as stars around their least id.  Rows are searched breadth first: the links are never listed."""
    out, one = [], ids is others
    rows = np.ones(len(ids), bool)
    cols = rows if one else np.ones(len(others), bool)
    for start in range(len(ids)):
        if not rows[start]:
            continue
        rows[start] = False
        mine, theirs, front = [start], [], np.array([start])
        while len(front):
            near = np.flatnonzero(hit[front].any(0) & cols)
            cols[near] = False
            if one:
                mine += near.tolist()
                front = near
            else:
                theirs += near.tolist()
                front = np.flatnonzero(back[near].any(0) & rows)
                rows[front] = False
                mine += front.tolist()
        members = {*(ids[i] for i in mine), *(others[j] for j in theirs)}
        least = min(members)
        out += [(least, i) for i in members if i != least]
    return out


def partnered(sig: np.ndarray, own: int, bound: float) -> list[int]:
    """Which signatures of a node agree with another in at least ``bound`` of the coordinates."""
    need, hit = bound * COORDINATES, np.zeros(len(sig), bool)
    for at in range(0, len(sig), own):
        agree = np.zeros((min(own, len(sig) - at), len(sig)), np.uint8)
        for c in range(COORDINATES):
            agree += sig[at : at + own, c][:, None] == sig[None, :, c]
        np.fill_diagonal(agree[:, at:], 0)
        hit[at : at + own] = (agree >= need).any(1)
    return np.flatnonzero(hit).tolist()


def _candidates(leaves: DataFrame, sigs: DataFrame, threshold: float, block: int) -> DataFrame:
    """(h, rid, n, bytes): sets that have a partner in their node by their signatures; nodes with the same candidates are one, and those of over ``block`` sets stay whole."""
    bound = threshold - 4 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    small_ = leaves.filter(F.col("n") <= block).join(sigs, "rid").select("run", "node", F.lit(0).alias("side"), "rid", F.struct("sig", "size").alias("x"))

    def each(key: tuple, rows: list[tuple]) -> list[tuple]:
        kept = partnered(np.array([x["sig"] for _, _, x in rows], np.int32), 256, bound)
        rids, size = [rows[i][1] for i in kept], sum(rows[i][2]["size"] for i in kept)
        h = xxhash.xxh3_64_intdigest(np.array(rids, "<i8").tobytes()) - (1 << 63)  # rows come sorted by rid
        return [(h, rid, len(kept), size) for rid in rids]

    kept = grouped(small_, ["run", "node"], each, "h long, rid long, n long, bytes long")
    return kept.union(leaves.filter(F.col("n") > block).select(F.xxhash64("run", "node").alias("h"), "rid", "n", "bytes")).distinct()


def _compare(leaves: DataFrame, sigs: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) within the nodes."""
    dealt = in_blocks(_candidates(leaves, sigs, threshold, block), F.col("n"), F.col("bytes"), block)
    with_sets = dealt.join(sets.select("rid", "grams"), "rid").select("h", "bi", "bj", "side", "rid", "grams")
    return grouped(with_sets, ["h", "bi", "bj"], lambda key, rows: _spanning(rows, threshold, key[-1] == key[-2]), "a long, b long")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, limit: int = BLOCK, depth: int = 5, block: int = BLOCK, count_links: bool = True) -> DataFrame:
    """One row per row of ``df``: key, class_id, class_size and (with ``count_links``) n_links, the other rows that reach the threshold."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.when(F.length(text) > 0, F.xxhash64(text)).alias("rid"))
    texts = df.select(F.when(F.length(text) > 0, F.xxhash64(text)).alias("rid"), text)
    # Sets stay where they are dealt by rid: the joins with them move ids alone.  Lost parts are computed again.
    sets = _sets(texts, text, n).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid").dropDuplicates(["rid"]).persist(StorageLevel.DISK_ONLY)
    sigs = sets.select("rid", "size", "sig").persist(StorageLevel.DISK_ONLY)
    sigs.count()  # fills both once; two stages that want them at one time would each make the sets
    nodes = checkpointed(rows.filter("rid is not null").groupBy("rid").agg(F.min("k").alias("first"), F.count("*").alias("weight")).join(sigs.select("rid", "size"), "rid"))

    edges, made, wanted, deepest = None, 0, RUNS, 0
    while made < wanted:
        leaves, level = _leaves(sigs, range(made, wanted), threshold, limit, depth)
        links_ = _compare(leaves, sigs, sets, threshold, block)
        edges = links_ if edges is None else checkpointed(edges).union(links_)
        deepest, made = max(deepest, level), wanted
        wanted = max(made, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, deepest)))) if threshold < 1 else made
    roots = components(edges)

    classes = checkpointed(nodes.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    per_class = classes.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("weight").alias("class_size"), F.count("*").alias("m"), F.sum("size").alias("bytes"))
    joined = classes.drop("size").join(per_class, "root")
    if count_links:
        counted = _count_links(joined.filter("m > 1").select("root", "rid", "m", "bytes", "weight"), sets, threshold, block)
        joined = joined.join(counted, "rid", "left").withColumn("n_links", F.col("weight") - 1 + F.coalesce("others", F.lit(0)))
    out = ["class_id", "class_size"] + ["n_links"] * count_links
    # A text may have any number of rows: they are dealt by text and salt.
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    dealt = joined.select("rid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), *out)
    alone = {"class_id": F.col("k"), "class_size": F.lit(1), "n_links": F.lit(0)}
    result = salted.join(dealt, ["rid", "salt"], "left").select(F.col("k").alias(key), *[F.coalesce(c, alone[c]).cast(dict(rows.dtypes)["k"] if c == "class_id" else "long").alias(c) for c in out])
    result = checkpointed(result)
    for kept in (sets, sigs):
        kept.unpersist()
    return result


def _count_links(members: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rid, others): rows of other sets that each set links to, by weight."""
    dealt = in_blocks(members, F.col("m"), F.col("bytes"), block).join(sets.select("rid", "grams"), "rid")
    weighted = dealt.select("root", "bi", "bj", "side", "rid", F.struct("weight", "grams").alias("grams"))

    def each(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        diagonal = key[-1] == key[-2]
        weight = {r: g["weight"] for _, r, g in rows}
        ids, others, a, b = split_sides([(s, r, g["grams"]) for s, r, g in rows], diagonal)
        if not ids or not others:
            return []
        wa, wb = np.array([weight[i] for i in ids]), np.array([weight[i] for i in others])
        if diagonal and len(ids) == 2:
            hit = links(a[:1], b[1:], threshold)[0, 0]
            return [(ids[0], int(hit * wb[1])), (ids[1], int(hit * wb[0]))]
        hit = links(a, b, threshold)
        if diagonal:
            np.fill_diagonal(hit, False)
            return list(zip(ids, (hit @ wb).tolist()))
        return [*zip(ids, (hit @ wb).tolist()), *zip(others, (hit.T @ wa).tolist())]

    return grouped(weighted, ["root", "bi", "bj"], each, "rid long, others long").groupBy("rid").agg(F.sum("others").alias("others"))
