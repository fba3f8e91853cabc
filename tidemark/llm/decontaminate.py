"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item's patterns are its windows of ``window`` consecutive words (an
item of fewer words is one window).  Per pattern length m, blocks of two words
index a shift table: a block that ends no pattern within its first m words lets
the search skip m - 1 words; a block at distance d from a pattern's end lets it
skip d; at shift 0 the hash of the words before selects the patterns, and a
direct comparison confirms the occurrence.  All of it lies in arrays.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z is lower-cased;
over UTF-8 that is a table of bytes.

The patterns go to the executors in blocks of at most ``block_bytes`` of text,
which take some fifteen times that in a worker; a larger benchmark takes several passes over the documents, whose hits are united by
document.  Null texts have no words; a document row keeps its row even where
its key is null or repeated; items with the same text all count; an item without an id has no
name to count in ``hit_items``, though its words are hit; an empty
benchmark hits nothing; very long texts are searched whole.  Columns named
``n_words``, ``hits`` and ``hit_items`` are replaced, all others kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, checkpointed, small

#: Byte -> itself in a word (A-Z lower-cased), else a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Hashes of words are combined by this factor, modulo 2^64.
MIX, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def words(data: bytes | None) -> list[bytes]:
    return data.translate(WORD_BYTES).split() if data else []


class WuManber:
    """Patterns of one length m as arrays: a shift table, and the windows sorted by hash.

    A pattern is known by its item and first word; what it holds is read from the
    item's words, so a window costs some 20 bytes whatever its words.  The shift
    table has four places a window at least, and blocks that share a place share
    the smaller shift, which only costs a comparison.
    """

    def __init__(self, length: int, items: list[list[bytes]], numbers: list[int]):
        self.length, self.block, self.items, self.numbers = length, min(2, length), items, numbers
        sizes = np.array([len(w) for w in items])
        h = np.fromiter((hash(w) for words in items for w in words), np.int64, int(sizes.sum())).view(np.uint64)
        item = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
        place = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        starts = np.flatnonzero(place + length <= sizes[item])
        size = 1 << max(10, (4 * len(starts)).bit_length())
        self.mask = size - 1
        with np.errstate(over="ignore"):
            signed = h.view(np.int64)
            blocks = signed if self.block == 1 else np.append((signed[:-1] >> 7) ^ signed[1:], signed[-1:])  # by first word
            at = blocks & self.mask
            table = np.full(size, min(255, length - self.block + 1), np.uint8)
            for end in range(self.block, length + 1):  # the nearer to the pattern's end, the later written
                table[at[starts + end - self.block]] = min(255, length - end)
            key = np.zeros(len(starts), np.uint64)
            for i in range(length):
                key = key * np.uint64(MIX) + h[starts + i]
        order = np.argsort(key, kind="stable")
        self.shift, self.keys, self.item, self.place = table.tobytes(), key[order], item[starts[order]], place[starts[order]]

    def owners(self, found: list[bytes]) -> set[int]:
        """Items that hold these words: those of equal hash, each compared word by word."""
        key = 0
        for w in found:
            key = (key * MIX + hash(w)) & ALL
        own, i = set(), int(np.searchsorted(self.keys, np.uint64(key)))
        while i < len(self.keys) and int(self.keys[i]) == key:
            item, place = int(self.item[i]), int(self.place[i])
            if self.items[item][place : place + self.length] == found:
                own.add(self.numbers[item])
            i += 1
        return own

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, owners) of each occurrence."""
        m, shift, mask = self.length, self.shift, self.mask
        i, n, pair = m, len(text), self.block == 2
        while i <= n:
            s = shift[((hash(text[i - 2]) >> 7) ^ hash(text[i - 1]) if pair else hash(text[i - 1])) & mask]
            if s:
                i += s
                continue
            if owners := self.owners(text[i - m : i]):
                yield i - m, owners
            i += 1


def build(items: list[tuple[int, bytes]], window: int) -> list[WuManber]:
    """Tables by pattern length; ``items``: number and text.  Equal words are one string."""
    known: dict[bytes, bytes] = {}
    by_length: dict[int, tuple[list, list]] = {}
    for number, data in items:
        found = [known.setdefault(w, w) for w in words(data)]
        if found:
            held, numbers = by_length.setdefault(min(window, len(found)), ([], []))
            held.append(found)
            numbers.append(number)
    return [WuManber(m, *held) for m, held in by_length.items()]


def scan(text: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged [start, stop) ranges of hit words, and the owners."""
    ranges, owners = [], set()
    for table in tables:
        for at, own in table.search(text):
            ranges.append((at, at + table.length))
            owners |= own
    ranges.sort()
    merged: list[tuple[int, int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged, owners


def item_blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> list[DataFrame]:
    """Parts of ``items`` of about ``block_bytes`` of text; one part if it is no larger."""
    total = items.agg(F.coalesce(F.sum(F.octet_length(text) + 16), F.lit(0))).first()[0]
    n = -(-total // block_bytes) or 1
    return [items.filter(F.pmod(F.xxhash64(key, text), F.lit(n)) == i) for i in range(n)]


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (ranges of hit words) and ``hit_items`` (ids as strings, sorted)."""
    docs = docs.drop("n_words", "hits", "hit_items")
    blocks = item_blocks(items.select(F.col(item_key).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")), "i", "t", block_bytes)
    if len(blocks) == 1:
        return _pass(docs, text, blocks[0], window)
    # A row number joins the passes, so that repeated keys stay apart; rows are numbered once, texts joined once.
    row = "_row"
    while row in docs.columns:
        row += "_"
    docs = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    more = None
    for block in blocks[1:]:
        one = _pass(docs.select(row, text), text, block, window).filter(F.size("hits") > 0).select(row, "hits", "hit_items")
        more = one if more is None else more.union(one)
    more = more.groupBy(row).agg(F.flatten(F.collect_list("hits")).alias("h2"), F.flatten(F.collect_list("hit_items")).alias("i2"))  # at most one of each per block
    out = _pass(docs, text, blocks[0], window).join(more, row, "left")
    hits, owners = F.concat("hits", F.coalesce("h2", F.slice("hits", 1, 0))), F.concat("hit_items", F.coalesce("i2", F.slice("hit_items", 1, 0)))
    position = F.array_distinct(F.flatten(F.transform(hits, lambda r: F.sequence(r["a"], r["b"] - 1))))
    ranges = F.transform(position, lambda p: F.struct(p.alias("a"), (p + 1).alias("b")))
    return out.withColumn("hits", ranges).withColumn("hit_items", F.array_sort(F.array_distinct(owners))).drop(row, "h2", "i2")


_built: dict = {}


def _pass(docs: DataFrame, text: str, items: DataFrame, window: int) -> DataFrame:
    rows = [(r["i"], r["t"].encode()) for r in items.collect()]  # at most block_bytes
    names = [r[0] for r in rows]
    tables = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(i, t) for i, (_, t) in enumerate(rows)], names, window))
    columns = docs.columns
    fields = "".join(f"`{n}` {t}, " for n, t in docs.dtypes)
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, items, names, window = tables.value
        if token not in _built:  # once per worker; tables of an earlier pass go
            _built.clear()
            _built[token] = build(items, window)
        for b in small(batches):
            n, hits, owners = [], [], []
            for data in as_bytes(b.column(columns.index(text))).to_pylist():
                found = words(data)
                ranges, own = scan(found, _built[token])
                n.append(len(found))
                hits.append([{"a": x, "b": y} for x, y in ranges])
                owners.append(sorted({names[i] for i in own if names[i] is not None}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(hits, kind), pa.array(owners, pa.list_(pa.string()))], [*columns, "n_words", "hits", "hit_items"])

    return docs.mapInArrow(run, f"{fields}n_words long, hits array<struct<a:int,b:int>>, hit_items array<string>")


def n_hit():
    """Words within the ranges of ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
