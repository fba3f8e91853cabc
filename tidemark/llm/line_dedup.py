"""Line dedup by a log-template tree.

Lines are parsed down a tree of fixed depth.  The first level is the number of
tokens; below it a line takes the branch of its ``depth`` leading tokens or, if
that leaf does not recur, the wildcard branch for lines whose leading tokens vary,
by its ``depth`` last ones (three times as many for lines of ``LONG`` tokens or more: as two documents
suffice for these, leaves must not be met by chance).  Tokens with a digit are variable fields from the start (``<*>``).  The
lines that meet in a leaf make its templates: a token that at least as many of
the leaf's lines have at its position as documents are needed to recur is
constant there, every other token is generalised to a variable field, wherever
it stands.  A template with variable fields of that kind is one only if they are
at most a quarter of its tokens, and constants are two or more and at least
half.  A line is also a template as it is: with its digits masked if two
constants remain, else unmasked.  No template depends on the order of lines,
and there is no least length.

A template recurs if it stands in at least ``min_docs`` documents of different
content.  Copies and near copies of one document must not condemn all its
lines, so content is told by a sketch: ``COORDINATES`` min-hashes, a byte each,
over the runs of three words in a text's other lines.  Sketches that agree in
3/16 of their coordinates or more are of one content (of thousands of copies with
half of the runs in common hardly a pair falls below, while unrelated texts that
share some lines stay apart); a template's sketches are taken in one by one, each unless it is near
one taken in before, until there are ``min_docs``.  Runs of words do not
saturate as a vocabulary does, and how often a template repeats, or how many
copies stand beside the different documents, changes nothing.  A document whose
other lines hold less than half as many tokens as the line says too little of its
content and is no witness.  A line of
``LONG`` tokens or more is no chance match: it recurs in ``LONG_DOCS`` documents
as well, if their sketches agree in less than 1/16 (one pair decides, so no pair
of a large group of copies may be taken for different ones).  Lines of recurring
templates are dropped, all of them and in every document; every other line stays
in place.

Lines and leaves that too few texts hold are put aside first by counts that are
combined before the shuffle; tokens are fetched only for lines of leaves that
recur, once for each different line.

Defined results: a null text stays null; an empty text stays empty; a text all of
whose lines are dropped becomes empty; rows with null or repeated keys are
treated by their own text; a very long text or line is read whole (its sketches
hold one byte a line and coordinate).  Columns may have any name: ``n_lines`` and
``n_dropped`` are replaced, all others kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, chunks, small

DIGIT = re.compile(rb"[0-9]").search
MASK = b"<*>"
SALTS = 16
COORDINATES = 32
LONG, LONG_DOCS = 50, 2
_RANDOM = np.random.default_rng(4)
XORS = _RANDOM.integers(0, 1 << 32, (COORDINATES, 1), dtype=np.uint32)
FACTORS = _RANDOM.integers(0, 1 << 31, (COORDINATES, 1), dtype=np.uint32) << np.uint32(1) | np.uint32(1)
WORD_FACTORS = _RANDOM.integers(0, 1 << 63, 3, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def number(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def masked(line: bytes, tokens: list[bytes]) -> list[bytes]:
    """A line's tokens with variable fields masked."""
    return [MASK if DIGIT(t) else t for t in tokens] if DIGIT(line) else tokens


def line_key(line: bytes) -> tuple[int, list[bytes]]:
    """The number of a line's own template, and its masked tokens; a line of which the mask leaves less than two tokens is its own template unmasked."""
    raw = line.split()
    tokens = masked(line, raw)
    if tokens is raw or len(tokens) - tokens.count(MASK) >= 2:
        return number(b" ".join(tokens)), tokens
    return number(b"=" + b" ".join(raw)), tokens


def leaves(tokens: list[bytes], depth: int) -> list[int]:
    """The tree's leaves for a line: by count and leading tokens, and by count and last tokens; none if a quarter of its tokens is less than one."""
    if len(tokens) < 4:
        return []
    count = len(tokens)
    depth = depth if count < LONG else 3 * depth
    return [number(b"%d\x00%s" % (count, b" ".join(tokens[:depth]))) | 1, number(b"%d\x00*\x00%s" % (count, b" ".join(tokens[-depth:]))) & ~1]  # odd and even


#: Byte -> a random number, none for white space; powers that tell the places in a token apart (from the 1,025th on they repeat).
BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\r\x0b\x0c")] = True
POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))


def token_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number per token of the lines (none is empty), and the place of each line's first token."""
    text = np.frombuffer(b"\n".join(lines), np.uint8)
    blank = BLANK[text]
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    place = np.arange(len(text)) - np.repeat(begins, np.diff(np.append(begins, len(text)))) if begins[0] == 0 else None
    if place is None:  # white space before the first token
        place = np.concatenate((np.zeros(begins[0], np.int64), np.arange(begins[0], len(text)) - np.repeat(begins, np.diff(np.append(begins, len(text))))))
    values = BYTES[text] * POWERS[place & 1023]
    values[blank] = 0
    words = np.add.reduceat(values, begins)
    words ^= words >> np.uint64(31)
    at = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
    return words | np.uint64(1), np.searchsorted(begins, at)


def sketches(lines: list[bytes], cells: int = 1 << 22) -> list[bytes]:
    """Per line of a text (none is empty) the sketch of all the others; ``cells`` bounds what is held at once."""
    words, first = token_hashes(lines)
    n, line = len(lines), np.repeat(np.arange(len(lines)), np.diff(np.append(first, len(words))))
    w = np.zeros(len(words) + 2 * n + 2, np.uint64)  # no run crosses a line; a line's last runs are padded
    at = np.arange(len(words)) + 2 * line
    w[at] = words
    runs = words * WORD_FACTORS[0] + (w[at + 1] * WORD_FACTORS[1] ^ w[at + 2] * WORD_FACTORS[2])
    runs = ((runs ^ runs >> np.uint64(29)) >> np.uint64(16)).astype(np.uint32)
    out, step = np.empty((COORDINATES, n), np.uint8), max(1, cells // len(runs))
    none = np.iinfo(np.uint32).max
    for c in range(0, COORDINATES, step):
        least = np.minimum.reduceat((runs ^ XORS[c : c + step]) * FACTORS[c : c + step], first, axis=1)
        before, after = np.full_like(least, none), np.full_like(least, none)
        np.minimum.accumulate(least[:, :-1], axis=1, out=before[:, 1:])
        after[:, :-1] = np.minimum.accumulate(least[:, :0:-1], axis=1)[:, ::-1]
        out[c : c + step] = np.minimum(before, after) & np.uint32(255)
    flat = out.T.tobytes()
    return [flat[i : i + COORDINATES] for i in range(0, len(flat), COORDINATES)]


def agreement(a: bytes, b: bytes) -> int:
    """In how many coordinates two sketches agree."""
    return sum(map(eq, a, b))


def different_lines(data: bytes) -> list[bytes]:
    """The different lines of a text that hold a token, in order."""
    return [x for x in dict.fromkeys(data.split(b"\n")) if x and not x.isspace()]


def _lines(df: DataFrame, text: str, depth: int, min_docs: int) -> DataFrame:
    """Per different line of a text: digest of the text, documents the line needs to recur, sketch (null where the text is no witness), number of its template, leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out: list[tuple] = []
            for digest, data in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found = different_lines(data)
                if found:
                    keyed = list(map(line_key, found))
                    total = sum(len(tokens) for _, tokens in keyed)
                    for (key, tokens), sketch in zip(keyed, sketches(found)):
                        if 3 * len(tokens) > 2 * total:
                            sketch = None
                        out.append((digest, min(min_docs, LONG_DOCS) if len(tokens) >= LONG else min_docs, sketch, key, leaves(tokens, depth)))
            columns = zip(*out) if out else ((),) * 5
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["digest", "need", "sketch", "line", "leaves"])

    rows = df.filter(F.length(text) > 0).select(F.xxhash64(text).alias("digest"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "digest long, need int, sketch binary, line long, leaves array<long>")


def _tokens(wanted: DataFrame) -> DataFrame:
    """(line, tokens) of the wanted lines (t: text, lines: numbers): a number per token, 0 for a masked one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for data, lines in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                lines = set(lines)
                for line in different_lines(data):
                    key, tokens = line_key(line)
                    if key in lines:
                        lines.remove(key)
                        out.append((key, [0 if t == MASK else number(t) or 1 for t in tokens]))
            keys, tokens = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["line", "tokens"])

    return wanted.select("t", "lines").mapInArrow(run, "line long, tokens array<long>")


def _recurring(rows: DataFrame, min_docs: int) -> DataFrame:
    """(key) of ``rows`` (key, need, sketch) that stand in enough documents of different content."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes], bool]]:
        """Per key of a sorted partition at most ``min_docs`` sketches, none near another, and whether one is far from another."""
        last, needs, some, far = None, 0, [], False
        for b in batches:
            for key, need, sketch, *salt in zip(*(c.to_pylist() for c in b.columns)):
                if (key, salt) != last:
                    if some:
                        yield last[0], needs, some, far
                    last, needs, some, far = (key, salt), need, [], False
                if len(some) < min_docs:
                    same = [agreement(sketch, x) for x in some]
                    if 16 * max(same, default=0) < 3 * COORDINATES:
                        some.append(sketch)
                        far = far or 16 * min(same, default=COORDINATES) < COORDINATES
        if some:
            yield last[0], needs, some, far

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(((k, n, x) for k, n, some, _ in taken(batches) for x in some), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int32(), pa.binary()))], ["key", "need", "sketch"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks((k for k, n, some, far in taken(batches) if len(some) >= min_docs or len(some) >= n and far), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64())], ["key"])

    # A key may have any number of sketches: they are dealt by key and salt first, what each salt takes in comes together after.
    salt = F.pmod(F.xxhash64("sketch"), F.lit(SALTS))
    dealt = rows.filter("sketch is not null").select("key", "need", "sketch", salt.alias("salt")).repartition("key", "salt").sortWithinPartitions("key", "salt", "sketch")
    some = dealt.mapInArrow(first, "key long, need int, sketch binary")
    return some.repartition("key").sortWithinPartitions("key", "sketch").mapInArrow(second, "key long")


#: Places and tokens of a leaf's lines that a worker counts before it passes the counts on.
COUNTED = 100_000


def _templates(held: DataFrame, tokens: DataFrame) -> DataFrame:
    """(leaf, line, key): the template of each line in its leaf, where it generalises; ``held``: leaf, line, need, texts; ``tokens``: line, tokens.

    A leaf may have any number of lines: they are dealt by leaf and salt, a salt's
    tokens are counted before they move, and each salt is given the leaf's constants
    ahead of its lines, so that no line moves as one row a token.
    """
    salt = F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int").alias("salt")
    lines = checkpointed(held.join(tokens, "line").select("leaf", salt, F.lit(1).alias("side"), "line", "need", "texts", "tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def passed() -> pa.RecordBatch:
            leaf, need, at, token = zip(*seen)
            out = (pa.array(leaf, pa.int64()), pa.array(need, pa.int32()), pa.array(at, pa.int32()), pa.array(token, pa.int64()), pa.array(list(seen.values()), pa.int64()))
            seen.clear()
            return pa.RecordBatch.from_arrays(list(out), ["leaf", "need", "at", "token", "texts"])

        for b in small(batches):
            for leaf, need, texts, own in zip(*(b.column(n).to_pylist() for n in ("leaf", "need", "texts", "tokens"))):
                for at, token in enumerate(own):
                    if token:
                        seen[leaf, need, at, token] += texts
                if len(seen) > COUNTED:
                    yield passed()
        if seen:
            yield passed()

    dealt = lines.repartition("leaf", "salt")
    counted = dealt.sortWithinPartitions("leaf").mapInArrow(count, "leaf long, need int, at int, token long, texts long")
    constant = counted.groupBy("leaf", "need", "at", "token").agg(F.sum("texts").alias("texts")).filter("texts >= need")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    constant = constant.select("leaf", every, F.lit(0).alias("side"), F.lit(0).cast("long").alias("line"), F.array(F.col("at").cast("long"), "token").alias("tokens"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fixed = None, set()
        for b in small(batches):
            out = []
            for leaf, salt, side, line, own in zip(*(c.to_pylist() for c in b.columns)):
                if (leaf, salt) != group:
                    group, fixed = (leaf, salt), set()
                if side == 0:
                    fixed.add(tuple(own))
                    continue
                shape = [token if not token or (at, token) in fixed else -1 for at, token in enumerate(own)]
                n, masked, open_ = len(shape), shape.count(0), shape.count(-1)
                constants = n - masked - open_
                if 0 < 4 * open_ <= n and constants >= 2 and 2 * constants >= n:
                    out.append((leaf, line, number(np.array([leaf, *shape], "<i8").tobytes())))
            columns = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["leaf", "line", "key"])

    both = lines.select("leaf", "salt", "side", "line", "tokens").unionByName(constant)
    return both.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "side").mapInArrow(mark, "leaf long, line long, key long")


#: Lines whose numbers may be broadcast (some 16 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 500_000


def recurring(df: DataFrame, text: str, min_docs: int = 5, depth: int = 3) -> DataFrame:
    """(digest of a text, drop_keys: numbers of its recurring lines)."""
    lines = checkpointed(_lines(df, text, depth, min_docs))  # the texts are parsed once; 100 bytes or so a line
    keyed = lines.select(F.explode(F.concat(F.array("line"), "leaves")).alias("key"), "need", "sketch", "digest", "line")
    # Lines and leaves that the texts of one digest or too few texts hold recur in no way; all of a key need the same.
    witness = F.when(F.col("sketch").isNotNull(), F.col("digest"))
    several = keyed.groupBy("key").agg(F.count("sketch").alias("n"), F.first("need").alias("need"), F.min(witness).alias("lo"), F.max(witness).alias("hi")).filter("n >= need and lo < hi").select("key")
    held = checkpointed(keyed.join(several, "key", "left_semi"))
    held = held.join(_recurring(held, min_docs), "key", "left_semi")
    held = checkpointed(held.groupBy("digest", "line").agg(F.first("need").alias("need"), F.first("sketch").alias("sketch"), F.collect_set("key").alias("keys")))
    itself = F.array_contains("keys", F.col("line"))
    found = held.filter(itself).select("digest", "line")
    # What is left to generalise: lines that do not recur as they are, in the leading leaf if it recurs, else in the other.
    leading = F.filter("keys", lambda k: k.bitwiseAND(1) == 1)
    open_ = held.filter(~itself).select(F.coalesce(F.get(leading, 0), F.get("keys", 0)).alias("leaf"), "line", "need", "sketch", "digest")
    wanted = checkpointed(open_.groupBy("line").agg(F.min("digest").alias("digest")).groupBy("digest").agg(F.collect_list("line").alias("lines")))
    size = wanted.agg(F.sum(F.size("lines"))).first()[0]
    if size:
        texts = df.filter(F.length(text) > 0).select(F.xxhash64(text).alias("digest"), F.col(text).alias("t"))
        tokens = _tokens(texts.join(F.broadcast(wanted) if size <= BROADCAST_LINES else wanted, "digest"))
        tokens = checkpointed(tokens.dropDuplicates(["line"]))  # copies of a text give the same
        made = checkpointed(_templates(open_.groupBy("leaf", "line", "need").agg(F.count("*").alias("texts")), tokens))
        open_ = checkpointed(open_.join(made, ["leaf", "line"]).select("key", "need", "sketch", "digest", "line"))
        found = found.union(open_.join(_recurring(open_, min_docs), "key", "left_semi").select("digest", "line"))
    return found.groupBy("digest").agg(F.collect_set("line").alias("drop_keys"))


def dedup(df: DataFrame, text: str = "text", min_docs: int = 5, depth: int = 3) -> DataFrame:
    """``df`` with ``text`` without its recurring lines, and ``n_lines``, ``n_dropped`` (clashing names are replaced)."""
    names = [n for n in df.columns if n not in ("n_lines", "n_dropped")]
    own = [f"c{i}" for i in range(len(names))]  # no name of the table can clash within
    kinds, at = dict(df.dtypes), names.index(text)
    rows = df.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, own)])
    drops = recurring(rows, own[at], min_docs, depth)

    fields = ", ".join(f"{c} {kinds[n]}" for n, c in zip(names, own))
    # A text may have any number of copies: its rows are dealt by digest and salt.
    digest = F.when(F.length(own[at]) > 0, F.xxhash64(own[at]))
    rows = rows.withColumn("digest", digest).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    drops = drops.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = rows.join(drops, ["digest", "salt"], "left").select(*own, "drop_keys")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts, n, gone = [], [], []
            for data, keys in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(own)).to_pylist()):
                n.append(data.count(b"\n") + 1 if data else 0)
                if keys:
                    bad = set(keys)
                    kept = [x for x in data.split(b"\n") if not x or x.isspace() or line_key(x)[0] not in bad]
                    gone.append(n[-1] - len(kept))
                    texts.append(b"\n".join(kept))
                else:
                    gone.append(0)
                    texts.append(data)
            columns = list(b.columns[: len(own)])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*own, "n_lines", "n_dropped"])

    out = joined.mapInArrow(remove, f"{fields}, n_lines long, n_dropped long")
    return out.select(*[F.col(c).alias(n) for n, c in zip(names, own)], "n_lines", "n_dropped")
