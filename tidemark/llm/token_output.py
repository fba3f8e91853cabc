"""Token ids in binary files: Simple-8b words, with escapes and block offsets.

``tokenise`` gives ids by a file of the tokenizers library.  ``write`` sorts
documents by key and writes one file per range of keys; ``read`` gives every
document back.  A file is a row of segments of about a million ids, so that
writers and readers hold one segment at a time.  A segment is, little-endian:

    magic "S8B1", u32 number of documents, u64 number of ids, u64 number of words
    per document: i64 key, u64 end of its ids within the segment; the end's highest bit says that there is no key
    per block of 128 ids: u64 number of words before it
    the words

A 64-bit word holds a selector in its upper 4 bits and ids in its lower 60:
selector s packs COUNT[s] ids of WIDTH[s] bits.  Selector 0 is the escape: the
next word is one id of up to 64 bits.  Blocks begin on a word, so blocks encode
and decode side by side.

Defined results: a null text is empty and has its end id alone; documents with
equal keys, repeated rows among them, are ordered by their texts; null keys come
first and are read back as nulls; keys must be whole numbers, other types are
refused before any work.  A very long text is encoded whole and may make a
segment longer than a million ids.  Other columns are left out, so names cannot
clash; an empty table has no files.
"""

from __future__ import annotations

import struct
import sys
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small

BLOCK = 128
SEGMENT = 1 << 20
#: Rows of one key from which it may be cut into ranges.
HOT = 1000
#: Words that a worker remembers before it begins a new generation.
WORDS = 300_000
# Fixed values of the format: bits of an id and ids in a word, by selector.
WIDTH = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 17, 20, 30, 60])
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 3, 2, 1])
MAGIC = b"S8B1"
#: The least id that is too large for selector 1, 2, ...; a selector that packs twelve ids.
LIMITS = np.uint64(1) << WIDTH[1:].astype(np.uint64)
FEW = 5


def _selectors(flat: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
    """The first selector, from ``first`` on, that fits the ids at each place; 0 if none does."""
    most = np.maximum.accumulate(flat[at[:, None] + np.arange(COUNT[first])], axis=1)
    fit = most[:, COUNT[first:] - 1] < np.arange(first, 16)
    return np.where(fit.any(1), fit.argmax(1) + first, 0)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words before each block, words) of ids (unsigned 64-bit)."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK)
    # Per id the least selector less one that holds it (15: none but the escape); what lies behind a block fits nothing.
    least = np.full(blocks * BLOCK, 16, np.uint8)
    least[:n] = np.searchsorted(LIMITS, ids, side="right")
    rows = np.full((blocks, BLOCK + int(COUNT[1])), 16, np.uint8)
    rows[:, :BLOCK] = least.reshape(blocks, BLOCK)
    flat, begins = rows.ravel(), np.arange(blocks) * rows.shape[1]
    # All blocks walk their words in step; few ids fill a word if they are large, so few are looked at first.
    at, end = np.zeros(blocks, np.int64), np.minimum(n - np.arange(blocks) * BLOCK, BLOCK)
    live, steps = np.arange(blocks), []
    while len(live):
        here = begins[live] + at[live]
        sel = _selectors(flat, here, FEW)
        more = np.flatnonzero(sel == FEW)
        if len(more):
            sel[more] = _selectors(flat, here[more], 1)
        steps.append((live * BLOCK + at[live], sel))
        at[live] += COUNT[sel]
        live = live[at[live] < end[live]]
    begin, sel = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(begin)
    begin, sel = begin[order], sel[order]
    size = np.where(sel == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(16):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        if s == 0:
            words[place[mine] + 1] = ids[begin[mine]]
            continue
        word = np.full(len(mine), np.uint64(s) << np.uint64(60))
        for i in range(int(COUNT[s])):
            word |= ids[begin[mine] + i] << np.uint64(i * int(WIDTH[s]))
        words[place[mine]] = word
    first = np.searchsorted(begin, np.arange(blocks) * BLOCK)
    return place[first].astype(np.uint64), words


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of packed words."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    # An escaped id is no word: walk the blocks only if a word could be an escape.
    head = np.ones(len(words), bool)
    if (sel == 0).any():
        head = _heads(sel, offsets, len(words))
    begin = np.flatnonzero(head)
    count = COUNT[sel[begin]]
    place = np.cumsum(count) - count
    ids = np.zeros(n, np.uint64)
    for s in range(16):
        mine = sel[begin] == s
        if not mine.any():
            continue
        at, to = begin[mine], place[mine]
        if s == 0:
            ids[to] = words[at + 1]
            continue
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        for i in range(int(COUNT[s])):
            ids[to + i] = (words[at] >> np.uint64(i * int(WIDTH[s]))) & mask
    return ids


def _heads(sel: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    head = np.zeros(n, bool)
    at = offsets.astype(np.int64)
    end = np.append(at[1:], n)
    live = np.arange(len(at))
    while len(live):
        head[at[live]] = True
        at[live] += np.where(sel[at[live]] == 0, 2, 1)
        live = live[at[live] < end[live]]
    return head


def segment(keys: list[int | None], packed: list[bytes]) -> bytes:
    """One segment of documents' ids (each little-endian u32)."""
    ids = np.frombuffer(b"".join(packed), "<u4")
    offsets, words = pack(ids)
    table = np.empty(len(keys), [("key", "<i8"), ("end", "<u8")])
    table["key"], table["end"] = [k or 0 for k in keys], np.cumsum([len(p) // 4 for p in packed])
    table["end"] |= np.array([k is None for k in keys], "<u8") << np.uint64(63)
    return b"".join((MAGIC, struct.pack("<IQQ", len(keys), len(ids), len(words)), table.tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def segments(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """keys (masked where there is none), ends and ids of each segment of a file."""
    while head := stream.read(24):
        if len(head) < 24 or head[:4] != MAGIC:
            raise ValueError("not a file of packed ids")
        docs, n, n_words = struct.unpack_from("<IQQ", head, 4)
        blocks = -(-n // BLOCK)
        data = stream.read(16 * docs + 8 * (blocks + n_words))
        if len(data) < 16 * docs + 8 * (blocks + n_words):
            raise ValueError("the file ends within a segment")
        table = np.frombuffer(data, [("key", "<i8"), ("end", "<u8")], docs)
        offsets = np.frombuffer(data, "<u8", blocks, 16 * docs)
        words = np.frombuffer(data, "<u8", n_words, 16 * docs + 8 * blocks)
        ends = table["end"] & np.uint64((1 << 63) - 1)
        yield np.ma.array(table["key"], mask=table["end"] != ends), ends, unpack(words, offsets, n)


_loaded: dict = {}


def _byte_characters() -> list[str]:
    """Byte -> the character that byte-level vocabularies write it as: itself if it shows, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


#: Latin-1 bytes that the short way leaves to the library: controls and odd spaces, and numbers that aren't digits.
ODD = bytes(c for c in range(256) if c < 0x20 and c not in b"\t\n\r" or 0x7F <= c <= 0xA0 or c in b"\xb2\xb3\xb9\xbc\xbd\xbe")


def _tokenizer(path: str):
    """encode(texts) -> packed ids of each, as the library's encode(text, add_special_tokens=False).

    Where the file's pre-tokenizer begins with a removing, inverted split whose
    matches hold no white space, the words between white space are independent:
    each is encoded once by the library and remembered.  Texts with a special
    token's string or letters beyond Latin, and other files, go through the
    library whole.
    """
    if path not in _loaded:
        import json
        import unicodedata

        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        by_word = [x.get("type") for x in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and sys.byteorder == "little" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and normal == ["NFC", "Replace", "Lowercase"]
        whole = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        if by_word and "\\s" in steps[0]["pattern"]["Regex"]:
            split, tokenize, byte_chars = regex.compile(steps[0]["pattern"]["Regex"]).findall, tokenizer.model.tokenize, _byte_characters()

            recent: dict[str, bytes] = {}
            older: dict[str, bytes] = {}

            def merged(piece: str) -> bytes:
                # Behind the split the library writes a piece's bytes as characters and gives them to its model.
                chars = piece if piece.isascii() else "".join(map(byte_chars.__getitem__, piece.encode("utf-8")))
                return array("I", [t.id for t in tokenize(chars)]).tobytes()

            def packed_words(words: list[str]) -> list[bytes]:
                """Ids of each word, from two generations of at most ``WORDS`` remembered ones."""
                nonlocal recent, older
                out, known, before = [], recent.get, older.get
                for w in words:
                    ids = known(w)
                    if ids is None:
                        ids = before(w)
                        if ids is None:
                            body = w[:-1]
                            if w.isalpha():
                                ids = merged(w)
                            elif body.isalpha() and w[-1] in ".,;:!?":  # a run of letters, a mark: two pieces
                                ids = known(body) or before(body) or merged(body)
                                ids += known(w[-1]) or merged(w[-1])
                            else:
                                ids = b"".join([known(x) or merged(x) for x in split(w)])
                        if len(w) <= 48:
                            recent[w] = ids
                    out.append(ids)
                if len(recent) >= WORDS:
                    recent, older = {}, recent
                return out

            latin = regex.compile("[\\t\\n\\r\\x20-\\x7E\\xA1-\\xB1\\xB4-\\xB8\\xBA\\xBB\\xBF-\\u012F\\u0131-\\u02AF\\u1E00-\\u1EFF\\u2010-\\u2027\\u20A0-\\u20BF]*").fullmatch

            def easy(t: str) -> bool:
                try:
                    raw = t.encode("latin-1")
                    plain = len(raw.translate(None, ODD)) == len(raw)
                except UnicodeEncodeError:
                    plain = latin(t)
                return bool(plain) and not any(s in t for s in special)

            def encode(texts: list[str]) -> list[bytes]:
                """The texts' words are numbered in bulk, each different one is looked up once, and ids are gathered by number."""
                out = [None if easy(t) else whole(t) for t in texts]
                mine = [i for i, x in enumerate(out) if x is None]
                lists = pc.utf8_split_whitespace(pa.array([unicodedata.normalize("NFC", texts[i]).lower() for i in mine], pa.string()))
                numbered = lists.flatten().dictionary_encode()
                packed = packed_words(numbered.dictionary.to_pylist())
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                at, number = np.cumsum(sizes) - sizes, numbered.indices.to_numpy()
                each = sizes[number]
                ends = np.append(0, np.cumsum(each))
                ids = np.frombuffer(b"".join(packed), "<u4")[np.repeat(at[number] - ends[:-1], each) + np.arange(ends[-1])]
                cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if mine else []
                for j, i in enumerate(mine):
                    out[i] = ids[cuts[j] : cuts[j + 1]].tobytes()
                return out
        else:
            encode = lambda texts: list(map(whole, texts))
        _loaded[path] = encode
    return _loaded[path]


def write(df: DataFrame, key: str, text: str, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Tokenise and write the files of ids below ``path``; returns their list: file, part, docs, n_ids.

    The texts, not the ids, are dealt by range of keys: the sampling of the
    ranges then reads keys only, and each text is tokenised once.  Rows of one key
    are in the order of a hash of their texts; where a key stands on more rows than
    a range should have, ranges are cut by that hash as well.
    """
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"keys must be whole numbers; {key} is {dict(df.dtypes)[key]}")
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ranges = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most, every = rows.groupBy("k").count().agg(F.max("count"), F.sum("count")).first()
    by = ["k", "h"] if (most or 0) > max(HOT, (every or 0) / ranges) else ["k"]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    ranged = ranged.sortWithinPartitions("k", "h", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        encode, end = _tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name, partial = f"{folder}/part-{part:06d}.s8b", f"{folder}/.{uuid.uuid4().hex}.tmp"
        keys, packed, size, docs, n_ids = [], [], 0, 0, 0
        with store.open_output_stream(partial, compression=None) as out:
            for b in small(batches, 1000):
                for k, found in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                    keys.append(k)
                    packed.append(found + end)
                    size += len(packed[-1]) // 4
                    if size >= SEGMENT:
                        out.write(segment(keys, packed))
                        docs, n_ids = docs + len(keys), n_ids + size
                        keys, packed, size = [], [], 0
            if keys:
                out.write(segment(keys, packed))
                docs, n_ids = docs + len(keys), n_ids + size
        if not docs:
            store.delete_file(partial)
            return
        if store.get_file_info(name).type != fs.FileType.NotFound:  # an earlier attempt's, with the same ids
            store.delete_file(name)
        store.move(partial, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([n_ids], pa.int64())], ["file", "part", "docs", "n_ids"])

    return ranged.mapInArrow(run, "file string, part int, docs long, n_ids long")


def with_starts(files: DataFrame) -> DataFrame:
    """``files`` with ``file_start``: ids in the files before.  The window sees one short row per file."""
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("file_start", F.coalesce(before, F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """Documents of the files (columns file, file_start): key, start, n_tokens, ids (binary, little-endian u32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, where = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
                with store.open_input_stream(where, compression=None) as f:
                    for keys, ends, ids in segments(f):
                        flat = ids.astype("<u4").tobytes()
                        ends = ends.astype(np.int64)
                        begins = np.append(0, ends[:-1]).astype(np.int64)
                        packed = [flat[4 * x : 4 * y] for x, y in zip(begins.tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(keys.data, pa.int64(), mask=np.ma.getmaskarray(keys)), pa.array(begins + base), pa.array(ends - begins), pa.array(packed, pa.binary())], ["key", "start", "n_tokens", "ids"])
                        base += len(ids)

    return files.select("file", "file_start").mapInArrow(run, "key long, start long, n_tokens long, ids binary")
