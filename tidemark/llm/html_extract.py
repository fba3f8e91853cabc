"""Main text of HTML pages: the host's suffix array tells what repeats, the markup checks its verdict.

A page is read as blocks of text, each inside or outside an article (``article``,
``main``, ``role="main"``); menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts and styles are left out by element, role, class and id.
A class or id counts only if all of its parts name such a thing ("cookie-notice",
"share_buttons"): "share-price" and "search-for-truth" are article text.

* The token streams of all pages of a host, blocks inside and outside of articles
  in page order, make up its suffix array.  Substrings of at least ``run`` tokens
  that occur on ``min_pages`` or more different pages are the repeated ones: the
  intervals of the array in which neighbours share ``run`` tokens.  Pages with
  equal streams count once: copies of a whole page don't erase each other.
* Only what can lie in an interval is dealt.  Of each run the least of its
  pieces of half its length is dealt first: equal runs have equal least pieces,
  so the runs around a piece that only one page has repeat nowhere.  The runs
  left are dealt by their whole key, and those on ``min_pages`` streams go back
  to their pages.  A page's text moves once, by its stream; copies of a stream
  are spread over ``SALTS`` places, and a host over all tasks.
* The verdict: what repeats goes, unique runs stay.  In pages without an article,
  also those whose only article is empty or left out, it stands.  Where there is
  an article, it is checked against that: an article's blocks come back, since two
  pages may hold the same one, and blocks outside go, since one page alone may
  have an advert.  ``repeated`` names a column for the words in repeated runs.

Defined results: a null or empty page, or one without text, gives an empty text;
a null url is a host of its own; character references are decoded; white space in
a block is one space; blocks are joined by one newline in page order; repeated
rows stay; a tag or comment that is cut off at the page's end is left out; a very long page is read whole by one task.  Other columns may have
any name; ``out`` and ``repeated`` are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small

#: A comment, a tag (its quoted values whole; where quotes don't pair, up to the next >) or a declaration.  The atomic group is never tried another way.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([/]?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?=>)|[^>]*)>|<[!?][^>]*>", re.S)
CUT = re.compile(r"<[a-zA-Z/!?]")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "xmp", "iframe", "noembed", "noframes")}
# Elements without an end tag; elements that end a block; elements that aren't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav header footer aside form script style title textarea noscript iframe noembed noframes xmp svg math canvas object audio video button select template dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus respond replies reply share sharing social related recommended widget search toolbar skip pagination pager".split()
)
#: Parts of a class or id that say nothing by themselves.
PLAIN = frozenset("site page post article main top bottom left right inner outer wrap wrapper box block container content section area list item items links link button buttons bar row col column group unit slot form panel icons icon the of and to my js id".split())
SALTS = 8
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")


def names_one_of(names: frozenset, value: str) -> bool:
    """Whether a class or id is made of ``names`` and plain words alone, with one of ``names`` at least."""
    for one in value.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", one) if x]
        if not names.isdisjoint(parts) and all(x in names or x in NAMES or x in PLAIN for x in parts):
            return True
    return False


def unwanted(tag: str, raw: str) -> bool:
    if tag in DROPPED:
        return True
    if not raw.strip():
        return False
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and names_one_of(NAMES, value):
            return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


#: Names that make an ``article`` or ``main`` something else; a layout's "has-sidebar" doesn't.
OTHER_ARTICLES = frozenset("comment comments commentlist reply replies related recommended teaser ad ads advert sponsored promo".split())


def other_article(raw: str) -> bool:
    return any(n.lower() in ("class", "id") and names_one_of(OTHER_ARTICLES, v.strip("\"'")) for n, v in ATTRIBUTE.findall(raw))


def is_article(tag: str, raw: str) -> bool:
    return tag in ("article", "main") or "main" in raw and bool(re.search(r"role\s*=\s*[\"']?main\b", raw, re.I))


def marked_blocks(page: str) -> list[tuple[bool, str]]:
    """Blocks in page order, each with whether it is inside an article."""
    found: list[tuple[bool, str]] = []
    inside = False  # whether any block is
    parts: list[str] = []
    open_articles: list[list] = []  # [tag, nested elements of its name]
    skipped, depth = "", 0  # name of the dropped element we are in, and how deep in others of its name
    at, last = 0, page.rfind(">") + 1  # no tag ends behind; one that begins there was cut off and goes
    cut = CUT.search(page, last)
    n = cut.start() if cut else len(page)

    def flush() -> None:
        nonlocal inside
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((bool(open_articles), text))
                inside = inside or bool(open_articles)
            parts.clear()

    while at < n:
        m = TOKEN.search(page, at, last) if at < last else None
        stop = m.start() if m else n
        if stop > at and not skipped:
            parts.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            if at == last and page.startswith("<!--", m.start()) and not page.endswith("-->", m.start(), at):
                break  # a comment that never ends
            continue
        closing, tag, raw = m[1], m[2].lower(), m[3]
        begins = not closing and tag in ("article", "main") and not open_articles and not other_article(raw)
        if skipped and not (begins and not inside):
            if not closing and tag in RAW:
                end = RAW[tag].search(page, at)
                at = end.end() if end else n
            elif tag == skipped:
                depth += -1 if closing else 0 if raw.endswith("/") else 1
                if not depth:
                    skipped = ""
            elif closing and open_articles and tag == open_articles[-1][0]:
                skipped = ""  # an element that never ended: the article's end ends it
                flush()
                open_articles.pop()
            elif tag == "body" and skipped == "head":
                skipped = ""
            continue
        skipped = ""
        if closing:
            if tag in BLOCKS:
                flush()
            if open_articles and tag == open_articles[-1][0]:
                open_articles[-1][1] -= 1
                if not open_articles[-1][1]:
                    flush()
                    open_articles.pop()
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if other_article(raw) if tag in ("article", "main") else tag not in ("body", "html") and unwanted(tag, raw):
            flush()
            if tag not in VOID and not raw.endswith("/"):
                skipped, depth = tag, 1
            continue
        if tag in BLOCKS:
            flush()
        if tag not in VOID:
            if is_article(tag, raw) and not open_articles and tag not in ("body", "html"):
                flush()
                open_articles.append([tag, 1])
            elif open_articles and tag == open_articles[-1][0]:
                open_articles[-1][1] += 1
    flush()
    return found


def blocks(page: str) -> tuple[list[str], list[str]]:
    """Blocks in an article and outside of any, each in page order."""
    found = marked_blocks(page)
    return [x for inside, x in found if inside], [x for inside, x in found if not inside]


def text_of(page: str | None) -> str:
    """Text of a page that has an article; without one, all blocks."""
    inside, outside = blocks(page or "")
    return "\n".join(inside or outside)


def extract(df: DataFrame, html: str = "html", url: str = "url", out: str = "text", run: int = 8, min_pages: int = 2, repeated: str | None = None) -> DataFrame:
    """``df`` without ``html``, with ``out`` and, if named, ``repeated``."""
    keep = [n for n in df.columns if n not in (html, out, repeated)]
    kinds = dict(df.dtypes)
    own = [f"c{i}" for i in range(len(keep))]  # no name of the table can clash within
    plain = [F.col(f"`{n}`") for n in keep if not re.search("map<|variant", kinds[n])]  # what a hash takes
    salt = F.pmod(F.xxhash64(*plain), F.lit(SALTS)) if plain else F.lit(0).cast("long")
    rows = df.select(F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("h"), host(url).alias("host"), salt.alias("salt"), *[F.col(f"`{n}`").alias(c) for n, c in zip(keep, own)])
    fields = "".join(f", {c} {kinds[n]}" for n, c in zip(keep, own))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [marked_blocks(h) for h in b.column(0).to_pylist()]
            ids = np.array([stream_id(h, s, x) for h, s, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), found)], np.int64)
            yield pa.RecordBatch.from_arrays([place(ids), pa.array(ids), b.column(1), pa.array([pack(x) for x in found], pa.binary()), *b.columns[3:]], ["place", "id", "host", "page", *own])

    texts = rows.mapInArrow(parse, f"place int, id long, host string, page binary{fields}").repartition("place")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            seen = set()
            for i, h, page in ((i, h, p) for b in small(batches) for i, h, p in zip(*(b.column(n).to_pylist() for n in ("id", "host", "page")))):
                if i not in seen:  # copies of a stream meet here
                    seen.add(i)
                    yield i >> 32, np.unique(keys_of(h, unpack(page), run)[1] >> SHORT)

        yield from dealt(each(), np.int32)

    likely = met(texts.mapInArrow(pieces, DEALT), np.int32, min_pages, lambda ids: np.arange(len(ids)))
    likely = likely.groupBy("id").agg(F.collect_list("keys").alias("keys")).select(F.col("id").cast("int").alias("place"), "keys")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            seen = set()
            for i, h, page, keys in ((i, h, p, k) for b in small(batches) for i, h, p, k in zip(*(b.column(n).to_pylist() for n in ("id", "host", "page", "keys")))):
                if keys and i not in seen:
                    seen.add(i)
                    whole, least = keys_of(h, unpack(page), run)
                    yield i, np.unique(whole[np.isin(least >> SHORT, np.frombuffer(b"".join(keys), np.uint64))])

        yield from dealt(each(), np.int64)

    # Salted copies of a stream are one stream.
    again = met(texts.join(likely, "place", "left").mapInArrow(runs, DEALT), np.int64, min_pages, lambda ids: ids & STREAM)
    again = again.groupBy(F.shiftright("id", 32).cast("int").alias("place")).agg(F.collect_list(F.struct("id", "keys")).alias("verdict"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = []
            for i, h, page, verdict in zip(*(b.column(n).to_pylist() for n in ("id", "host", "page", "verdict"))):
                lines = unpack(page)
                mine = [v["keys"] for v in verdict or () if v["id"] == i]
                covered = np.flatnonzero(np.isin(keys_of(h, lines, run)[0], np.frombuffer(b"".join(mine), np.uint64))) if mine else np.zeros(0, np.int64)
                found.append((checked(lines, covered, run), n_covered(covered, run)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], [*own, "text", "repeated"])

    done = texts.join(again, "place", "left").mapInArrow(decide, f"{fields[2:]}{', ' if own else ''}text string, repeated long")
    return done.select(*[F.col(c).alias(n) for n, c in zip(keep, own)], F.col("text").alias(out), *([F.col("repeated").alias(repeated)] if repeated else []))


def host(url):
    """Host of a url column, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: A stream's id: its place among copies in the first 3 bits, a digest of host and text in the others.
STREAM = (1 << 61) - 1
#: Rows that deal keys: a bucket (a key's first 6 bits), ids, how many keys each of them has here, and the keys.
DEALT = "bucket int, ids binary, counts binary, keys binary"
BUCKETS = 6
#: Bits that are cut off a piece's key: a piece only has to tell where runs may repeat.
SHORT = np.uint64(26)
#: Keys that a task deals in one row a bucket, or looks through at once.
AT_ONCE = 1 << 20
FACTORS = np.random.default_rng(9).integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: A number for each byte, and the base of a token's number, which counts bytes by their place in it.
BYTES = np.random.default_rng(8).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)
POWERS, INVERSES = (np.cumprod(np.full(1 << 16, x, np.uint64)) for x in (BASE, INVERSE))


def stream_id(host: str, salt: int, found: list[tuple[bool, str]]) -> int:
    text = "\n".join([host, *(x for _, x in found)])
    return (salt - SALTS // 2 << 61) + (int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little") & STREAM)


def place(ids: np.ndarray) -> pa.Array:
    """What rows are dealt by: the first half of a stream's id."""
    return pa.array((ids >> 32).astype(np.int32))


def pack(found: list[tuple[bool, str]]) -> bytes:
    """Blocks as a row moves them."""
    plain = "\n".join(f"{inside:d}{x}" for inside, x in found).encode()
    return len(plain).to_bytes(4, "little") + pa.Codec("zstd", compression_level=6).compress(plain, asbytes=True)


def unpack(page: bytes) -> list[tuple[bool, str]]:
    size = int.from_bytes(page[:4], "little")
    return [(x[0] == "1", x[1:]) for x in pa.decompress(page[4:], size, codec="zstd", asbytes=True).decode().split("\n")] if size else []


def tokens(found: list[tuple[bool, str]]) -> np.ndarray:
    """A number for each word of the blocks."""
    text = np.frombuffer(" ".join(x for _, x in found).encode(), np.uint8)
    if not len(text):
        return np.zeros(0, np.uint64)
    up, down = (POWERS, INVERSES) if len(text) < len(POWERS) else (np.cumprod(np.full(len(text) + 1, x, np.uint64)) for x in (BASE, INVERSE))
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(BYTES[text] * up[: len(text)], out=total[1:])
    gaps = np.flatnonzero(text == 32)
    begins, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(text)]])
    x = (total[ends] - total[begins]) * down[begins]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def mixed(each: np.ndarray, n: int, start: np.uint64) -> np.ndarray:
    """A number for each ``n`` tokens in a row."""
    size = max(0, len(each) - n + 1)
    x = np.full(size, start, np.uint64)
    for j in range(n):
        x += each[j : j + size] * FACTORS[j % len(FACTORS)]
        if j % len(FACTORS) == len(FACTORS) - 1:
            x ^= x >> np.uint64(29)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def keys_of(host: str, found: list[tuple[bool, str]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of at least ``run`` tokens: a number for its host and first ``run`` tokens, and the least of their pieces' numbers."""
    start = np.uint64(int.from_bytes(hashlib.blake2b(host.encode(), digest_size=8).digest(), "little"))
    each, n = tokens(found), max(1, run // 2)
    whole = mixed(each, run, start)
    piece = mixed(each, n, start)
    least = piece[: len(whole)].copy()
    for j in range(1, run - n + 1):
        np.minimum(least, piece[j : j + len(whole)], out=least)
    return whole, least


def dealt(each: Iterator[tuple[int, np.ndarray]], kind: type) -> Iterator[pa.RecordBatch]:
    """(id, keys) as rows of ``DEALT``, ids of type ``kind``."""

    def rows(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        wide = 64 - int(SHORT) if kind is np.int32 else 64
        keys = np.concatenate([k for _, k in held])
        owner = np.repeat(np.arange(len(held)), [len(k) for _, k in held])
        ids = np.array([i for i, _ in held], kind)
        order = np.argsort(keys >> np.uint64(wide - BUCKETS), kind="stable")
        keys, owner = keys[order], owner[order]
        ends = np.searchsorted(keys >> np.uint64(wide - BUCKETS), np.arange(2**BUCKETS + 1))
        out = []
        for x, (a, z) in enumerate(zip(ends, ends[1:])):
            if a < z:
                first = np.flatnonzero(np.diff(owner[a:z], prepend=-1))
                counts = np.diff(first, append=z - a).astype(np.uint32)
                low = keys[a:z].astype(np.uint32) if kind is np.int32 else keys[a:z]
                out.append((x, ids[owner[a:z][first]].tobytes(), pa.compress(counts.tobytes(), codec="zstd", asbytes=True), low.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3))], ["bucket", "ids", "counts", "keys"])

    held, size = [], 0
    for i, keys in each:
        if len(keys):
            held.append((i, keys))
            size += len(keys)
        if size >= AT_ONCE:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def met(sent: DataFrame, kind: type, min_pages: int, stream: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, keys): of each id the keys that ``min_pages`` different ``stream``s have."""

    def look(bucket: int, ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = stream(ids)
        order = np.lexsort((names, keys))
        ids, keys, names = ids[order], keys[order], names[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.cumsum(new) - 1
        other = new | np.concatenate([[True], names[1:] != names[:-1]])
        again = np.bincount(group[other])[group] >= min_pages
        ids, keys = ids[again], keys[again].astype(np.uint64)
        if kind is np.int32:
            keys |= np.uint64(bucket << 64 - int(SHORT) - BUCKETS)
        order = np.argsort(ids, kind="stable")
        ids, keys = ids[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
        ends = [*first[1:], len(ids)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[first].astype(np.int64)), pa.array([keys[a:z].tobytes() for a, z in zip(first, ends)], pa.binary())], ["id", "keys"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for x, ids, counts, keys in (r for b in small(batches) for r in zip(*(c.to_pylist() for c in b.columns))):
            if x != bucket and held:
                yield from parts(bucket, held)
                held = []
            bucket, ids = x, np.frombuffer(ids, kind)
            counts = np.frombuffer(pa.decompress(counts, 4 * len(ids), codec="zstd", asbytes=True), np.uint32)
            held.append((np.repeat(ids, counts), np.frombuffer(keys, np.uint32 if kind is np.int32 else np.uint64)))
        if held:
            yield from parts(bucket, held)

    def parts(bucket: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """A bucket's keys by their next bits, so that few are looked through at once."""
        bits = max(0, int(sum(len(k) for _, k in held) // AT_ONCE).bit_length())
        wide = 64 - int(SHORT) - BUCKETS if kind is np.int32 else 64 - BUCKETS
        for part in range(1 << bits):
            mine = [(k >> k.dtype.type(wide - bits)) & k.dtype.type((1 << bits) - 1) == part if bits else np.ones(len(k), bool) for _, k in held]
            ids, keys = (np.concatenate([h[n][m] for h, m in zip(held, mine)]) for n in (0, 1))
            if len(keys):
                yield from look(bucket, ids, keys)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, "id long, keys binary")


def n_covered(covered: np.ndarray, run: int) -> int:
    """Tokens in runs that begin at ``covered``."""
    return int(np.minimum(np.diff(covered), run).sum()) + run if len(covered) else 0


def checked(found: list[tuple[bool, str]], covered: np.ndarray, run: int) -> str:
    """The blocks without what repeats; where there is an article, its blocks are put back and those outside taken away."""
    inside = [x for marked, x in found if marked]
    return "\n".join(inside or cut([x for _, x in found], set(covered.tolist()), run))


def cut(lines: list[str], covered: set[int], run: int) -> list[str]:
    """Lines without what lies in runs that begin at one of ``covered``.

    A run may go on from line to line (a menu's entries); of a line it only takes
    ``run`` tokens or more in a row, or the whole line, so that a unique line
    keeps a first word that it happens to share.
    """
    drop: set[int] = set()
    for i in covered:
        drop.update(range(i, i + run))
    out, at = [], 0
    for line in lines:
        words = line.split(" ")
        left, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and at + j in drop:
                j += 1
            if j == i:
                left.append(words[i])
                i += 1
            else:
                if j - i < min(run, len(words)):
                    left += words[i:j]
                i = j
        at += len(words)
        if left:
            out.append(" ".join(left))
    return out
