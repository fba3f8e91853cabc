"""WARC: write captures as archives, read archives back, one nested row per capture.

``write`` makes, per capture, a request, a response (or revisit) and a metadata
record; request and metadata name the response in WARC-Concurrent-To.  Each
task writes one gzip-per-record file under a temporary name and renames it, so
that a task that runs again (lost executor, speculation) leaves the same file.

``read_records`` gives the records of archives; ``captures`` assembles
transactions: records that are concurrent to one another become one row with
nested request, response and metadata.  Records move as the gzip members that
archives hold, and are inflated at the ends.

Equal payloads of at least ``min_revisit`` bytes are stored once: the record
with the smallest key is the response, the others are revisits of it.

Defined results: every row is a capture of its own, with record ids by the
number of its row, so repeated keys and repeated rows stay what they are; of
rows that share the smallest key the first is the response.  A null key is the
largest and is written as no key; null payloads are empty; a null uri is an
empty target; a payload of any length is one record, held whole by one task at a
time.  Only key, uri and payload are read, so other columns cannot clash.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small

#: Time of all records: the archives depend on their input alone.
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6f2f6a52-5b1c-4d8e-9a56-0d6f8f1f7a10")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(kind: str, row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{row}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def numbered(df: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """k, u, p (empty for null) and row, the number that tells the rows of one key apart."""
    return df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{uri}`"), F.lit("")).alias("u"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("p"), F.monotonically_increasing_id().alias("row"))


def revisits(rows: DataFrame, min_revisit: int, salts: int = 16) -> DataFrame:
    """(row, refers_to: a row) of every capture (k, p, row) whose payload a smaller key, or an earlier row of the key, has.

    First rows are found with a map-side minimum; the join back is dealt by
    digest and salt, so that a payload with a third of all rows is spread.
    """
    seen = rows.filter(F.octet_length("p") >= min_revisit).select(F.sha2(F.col("p").cast("binary"), 256).alias("digest"), F.struct(F.col("k").isNull(), "k", "row").alias("f"))
    first = seen.groupBy("digest").agg(F.min("f").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = first.select("digest", F.col("first.row").alias("refers_to"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = seen.select("digest", F.col("f.row").alias("row"), F.pmod(F.xxhash64("f.row"), F.lit(salts)).cast("int").alias("salt"))
    return salted.join(first, ["digest", "salt"]).filter("row <> refers_to").select("row", "refers_to")


def write(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", min_revisit: int = 100) -> DataFrame:
    """Write the archives below ``path`` (a URI of a shared file system); returns their list: file, records."""
    rows = numbered(df, key, uri, payload)
    later = revisits(rows, min_revisit)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [answer(str(row), u, p.encode()) for _, row, u, p in zip(*(c.to_pylist() for c in b.columns))]
            n, digest, response = zip(*made)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(response, pa.binary())], ["k", "row", "u", "n", "digest", "response"])

    answers = rows.select(F.col("k").cast("string"), "row", "u", "p").mapInArrow(prepare, "k string, row long, u string, n long, digest string, response binary")
    joined = answers.join(later, "row", "left").select("k", F.col("row").cast("string"), "u", "n", "digest", "response", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}.warc.gz"
        partial, records = f"{folder}/.{task.taskAttemptId()}-{uuid.uuid4().hex}.tmp", 0
        with store.open_output_stream(partial, compression=None) as out:
            out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"))
            for b in small(batches):
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    out.write(b"".join(transaction(*row)))
                    records += 3
        if store.get_file_info(name).type != fs.FileType.NotFound:  # an earlier attempt's file, with the same records
            store.delete_file(name)
        store.move(partial, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])

    return joined.mapInArrow(run, "file string, records long")


def common(uri: str) -> list[tuple[str, str]]:
    return [("WARC-Date", DATE), ("WARC-Target-URI", " ".join(uri.split()))]


def http_head(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def answer(row: str, uri: str, payload: bytes) -> tuple[int, str, bytes]:
    """Length and digest of a payload, and its response record."""
    digest = hashlib.sha256(payload).hexdigest()
    kind = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    return len(payload), digest, record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", row)), *common(uri), *kind], http_head(len(payload)) + payload)


def transaction(key: str | None, row: str, uri: str, n: int, digest: str, response: bytes, refers: str | None) -> Iterator[bytes]:
    """The three records of a capture; one that refers to another's payload keeps the HTTP head alone."""
    own, same = record_id("response", row), common(uri)
    target = same[1][1]
    yield record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", row)), ("WARC-Concurrent-To", own), *same, ("Content-Type", "application/http;msgtype=request")], f"GET {target} HTTP/1.1\r\nHost: {target.split('/')[2] if target.count('/') > 1 else ''}\r\n\r\n".encode())
    if refers is None:
        yield response
    else:
        kind = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id("response", refers)), ("WARC-Profile", REVISIT), *same, *kind], http_head(n))
    yield record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", row)), ("WARC-Concurrent-To", own), *same, ("Content-Type", "application/warc-fields")], ("" if key is None else f"captureKey: {key}\r\n").encode())


def members(stream) -> Iterator[tuple[bytes, bytes]]:
    """Each gzip member of a stream, as it is and inflated; a record's length bounds the memory."""
    unzip, raw, parts, data = zlib.decompressobj(31), [], [], stream.read(1 << 20)
    while data:
        parts.append(unzip.decompress(data))
        if unzip.eof:
            rest = unzip.unused_data
            raw.append(data[: len(data) - len(rest)])
            yield b"".join(raw), b"".join(parts)
            data = rest or stream.read(1 << 20)
            unzip, raw, parts = zlib.decompressobj(31), [], []
        else:
            raw.append(data)
            data = stream.read(1 << 20)
    if raw:
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: int(headers.get("content-length", 0))]


RECORD = "file string, type string, id string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, record binary"


def read_records(files: DataFrame, column: str = "file") -> DataFrame:
    """Records of the archives named in ``files``, one archive per task at a time, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [x.split(" ")[0] for x in RECORD.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "record" else pa.string()) for n, c in zip(names, zip(*rows))], names)

        for b in batches:
            for file in b.column(0).to_pylist():
                store, where = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
                rows, size = [], 0
                with store.open_input_stream(where, compression=None) as stream:
                    for member, raw in members(stream):
                        h, _ = parse(raw)
                        rows.append((file, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), member))
                        size += len(member)
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.select(column).mapInArrow(run, RECORD)


# Fields of the nested records and the headers they come from.
ONE = {"id": "warc-record-id", "uri": "warc-target-uri", "date": "warc-date"}
ANSWER = {"type": "warc-type", **ONE, "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


SLOTS = {"request": 0, "response": 1, "revisit": 1, "metadata": 2}
#: Captures of a file that wait for their other records at once.
PENDING = 512


def _transactions(files: DataFrame, column: str, whole: bool) -> DataFrame:
    """Per file: the captures that are whole in it, or what is left over (a record may stand far from its fellows or in another file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["capture_id", "request", "response", "metadata"]

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.string()) for i, c in enumerate(zip(*rows))], names)

        for b in batches:
            for file in b.column(0).to_pylist():
                store, where = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
                waiting: dict[str, list] = {}
                rows, size = [], 0
                with store.open_input_stream(where, compression=None) as stream:
                    for member, raw in members(stream):
                        h, _ = parse(raw)
                        slot = SLOTS.get(h.get("warc-type", ""))
                        key = h.get("warc-concurrent-to") or h.get("warc-record-id")
                        if slot is None or key is None:
                            continue
                        mine = waiting.setdefault(key, [key, None, None, None])
                        mine[slot + 1] = mine[slot + 1] or member
                        done = all(mine)
                        out = waiting.pop(key) if done else waiting.pop(next(iter(waiting))) if len(waiting) > PENDING else None
                        if out and done == whole:
                            rows.append(out)
                            size += sum(len(x) for x in out[1:] if x)
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                rows += [] if whole else waiting.values()
                if rows:
                    yield batch(rows)

    return files.select(column).mapInArrow(run, "capture_id string, request binary, response binary, metadata binary")


def captures(files: DataFrame, column: str = "file") -> DataFrame:
    """One nested row per capture of the archives named in ``files``: records with one transaction id (own id, or the one they are concurrent to).

    A capture whose request, response and metadata stand near each other in one
    file, as writers put them, is assembled where it is read.  Records left over
    are joined by their transaction id, across files, and go with no capture that
    is whole elsewhere.
    """
    whole = _transactions(files, column, True)
    rest = checkpointed(_transactions(files, column, False))
    if not rest.isEmpty():
        met = rest.groupBy("capture_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("request", "response", "metadata")))
        whole = whole.unionByName(met.join(whole.select("capture_id"), "capture_id", "left_anti"))
    shapes = {"request": ONE, "response": ANSWER, "metadata": ONE}

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 100):
            out = [b.column(0)]
            for column, fields in zip(b.columns[1:], shapes.values()):
                opened = [None if m is None else parse(zlib.decompress(m, 31)) for m in column.to_pylist()]
                heads = [pa.array([o and o[0].get(h) for o in opened], pa.string()) for h in fields.values()]
                blocks = pa.array([o and o[1] for o in opened], pa.binary())
                out.append(pa.StructArray.from_arrays([*heads, blocks], [*fields, "block"], mask=pa.array([o is None for o in opened])))
            yield pa.RecordBatch.from_arrays(out, ["capture_id", *shapes])

    struct = lambda fields: f"struct<{','.join(f'{f}:string' for f in fields)},block:binary>"
    return whole.mapInArrow(inflate, "capture_id string, " + ", ".join(f"{n} {struct(f)}" for n, f in shapes.items()))


def http_body(block):
    """Payload of an HTTP block (a binary column): what follows the first empty line."""
    return F.expr(f"substring({block}, locate('\\r\\n\\r\\n', cast({block} as string)) + 4)")


def resolve(captured: DataFrame, own: str, key: str, refers: str, out: str, salts: int = 16) -> DataFrame:
    """``captured`` with ``out``: the ``key`` of the capture whose record id ``refers`` names.

    Many revisits may name one response: they are dealt by id and salt, and only
    responses that are named are multiplied.
    """
    named = captured.filter(F.col(refers).isNotNull()).select(F.col(refers).alias("_id")).distinct()
    answers = captured.select(F.col(own).alias("_id"), F.col(key).alias(out)).join(named, "_id", "left_semi")
    answers = answers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = captured.withColumn("_salt", F.pmod(F.xxhash64(own), F.lit(salts)).cast("int")).withColumnRenamed(refers, "_id")
    plain = salted.filter(F.col("_id").isNull()).drop("_id", "_salt").withColumn(out, F.lit(None).cast(dict(captured.dtypes)[key]))
    return salted.filter(F.col("_id").isNotNull()).join(answers, ["_id", "_salt"], "left").drop("_id", "_salt").unionByName(plain)
