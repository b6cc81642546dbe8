"""WARC archives with a two-level capture index.

:func:`write` makes one gzip member per record; payloads of ``LEAST`` bytes and more that are equal are written once, as the
response of the largest page id, and the others as revisits that name it. Every task attempt writes an archive of its own,
which its rows name: a task that runs again or twice leaves a file that no capture points to, never a changed one.

The index: capture keys (reversed host, path, query, in ASCII: one form is sorted, stored and sought) sorted by range into
files of compressed blocks of ``BLOCK`` lines, and a sparse directory with the first key, place and length of each block.
:func:`lookup` searches the directory by bisection, reads and searches one block, and reads one record's range.
:func:`places` reads all blocks, :func:`read` all records by the places that it gives.

Edge cases: null html is an empty payload; payloads under ``LEAST`` bytes are all responses; null and odd urls give keys
that sort by their text; repeated rows of one page are records of their own, of which one is the response; of equal page ids
revisits name that id; a null page id is never named and gives a response of its own; other columns are not read; an empty
table gives no rows and an empty index. A payload of any length is one record, held whole by the task that writes or reads it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fields, looked_up
from millrace.session import remove, shared_dir, ship

LEAST = 1000
BLOCK = 2000
#: Copies of a payload from which on its response's id is broadcast.
HOT = 50_000
#: Bytes of an archive that are read one after another, and those that a task reads, about.
RANGE, TASK = 8 << 20, 64 << 20
DATE = "2024-01-01T00:00:00Z"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def url_key(url: str | None) -> str:
    """The host's parts reversed, then path and query: org,example)/path?q. JSON-escaped, so in ASCII and without tabs and line ends."""
    return json.dumps(_url_key(url))[1:-1]


def _url_key(url: str | None) -> str:
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return f"){url}"
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the headers alone."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{url}|{digest}'.encode()).digest())}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {json.dumps(url)[1:-1] if url is not None else ''}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (the block's own as http-...) and payload of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers |= {f"http-{k}": v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
    return headers, payload


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, digest, size, refers_to, and html of the responses only (a revisit's is not needed any more)."""
    d = fields(pages, page_id=id_col, url=url_col, html=html_col).withColumn("payload", F.coalesce("html", F.lit("")).cast("binary"))
    d = d.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("size"))
    # of copies, one row is the response: digests go to it through a partial aggregation, and the join back moves no payload of a small page twice
    first = d.where((F.col("size") >= LEAST) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    d = looked_up(d, first, "digest", "n", "largest", HOT, F.xxhash64("page_id").cast("string"))
    refers = F.when(F.col("page_id").isNull() | (F.col("size") < LEAST) | (F.col("page_id") == F.col("largest")), F.lit(None)).otherwise(F.col("largest"))
    return d.select("page_id", "url", "digest", "size", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Writes archives below ``folder``; gives their capture index: url_key, page_id, file, start, length."""
    ship(planned.sparkSession)
    id_type = planned.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        t = TaskContext.get()
        name = f"part-{t.partitionId():06d}-{t.taskAttemptId()}.warc.gz"
        fs.create_dir(base)
        at = 0
        out = fs.open_output_stream(f"{base}/{name}", compression=None)
        try:
            for b in batches:
                c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                rows: list[list] = [[], [], []]
                for i in range(b.num_rows):
                    page_id, url = c["page_id"][i].as_py(), c["url"][i].as_py()
                    r = record(page_id, url, c["payload"][i].as_py(), c["digest"][i].as_py(), c["size"][i].as_py(), c["refers_to"][i].as_py())
                    out.write(r)
                    for column, x in zip(rows, (url_key(url), at, len(r))):
                        column.append(x)
                    at += len(r)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), c["page_id"], pa.array([name] * b.num_rows, pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], ["url_key", "page_id", "file", "start", "length"])
        finally:
            out.close()
        if not at:
            fs.delete_file(f"{base}/{name}")

    return planned.mapInArrow(run, f"url_key string, page_id {id_type}, file string, start long, length long")


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sorts captures by key into files of compressed blocks; gives the sparse directory: first_key, file, start, length, lines."""
    ship(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        t = TaskContext.get()
        name = f"index-{t.partitionId():06d}-{t.taskAttemptId()}"
        fs.create_dir(base)
        entries: list[tuple] = []
        waiting: list[str] = []
        at = 0
        out = fs.open_output_stream(f"{base}/{name}", compression=None)

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(waiting).encode(), 6)
            out.write(data)
            entries.append((waiting[0].split("\t", 1)[0], name, at, len(data), len(waiting)))
            at += len(data)
            waiting.clear()

        try:
            for b in batches:
                for key, *rest in zip(*(b.column(i).to_pylist() for i in range(5))):
                    waiting.append("\t".join([key, json.dumps(rest)]))
                    if len(waiting) >= block:
                        flush()
            if waiting:
                flush()
        finally:
            out.close()
        if not at:
            fs.delete_file(f"{base}/{name}")
        columns = list(zip(*entries)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["first_key", "file", "start", "length", "lines"])

    d = captures.select("url_key", "page_id", "file", "start", "length").repartitionByRange("url_key").sortWithinPartitions("url_key", "page_id")
    return d.mapInArrow(run, "first_key string, file string, start long, length long, lines long")


def lookup(directory: list[tuple[str, str, int, int]], index_folder: str, archive_folder: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """The records of a url: bisection in the directory (first_key, file, start, length; sorted), then in blocks, then range reads."""
    key = url_key(url)
    fs, base = _fs(index_folder)
    archives, root = _fs(archive_folder)
    keys = [d[0] for d in directory]
    at = bisect_right(keys, key) - 1
    while at > 0 and keys[at] == key:  # a key's captures may begin in an earlier block
        at -= 1
    found = []
    for _, file, start, length in directory[max(0, at) :]:
        with fs.open_input_file(f"{base}/{file}") as f:
            lines = zlib.decompress(f.read_at(length, start)).decode().split("\n")
        own = [x.split("\t", 1)[0] for x in lines]
        if own[0] > key:
            break
        for line in lines[bisect_right(own, key) - own.count(key) : bisect_right(own, key)]:
            _, name, begin, size = json.loads(line.split("\t", 1)[1])
            with archives.open_input_file(f"{root}/{name}") as f:
                found.append(parse(f.read_at(size, begin)))
        if own[-1] > key:
            break
    return found


def places(directory: DataFrame, folder: str) -> DataFrame:
    """Every line of the index blocks that the directory names: url_key, file, start, length. A block that isn't what the directory says, or isn't sorted, raises ValueError."""
    spark = directory.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        for b in batches:
            for first, name, start, length, n in zip(*(b.column(i).to_pylist() for i in range(5))):
                with fs.open_input_file(f"{base}/{name}") as f:
                    lines = [x.split("\t", 1) for x in zlib.decompress(f.read_at(length, start)).decode().split("\n")]
                keys = [k for k, _ in lines]
                if len(keys) != n or keys[0] != first or keys != sorted(keys):
                    raise ValueError(f"damaged block in {name} at {start}")
                rest = [json.loads(x) for _, x in lines]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([r[i] for r in rest], k) for i, k in ((1, pa.string()), (2, pa.int64()), (3, pa.int64())))], ["url_key", "file", "start", "length"])

    d = directory.select("first_key", "file", "start", "length", "lines").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "start")
    return d.mapInArrow(run, "url_key string, file string, start long, length long")


def read(captures: DataFrame, folder: str) -> DataFrame:
    """Every record of the index, read back by its place: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (of responses)."""
    ship(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        opened: dict[str, pa.NativeFile] = {}
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                out: list[list] = [[] for _ in range(7)]
                for file, start, length in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if file not in opened:
                        for f in opened.values():
                            f.close()
                        opened = {file: fs.open_input_file(f"{base}/{file}")}
                    h, payload = parse(opened[file].read_at(length, start))
                    digest = base64.b32decode(h["WARC-Payload-Digest"].split(":")[1]).hex()
                    kind = h["WARC-Type"]
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["http-Content-Length"])):
                        raise ValueError(f"damaged record in {file} at {start}")
                    page, refers = h["WARC-Page-ID"], h.get("WARC-Refers-To-Page-ID")
                    for column, x in zip(out, (int(page) if page else None, int(h["http-Content-Length"]), digest, kind, int(refers) if refers else None, json.loads(f'"{h["WARC-Target-URI"]}"'), payload if kind == "response" else None)):
                        column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
        for f in opened.values():
            f.close()

    # ranges of archives, each read in its order; their number follows the bytes that the archives hold
    fs, base = _fs(folder)
    held = sum(f.size or 0 for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)))
    tasks = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK))
    d = captures.select("file", "start", "length").repartition(tasks, "file", F.expr(f"start div {RANGE}")).sortWithinPartitions("file", "start")
    return d.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Plans and writes the archives and their index below ``folder``; gives the captures as a table."""
    spark = pages.sparkSession
    write(plan(pages, **columns), f"{folder}/archive").write.parquet(f"{folder}/captures")
    captures = spark.read.schema(f"url_key string, page_id {pages.schema[columns.get('id_col', 'page_id')].dataType.simpleString()}, file string, start long, length long").parquet(f"{folder}/captures")
    build_index(captures, f"{folder}/index").write.parquet(f"{folder}/directory")
    return captures


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    remove(spark, f"{folder}/captures")  # from here on the index alone says where records are
    directory = spark.read.schema("first_key string, file string, start long, length long, lines long").parquet(f"{folder}/directory")
    return read(places(directory, f"{folder}/index"), f"{folder}/archive").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest,
       CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND payload_bytes >= 1000
"""
