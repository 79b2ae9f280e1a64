"""Deterministic sharded WARC archives: write, commit, read back.

Records are ranged by page id into shards of about equal payload, a cut that
depends on the rows alone.  A task sorts its shard, compresses each record on
its own and starts a new file when the compressed size is reached, so the same
rows give the same files, byte for byte, on any cluster and on every retry.
Headers, record ids and digests are made anew from the rows.  A file is written
under a temporary name and renamed when it is complete; the manifest of all
files is written last, and readers hold the folder against it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import by_value, checkpointed, map_batches, shared_folder, split_points, with_range

by_value(__name__)

#: Payload bytes of a shard; shards grow where there would be more than MOST_SHARDS.
SHARD_BYTES = 4_000_000
MOST_SHARDS = 10_000
#: Compressed bytes after which a shard goes on in a new file.
ROLL_BYTES = 16_000_000
#: Equal payloads below this size are all kept as responses.
REVISIT_BYTES = 100
#: The tables have no capture time, so every record carries this one.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6


def record_id(*parts: object) -> str:
    digest = hashlib.sha256("\x1f".join("" if p is None else str(p) for p in parts).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=digest[:16], version=5)}>"


def header_value(text: str) -> str:
    """A header cannot hold control characters; they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_record(page_id: int | None, url: str | None, html: str, copy: int, kind: str, first_id: int | None, first_url: str | None) -> bytes:
    """A response with its payload, or a revisit whose block stops before it."""
    payload = html.encode()
    digest = hashlib.sha256(payload).hexdigest()
    uri = header_value(url) if url is not None else f"urn:page:{page_id}"
    headers = [("WARC-Record-ID", record_id(page_id, url, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
               ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(first_id, first_url, digest, 0)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(first_id))]
        if first_url is not None:
            headers.append(("WARC-Refers-To-Target-URI", header_value(first_url)))
    else:
        block += payload
    return record(kind, headers, block)


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, copy, kind, first_id, first_url) per page, a stored table.

    Of pages with equal payloads the least page id, then url, is the response.
    A null page id is never referred to: where all copies have one, all are responses.
    """
    narrow = checkpointed(pages.select("page_id", "url", "digest", "bytes"))
    usable = narrow.where((F.col("bytes") >= REVISIT_BYTES))
    firsts = usable.groupBy("digest").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.col("url").isNull().alias("no_url"), "url"))).alias("first"))
    firsts = checkpointed(firsts.where("n > 1 and first is not null").select(
        "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    copies = narrow.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "url", "digest").orderBy("bytes")) - 1)
    # The copies are numbered before the join, which then reads two stored tables, so that a hot payload can be split.
    joined = checkpointed(copies).join(firsts, "digest", "left")
    leads = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 0)
    kind = F.when(F.col("first_id").isNotNull() & (F.col("bytes") >= REVISIT_BYTES) & ~leads, "revisit").otherwise("response")
    return joined.withColumn("kind", kind).select(
        "page_id", "url", "digest", "copy", "kind", *[F.when(F.col("kind") == "revisit", F.col(c)).alias(c) for c in ("first_id", "first_url")])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of (page_id, url, html) below ``folder``; returns the manifest as written.

    Null html is an empty payload, a null url gets a urn, repeated rows are
    separate records.  An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long")})
    plan = plan_records(rows)
    sizes = rows.select("page_id", "bytes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    cuts = split_points(sizes, "page_id", "bytes", max(SHARD_BYTES, total // MOST_SHARDS))
    shards = len(cuts) + 2
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("copy", "int"), ("kind", "string"), ("first_id", "long"), ("first_url", "string"))]
    told = plan.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "copy", "kind", "first_id", "first_url")
    both = with_range(rows.select("page_id", "url", "html", "digest", *nothing).unionByName(told), "page_id", cuts, "shard")
    # What is decided about a page stands just before the page itself.
    ordered = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("page_id", "url", "digest", F.col("kind").isNull(), "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = fs.FileSystem.from_uri(folder)
        target.create_dir(f"{path}/data", recursive=True)
        target.create_dir(f"{path}/_temporary", recursive=True)
        done, state = [], {}
        waiting: deque = deque()

        def close() -> None:
            state["out"].close()
            target.move(state["temporary"], f"{path}/data/{state['name']}")
            done.append((state["name"], shard, state["size"], state["records"], state["hash"].hexdigest()))

        def put(data: bytes) -> None:
            state["out"].write(data)
            state["hash"].update(data)
            state["size"] += len(data)

        def start(sequence: int) -> None:
            name = f"shard-{shard:08d}-{sequence:05d}.warc.gz"
            temporary = f"{path}/_temporary/{name}.{uuid.uuid4().hex}"
            state.update(name=name, temporary=temporary, out=target.open_output_stream(temporary, compression=None), size=0, records=0,
                         hash=hashlib.sha256(), sequence=sequence)
            info = [("WARC-Record-ID", record_id("file", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
            put(member(record("warcinfo", info, b"format: WARC File Format 1.1\r\n")))

        shard = None
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("page_id", "url", "html", "copy", "kind", "first_id", "first_url", "shard")]
            for page_id, url, text, copy, kind, first_id, first_url, number in zip(*columns):
                if kind is not None:
                    waiting.append((copy, kind, first_id, first_url))
                    continue
                shard = number
                data = member(page_record(page_id, url, text, *waiting.popleft()))
                if not state:
                    start(0)
                elif state["records"] and state["size"] + len(data) > ROLL_BYTES:
                    close()
                    start(state["sequence"] + 1)
                put(data)
                state["records"] += 1
        if state:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["file", "shard", "size", "records", "sha256"])

    found = ordered.mapInArrow(run, "file string, shard long, size long, records long, sha256 string")
    found.write.parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(found.schema).parquet(f"{folder.rstrip('/')}/manifest")


def members(data: bytes) -> Iterator[bytes]:
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            chunk = view[at : at + (1 << 16)]
            parts.append(unpack.decompress(chunk))
            at += len(chunk)
        at -= len(unpack.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record, whose length and block digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return headers, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, file) per page record.

    Files that the manifest does not list, or lists otherwise, are an error.
    The payload of a revisit is null.
    """
    folder = folder.rstrip("/")
    manifest = spark.read.schema("file string, size long, records long").parquet(f"{folder}/manifest")
    kind = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string")
    if manifest.isEmpty():
        return spark.createDataFrame([], kind)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/data")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("there"))
    if not named.join(manifest, "file", "full").where("there is null or size is null or there <> size").isEmpty():
        raise ValueError(f"{folder}: files and manifest differ")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for text in members(data):
                headers, block = parse(text)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(head.rsplit(b"Content-Length: ", 1)[1])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                fresh = headers["WARC-Type"] == "response"
                if fresh and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
                number = lambda name: int(headers[name]) if name in headers else None  # noqa: B023, E731
                rows.append((number("X-Page-Id"), headers["WARC-Target-URI"], payload if fresh else None, size, digest, headers["WARC-Type"],
                             number("X-Refers-To-Page-Id"), path.rsplit("/", 1)[-1]))
        if not rows:
            return None
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return map_batches(files.select("path", "content"), work, kind)


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    target = shared_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{folder}/pages.parquet"), target if "://" in target or target.startswith("file:") else f"file://{target}")
    return read_archives(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, html, strlen(html) AS bytes, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, bytes AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM q
"""
