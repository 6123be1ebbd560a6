"""WARC archives: writing, the monolithic gzip normaliser, and reading by index.

Archives are first written as one gzip stream for a whole file, as many tools do. The normaliser inflates such a file once, from
front to back, rewrites every record as a gzip member of its own, and writes a sidecar index with the offset and length of each
member, so any record can be read alone. Where payloads of at least `least` bytes are equal, the record with the largest page
id stays a response and the others become revisits of it while they are rewritten; pages are never shuffled, only their digests.

Files go to the shared folder through pyarrow's file systems (file, hdfs, s3, gs), under a temporary name that is then moved, so
a task that runs again replaces its own files by the same ones (pages that come out of a shuffle are written down first, so that its rows are the same). A file holds at most about FILE_BYTES of records.

Results for odd inputs: null html is an empty payload; null ids and urls are kept as empty fields; of repeated rows with the same
largest page id one is the response; an empty table gives no rows. Payloads of any size are kept whole. Only the id, url
and html columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, emptied, filled, settled, shared_dir

LEAST = 1000
FILE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(folder: str):
    """The file system and path of a folder's URI."""
    from pyarrow.fs import FileSystem

    if folder.startswith("/"):
        folder = "file://" + folder
    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


class Sink:
    """A file that gets its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = opened(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{name}"
        self.part = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def record(kind: str, name: str, url: str | None, digest: str, payload: bytes, length: int, refers: str | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def inflated(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, read once."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            yield unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)


def records(stream) -> Iterator[bytes]:
    """The records of an inflated WARC, one at a time."""
    held, need = bytearray(), 0
    for data in inflated(stream):
        held += data
        at = 0
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                length = re.search(rb"\r\nContent-Length: (\d+)", held[at:end])
                need = end + 4 - at + int(length[1]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, 0
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages as responses, one gzip stream for each file; page_id, file, seq, digest, payload_bytes of each record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, number, sink, size, seq = TaskContext.get().partitionId(), 0, None, 0, 0
        for batch in batches:
            out = []
            for page, url, html in zip(batch["page_id"].tolist(), batch["url"].tolist(), batch["html"].tolist()):
                if sink is None:
                    name = f"part-{task:06d}-{number:04d}.warc.gz"
                    sink, zipped, size, seq = Sink(folder, name), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                payload = b"" if html is None else html.encode("utf-8", "replace")
                digest = hashlib.sha1(payload).hexdigest()
                data = record("response", f"{page}:{name}:{seq}", url, digest, payload, len(payload))
                sink.write(zipped.compress(data))
                out.append((page, name, seq, digest, len(payload)))
                size, seq = size + len(data), seq + 1
                if size >= file_bytes:
                    sink.write(zipped.flush())
                    sink.close()
                    sink, number = None, number + 1
            yield pd.DataFrame(out, columns=["page_id", "file", "seq", "digest", "payload_bytes"])
        if sink is not None:
            sink.write(zipped.flush())
            sink.close()

    rows = settled(pages.select(filled(F.col(id_col)).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")))
    return rows.mapInPandas(run, "page_id long, file string, seq long, digest string, payload_bytes long")


def revisits(written: DataFrame, least: int = LEAST) -> DataFrame:
    """written with `refers`, the record id of the response that a record revisits, or null."""
    key = F.struct("page_id", "file", "seq")
    last = written.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max(key).alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = written.join(last, "digest", "left")
    return both.withColumn("refers", F.when(F.col("last").isNotNull() & (F.col("last") != key), F.concat_ws(":", "last.page_id", "last.file", "last.seq"))).drop("last")


def normalised(name: str, source: str, target: str, refers: dict[int, str], level: int = 6) -> int:
    """Rewrite one archive: a member for each record, and its sidecar index of JSON lines. How many records."""
    fs, root = opened(source)
    out, index, at, n = Sink(target, name), [], 0, 0
    with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
        for seq, data in enumerate(records(stream)):
            if seq in refers:
                headers, block = parsed(data)
                http = block[: block.index(b"\r\n\r\n") + 4]
                length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                rid = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                data = record("revisit", rid, headers["WARC-Target-URI"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), b"", length, refers[seq])
            zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = zipped.compress(data) + zipped.flush()
            out.write(member)
            index.append(json.dumps({"seq": seq, "offset": at, "length": len(member)}))
            at, n = at + len(member), n + 1
    out.close()
    sidecar = Sink(target, name + ".idx")
    sidecar.write("".join(x + "\n" for x in index).encode())
    sidecar.close()
    return n


def normalise(written: DataFrame, source: str, target: str) -> DataFrame:
    """Normalise every archive that `written` (with refers) names; file and n of each. A task has one file's records at a time."""
    files = max(1, written.select("file").distinct().count())

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        kept = rows[rows["refers"].notna()]
        n = normalised(key[0], source, target, dict(zip(kept["seq"].tolist(), kept["refers"].tolist())))
        if n != len(rows):
            raise ValueError(f"{key[0]} has {n} records, {len(rows)} were written")
        return pd.DataFrame({"file": [key[0]], "n": [n]})

    return written.select("file", "seq", "refers").repartition(2 * files, "file").groupBy("file").applyInPandas(run, "file string, n long")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, each read by its place in the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(folder)
        for batch in batches:
            for name in batch["file"].tolist():
                out = []
                with fs.open_input_stream(f"{root}/{name}.idx", compression=None) as f:
                    places = [json.loads(x) for x in f.read().decode().splitlines()]
                with fs.open_input_file(f"{root}/{name}") as f:
                    for p in places:
                        headers, block = parsed(zlib.decompress(f.read_at(p["length"], p["offset"]), 31))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (length, digest):
                            raise ValueError(f"{name}: record {p['seq']} is damaged")
                        page = int(headers["WARC-Record-ID"][len("<urn:page:") :].split(":")[0])
                        refers = int(headers["WARC-Refers-To"][len("<urn:page:") :].split(":")[0]) if kind == "revisit" else None
                        out.append((page, length, digest, kind, refers))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"refers_to": "Int64"})

    out = files.select("file").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.withColumns({"page_id": emptied(F.col("page_id")), "refers_to": emptied(F.col("refers_to"))})


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST, **columns) -> tuple[DataFrame, str]:
    """Write, normalise and index all pages; the files (file, n) and the folder they lie in."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = cut(write_archives(pages, f"{folder}/raw", **columns))
    files = cut(normalise(cut(revisits(written, least)), f"{folder}/raw", f"{folder}/archives"))
    fs, root = opened(f"{folder}/raw")
    if fs.get_file_info(root).type.name == "Directory":
        fs.delete_dir(root)
    return files, f"{folder}/archives"


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST, **columns) -> DataFrame:
    """Archive all pages and read every record back."""
    files, where = archive(pages, folder, least, **columns)
    return read_archives(files.repartition(max(1, files.count())), where)
