"""WARC archives with revisit resolution and deduplication.

``write_warc`` writes rows as WARC/1.1 records, ``read_warc`` parses archives
back. Records are written by Spark's own text writer (its committer makes a
lost executor harmless): a record is its header block, its payload bytes and
the two line ends that close it. Files are gzip streams, or plain with
``compression=None``, of at most ``records_per_file`` records. Spark lists the
files and deals them to tasks; a task streams through a file, so neither its
bytes nor its records bound what is held: that is one record, or a batch of
``batch_bytes``. Reading goes by Content-Length, so payloads may contain
anything, and checks each payload against its recorded digest.

``dedup_archive`` resolves revisits: the headers alone are shuffled by payload
digest (the smallest page id of a digest is its original; partial sums come
first, so a digest that holds a third of all records is no hot spot) and joined
with their originals. No payload crosses the network: the decisions on copies
are gathered for each file (at most ``records_per_file`` of them), and the task
that streams the file again writes a new archive with fresh headers: originals
as responses with payload, copies as revisit records without. ``resolve_revisits``
reads such an archive's headers back and joins each revisit with the response
that it refers to.

Defined results: null html is an empty payload; null page ids rank last and
come back as null; of rows that share the smallest page id one is the
response; payloads under ``min_bytes`` are never revisits; an empty table gives
an empty result. Only the id, the url and the html are read.
"""
from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import mounted, shared_path, stored

EOL = "\r\n"
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def _record_id(page_id: Column, seq: Column) -> Column:
    return F.concat(F.lit(f"<{_ID}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), seq.cast("string"), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record for each row; ``seq`` tells rows with one id apart."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("seq"),
        F.regexp_replace(F.col(url_col), r"[\r\n]", "").alias("url"), F.lit("response").alias("record_type"),
        F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"),
        F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("long").alias("refers_seq"),
        F.lit(None).cast("string").alias("refers_url"), html.alias("payload"))


def write_warc(recs: DataFrame, path: str, date: str = DATE, compression: str | None = "gzip",
               records_per_file: int = 4000) -> None:
    """Write records (columns of ``records``). Revisits go without payload."""
    is_revisit = F.col("record_type") == "revisit"
    block = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("seq"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))),
        _header("WARC-Refers-To", F.when(is_revisit, _record_id(F.col("refers_to"), F.col("refers_seq")))),
        _header("WARC-Refers-To-Target-URI", F.when(is_revisit, F.col("refers_url"))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(block).cast("string")))
    w = (recs.select(F.concat(head, F.lit(EOL), block).alias("value")).write
         .option("lineSep", EOL + EOL).option("maxRecordsPerFile", records_per_file))
    (w.option("compression", compression) if compression else w).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of one archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield head, block


def _page_seq(record_id: str | None) -> tuple[int | None, int | None]:
    if not record_id:
        return None, None
    page, _, seq = record_id.strip("<>").removeprefix(_ID).rpartition(":")
    return (int(page) if page else None), int(seq)


_LONGS = ["page_id", "seq", "payload_bytes", "refers_to", "refers_seq"]
_FIELDS = ["page_id", "seq", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "refers_seq", "refers_url"]


def _schema(fields: list[str]) -> str:
    return ", ".join(f"{c} {'long' if c in _LONGS else 'string'}" for c in fields)


def _batch(rows: list[tuple], fields: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if c in _LONGS else pa.string() for c in fields]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=fields)


def _opened(path: str) -> io.BufferedIOBase:
    """A file of the shared folder as a stream: a mounted one, or one in a store that Arrow reads."""
    if re.match(r"(?!file:)[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        from pyarrow import fs
        store, name = fs.FileSystem.from_uri(path)
        f = io.BufferedReader(store.open_input_stream(name, compression=None), 1 << 20)
    else:
        f = open(mounted(path), "rb", 1 << 20)
    return gzip.GzipFile(fileobj=f) if f.peek(2)[:2] == b"\x1f\x8b" else f


def _file_records(path: str, copies: dict[int, tuple], payloads: bool) -> Iterator[tuple[tuple, int]]:
    """(row of ``_FIELDS`` and payload, bytes of the block) of each record of a file;
    ``copies`` (seq -> page id, seq and url of the original) come out as revisits."""
    with _opened(path) as stream:
        for head, block in parse(stream):
            kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
            own = kind != "revisit"
            if own and hashlib.sha256(block).hexdigest() != digest:
                raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
            page, seq = _page_seq(head["warc-record-id"])
            refers = (*_page_seq(head.get("warc-refers-to")), head.get("warc-refers-to-target-uri"))
            if seq in copies:
                kind, refers = "revisit", copies[seq]
            row = (page, seq, head.get("warc-target-uri"), kind, digest, len(block) if own else None, *refers)
            yield row + ((block.decode("utf-8", "replace") if kind != "revisit" else None,) if payloads else ()), len(block)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The archives under ``path``; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"))


def _records_of(files: DataFrame, payloads: bool, keep_file: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of files, each with the decisions in its column ``copies`` where there is one."""
    ship_package(files.sparkSession)
    fields = _FIELDS + ["payload"] * payloads + ["file"] * keep_file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                copies = {c["seq"]: (c["o_page"], c["o_seq"], c["o_url"]) for c in f.get("copies") or ()}
                rows, held = [], 0
                for row, size in _file_records(f["file"], copies, payloads):
                    rows.append(row + (f["file"],) * keep_file)
                    held += size
                    if held > batch_bytes or len(rows) >= 10_000:
                        yield _batch(rows, fields)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, fields)

    return files.mapInArrow(run, _schema(fields))


def read_warc(spark: SparkSession, path: str, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of all archives under ``path``. A revisit has no payload and no
    ``payload_bytes`` of its own (see ``resolve_revisits``)."""
    return _records_of(_files(spark, path), payloads, batch_bytes=batch_bytes)


def originals(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(o_digest, o_seq): the first record of each digest that has several."""
    big = headers.filter(F.col("payload_bytes") >= min_bytes)
    last = F.lit((1 << 63) - 1)
    first = big.groupBy("payload_digest").agg(
        F.min_by(F.col("seq"), F.coalesce("page_id", last)).alias("refers_seq"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return first.select(F.col("payload_digest").alias("o_digest"), F.col("refers_seq").alias("o_seq"))


def decided_files(spark: SparkSession, source: str, min_bytes: int = 100) -> DataFrame:
    """(file, copies): an archive's files with what their copies refer to, from headers alone."""
    headers = stored(_records_of(_files(spark, source), payloads=False, keep_file=True), "warc-headers")
    heads = headers.alias("h").join(
        originals(headers, min_bytes).alias("f"), (F.col("h.payload_digest") == F.col("f.o_digest")) & (F.col("h.seq") == F.col("f.o_seq"))).select(
        "f.o_digest", F.col("h.page_id").alias("o_page"), "f.o_seq", F.col("h.url").alias("o_url"))
    copies = headers.join(heads, (F.col("payload_digest") == F.col("o_digest")) & (F.col("seq") != F.col("o_seq")))
    by_file = copies.groupBy("file").agg(F.collect_list(F.struct("seq", "o_page", "o_seq", "o_url")).alias("copies"))
    # a row a file, dealt out evenly: rows this small would otherwise be merged into one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _files(spark, source).join(by_file, "file", "left").repartition(tasks)


def dedup_archive(spark: SparkSession, source: str, target: str, min_bytes: int = 100, **how) -> None:
    """Rewrite an archive of responses: copies become revisits of their original."""
    write_warc(_records_of(decided_files(spark, source, min_bytes), payloads=True), target, **how)


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Give each revisit the payload size of the response that it refers to."""
    first = headers.filter("record_type = 'response'").select(
        F.col("seq").alias("f_seq"), F.col("payload_digest").alias("f_digest"), F.col("payload_bytes").alias("f_bytes"))
    again = headers.filter("record_type = 'revisit'").join(
        first, (F.col("refers_seq") == F.col("f_seq")) & (F.col("payload_digest") == F.col("f_digest")), "left")
    return headers.filter("record_type != 'revisit'").unionByName(
        again.withColumn("payload_bytes", F.col("f_bytes")).select(*headers.columns))


def archive_pages(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Write ``pages`` as an archive, deduplicate it, read it back: one row per page."""
    spark = pages.sparkSession
    raw, final = shared_path(spark, "warc-raw"), shared_path(spark, "warc-dedup")
    write_warc(records(pages, id_col, url_col, html_col), raw)
    dedup_archive(spark, raw, final, min_bytes)
    return resolve_revisits(read_warc(spark, final, payloads=False))
