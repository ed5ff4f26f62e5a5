"""WARC archives: written by Spark's own text writer, read by a PySpark data source.

A record is its header lines, an empty line, its block and two line ends. The text writer ends each row with just these two line
ends, so a row that holds the rest of a record makes an archive on any file system that Spark writes to, compressed or not.

The data source plans partitions from the list of files: whole files, and of plain ones that `index_archive` has indexed ranges of
records. A reader parses headers first, and skips the blocks of records that the pushed filters reject or whose payload is not asked
for; in a plain file it seeks past them. An archive that ends within a header, a block or a gzip member is an error.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from lakeindex.llm.common import filter_at, filter_of, materialize, passes, prepare

END = "\r\n"
#: Columns that come from headers, in the order of the schema.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type", "payload_bytes": "x-payload-length"}
SCHEMA = "path string, offset long, record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_type string, payload_bytes long, verified boolean, payload binary"
RANGE = 1 << 30  # bytes of a plain file between two records that its index names
OFFSETS = "_offsets"  # an archive's index, a folder beside its files
#: The profile of revisits of equal payloads, as the format names it.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
AHEAD = 1 << 16


def record(kind: Column, record_id: Column, uri: Column, digest: Column, length: Column, refers_to: Column, payload: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """A record without its last two line ends. Null parts of the header are left out; CR and LF in values become spaces."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), F.translate(value.cast("string"), "\r\n", "  "), F.lit(END)), F.lit(""))
    block = F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", kind), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), line("WARC-Refers-To", refers_to), line("WARC-Profile", F.when(refers_to.isNotNull(), IDENTICAL)),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("X-Payload-Length", length), line("Content-Length", F.octet_length(block)), F.lit(END), block,
    )


def write_records(records: DataFrame, path: str, compression: str = "none") -> None:
    """Writes rows with one string column of records as archives under `path`."""
    records.write.mode("overwrite").option("lineSep", END * 2).option("compression", compression).text(path)


def write_pages(pages: DataFrame, path: str, least: int = 1000, compression: str = "none") -> None:
    """Archives a record for each row of (page_id, url, html).

    Of rows with equal payloads of at least `least` bytes, that with the largest page_id is a response, the others are
    revisits of it without a block; smaller payloads are all responses. Null html is the empty payload; a null url is left
    out of the header. Rows that repeat the largest page_id are all responses. Rows with a null page_id are never referred to.
    """
    prepare(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("length", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Only digests are shuffled, groups of copies summed before; pages that surely are no revisit are written as they are read.
    keys = p.where(F.col("length") >= least).select("page_id", "digest", "length")
    groups = keys.groupBy("digest", "length").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    revisits = materialize(keys.join(materialize(groups), ["digest", "length"]).where("page_id is null or page_id <> first").select(F.col("page_id").alias("of"), "digest", "first").distinct())
    filtered, width = filter_of(revisits.select(F.col("of").alias("id")))
    p = p.withColumn("perhaps", passes(filtered)(filter_at("page_id", width)))
    rest = p.where("perhaps").alias("p").join(revisits.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.of")) & (F.col("p.digest") == F.col("r.digest")), "left").select("p.*", "r.first")
    marked = p.where("not perhaps").withColumn("first", F.lit(None).cast("long")).unionByName(rest)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    again = F.col("first").isNotNull()
    write_records(marked.select(record(F.when(again, "revisit").otherwise("response"), name("page_id"), F.col("url"), F.col("digest"), F.col("length"), name("first"), F.when(~again, F.col("html"))).alias("value")), path, compression)


@dataclass
class Files(InputPartition):
    """A range of a file's records: from the one at `start` to the one at `end`. end None: to the end of the file."""

    path: str
    start: int
    end: int | None


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, at


class _Plain:
    """Reads ahead in blocks and seeks over what is not wanted."""

    def __init__(self, file, start: int):
        self.file, self.at, self.held, self.size = file, start, b"", file.size()

    def fill(self, n: int) -> bool:
        """Holds n bytes at least, if the file has them."""
        if len(self.held) < n:
            self.file.seek(self.at + len(self.held))
            self.held += self.file.read(max(AHEAD, n - len(self.held)))
        return len(self.held) >= n

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.fill(seen + 1):
                return None
        out = self.held[:i]
        self.skip(i + len(mark))
        return out

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = self.held[:n]
        self.skip(n)
        return out

    def skip(self, n: int) -> bool:
        """Goes on by n bytes; whether there were so many."""
        self.at, self.held = self.at + n, self.held[n:]
        return self.at <= self.size


class _Gzip(_Plain):
    """The same over gzip members; what is skipped is inflated but never kept or decoded."""

    def __init__(self, file):
        super().__init__(file, 0)
        self.inflate, self.rest, self.begun = zlib.decompressobj(31), b"", False

    def fill(self, n: int) -> bool:
        while len(self.held) < n:
            data = self.rest or self.file.read(AHEAD)
            if not data:
                if self.begun:
                    raise ValueError("the file ends within a gzip member")
                return False
            self.begun = True
            self.held += self.inflate.decompress(data)
            self.rest = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate, self.begun = zlib.decompressobj(31), False
        return True

    def skip(self, n: int) -> bool:
        while n > len(self.held):
            n, self.at, self.held = n - len(self.held), self.at + len(self.held), b""
            if not self.fill(1):
                return False
        self.at, self.held = self.at + n, self.held[n:]
        return True


def parse_header(block: bytes) -> dict[str, str]:
    """Header names in lower case; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split(END)[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def hex_digest(value: str | None) -> str | None:
    """A payload digest in lower-case hex: of sha1:<base 32> or sha1:<hex>."""
    if value is None:
        return None
    digest = value.rpartition(":")[2]
    if len(digest) == 32:
        try:
            return base64.b32decode(digest.upper()).hex()
        except binascii.Error:
            return digest.lower()
    return digest.lower()


def _holds(f: Filter, row: dict) -> bool:
    value = row.get(f.attribute[0])
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, StringStartsWith):
        return value is not None and value.startswith(f.value)
    return value is not None and (value in f.value if isinstance(f, In) else value == f.value)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path") or ""
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.filters: list[Filter] = []
        if not self.path:
            raise ValueError("the warc source needs a path")

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "payload_bytes":
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, at = _open(self.path)
        scheme = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        found = fs.get_file_info(at)
        every = [found] if found.is_file else [f for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file and f.size]
        hidden = lambda f: any(part[:1] in "._" for part in f.path[len(at) :].strip("/").split("/"))
        marks: dict[str, set[int]] = {}
        for f in every:
            if not found.is_file and f.path[len(at) :].strip("/").startswith(f"{OFFSETS}/") and f.base_name.endswith(".parquet"):
                for row in pq.read_table(f.path, filesystem=fs).to_pylist():  # one for each RANGE of the archive
                    marks.setdefault(row["path"], set()).add(row["offset"])
        out: list[InputPartition] = []
        for f in sorted((f for f in every if found.is_file or not hidden(f)), key=lambda f: f.path):
            if f.base_name.endswith(".gz"):
                out.append(Files(scheme + f.path, 0, None))
            elif f.size:
                cuts = sorted({0, f.size} | {x for x in marks.get(scheme + f.path, ()) if x < f.size})
                out += [Files(scheme + f.path, a, b) for a, b in zip(cuts, cuts[1:])]
        return out or [Files("", 0, 0)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, at = _open(partition.path)
        with fs.open_input_file(at) as file:
            yield from self._batches(partition, _Gzip(file) if partition.path.endswith(".gz") else _Plain(file, partition.start))

    def _batches(self, partition: Files, file: _Plain) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._records(partition, file):
            rows.append(row)
            held += len(row["payload"] or b"") + 500
            if len(rows) == 5000 or held > (8 << 20):
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("offset", pa.int64()), *[(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in HEADERS], ("verified", pa.bool_()), ("payload", pa.binary())]))

    def _records(self, partition: Files, file: _Plain) -> Iterator[dict]:
        while partition.end is None or file.at < partition.end:
            while file.fill(2) and file.held[:2] == b"\r\n":
                file.skip(2)
            start = file.at
            if partition.end is not None and start >= partition.end:
                return
            block = file.until(b"\r\n\r\n")
            if block is None:
                if file.held.strip():
                    raise ValueError(f"{partition.path} ends within a header at {start}")
                return
            if not block.startswith(b"WARC/"):
                raise ValueError(f"{partition.path} has no record at {start}")
            header = parse_header(block)
            length = int(header.get("content-length", 0))
            row = {c: header.get(h) for c, h in HEADERS.items()}
            row["payload_digest"] = hex_digest(row["payload_digest"])
            row |= {"payload_bytes": int(row["payload_bytes"]) if row["payload_bytes"] else length, "path": partition.path, "offset": start, "payload": None, "verified": None}
            wanted = all(_holds(f, row) for f in self.filters)
            data = None
            if wanted and (self.payload or self.verify) and row["record_type"] != "revisit":
                data = file.take(length)
            if len(data) < length if data is not None else not file.skip(length):
                raise ValueError(f"{partition.path} ends within the record at {start}")
            if not wanted:
                continue
            if data is not None:
                if self.verify and row["payload_digest"]:
                    row["verified"] = hashlib.sha1(data).hexdigest() == row["payload_digest"] and row["payload_bytes"] == length
                    if not row["verified"]:
                        raise ValueError(f"the payload at {start} of {partition.path} does not have its digest")
                row["payload"] = data if self.payload else None
            yield row


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path). Options: payload (true), verify (false)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of SCHEMA, one for each record under `path`; filters on header columns reach the reader."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("warc")
    for k, v in options.items():
        reader = reader.option(k, str(v).lower())
    return reader.load(path)


def index_archive(spark: SparkSession, path: str, every: int = RANGE) -> None:
    """Writes beside the archive's files where a record begins in each `every` bytes of a plain one; readers then cut files there.

    A payload may hold text that looks like a record, so only a walk over the headers finds where records begin. It is done once
    for each file, over headers alone, and not by each reader of a range again.
    """
    rows = read_warc(spark, path, payload=False).select("path", "offset").where(~F.col("path").endswith(".gz"))
    marks = rows.groupBy("path", F.floor(F.col("offset") / every)).agg(F.min("offset").alias("offset")).select("path", "offset")
    marks.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{OFFSETS}")


def archived_pages(archive: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive that write_pages made."""
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1), '') as bigint)")
    return archive.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def gzip_record(block: bytes) -> bytes:
    """One record as a gzip member of its own, as archives on the web hold them."""
    out = io.BytesIO()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out.write(z.compress(block) + z.flush())
    return out.getvalue()
