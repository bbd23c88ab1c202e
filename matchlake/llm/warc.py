"""WARC archives and a two-level capture index.

Pages are written as WARC 1.1 records by Spark's text writer: a record's text, closed by two line ends, is one row.
Of pages with equal large payloads one is a ``response``, the others are ``revisit`` records without payload that
refer to it. Pages are written by classes of size, with fewer records in a file the larger they may be, so that no
file but that of a single very long page exceeds FILE_BYTES by more than its headers. Reading parses each archive file
by the records' own lengths, without copying it.

The index holds one line for each capture: the host in reverse, the path, the page, and where the record lies. Lines
are range-sorted by these and packed into compressed blocks; a sparse directory has the first and last line key of each
block, and its root those of every 128 blocks. A search halves the root, one page of the directory, and one block until it
meets the key, and reads just the record's range from its archive. Searches for few URLs do so on the driver; one for a
table of captures does the same as a plan of three steps, in which each page of the directory meets the keys that the
root sends to it, and each block is opened once for all keys that its page sends on. The root, a row for 128,000 captures
or so, is all that is held in one place.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.scratch import Scratch, parallelism, sized

#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
#: Payload bytes of a file, and upper bounds of the payloads of each class of pages; above the last a file is a record.
FILE_BYTES = 32 << 20
CLASS_BYTES = (8 << 10, 128 << 10, 2 << 20)
LINES_PER_BLOCK = 1000
#: A page of the directory is of 2 ** PAGE_BITS blocks, and the keys sent to it are dealt to PAGE_SALTS groups.
PAGE_BITS, PAGE_SALTS = 7, 32
END = "\r\n\r\n"
_BLANK_LINE = re.compile(b"\r\n\r\n")
#: Extension fields: the page of a record, and the page whose response a revisit refers to.
PAGE, REFERS_TO = "X-Page-ID", "X-Refers-To-Page-ID"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BLOCK = "first_key string, last_key string, lines long, body binary, block long"
DIRECTORY = "page long, block long, first_key string, last_key string, file string"
ENTRY = "key string, page_id long, url string, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def safe_url(url: str) -> str:
    """The URL with control characters, blanks and non-ASCII percent-encoded, so that it fits a header line."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query``: host reversed, without port, scheme, user and fragment; empty for none.

    The key is that of the encoded URL, so a URL and the form in which its record stores it have one key.
    """
    if not url:
        return ""
    url = safe_url(url)
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host = (parts.hostname or "").rstrip(".").lower()
    except ValueError:
        return f"){url.lower()}"
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){rest.lower()}"


def _headers(kind: str, page_id: int | None, name: str, url: str | None, digest: str, refers_to: int | None, single: bool, block_bytes: int) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{name}>"]
    if page_id is not None:
        lines.append(f"{PAGE}: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {safe_url(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", *[f"WARC-Refers-To: <urn:page:{refers_to}>"] * single, f"{REFERS_TO}: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block_bytes}"]
    return "\r\n".join(lines) + END


def _record(page_id: int | None, name: str, url: str | None, html: str, digest: str, refers_to: int | None, single: bool) -> str:
    """A record without the two line ends that close it; a revisit keeps the HTTP head, which tells the payload's size."""
    size = len(html.encode())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
    kind, body = ("response", html) if refers_to is None else ("revisit", "")
    return _headers(kind, page_id, name, url, digest, refers_to, single, len(head) + (size if refers_to is None else 0)) + head + body


def parse_record(raw: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes | memoryview, int]:
    """Header fields in lower case, block, and the offset behind the record that starts at ``at``."""
    start = _BLANK_LINE.search(raw, at).end()
    lines = bytes(raw[at : start - 4]).decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])} | {"version": lines[0]}
    stop = start + int(fields["content-length"])
    return fields, raw[start:stop], stop + len(END)


def _page(value: str | None) -> int | None:
    return None if value is None else int(value)


def line_key(key: Column, page_id: Column) -> Column:
    """What lines are sorted by: the URL key, then the page, null first, as digits of one length."""
    number = (page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string")
    return F.concat(key, F.lit(" "), F.coalesce(F.lpad(number, 20, "0"), F.lit("")))


def _reaching(firsts: list[bytes], lasts: list[bytes], low: bytes, high: bytes) -> range:
    """Places of the ranges, in order, that hold any key from ``low`` to ``high``, found by halving."""
    return range(bisect_left(lasts, low), bisect_right(firsts, high))


def _ends(table: pa.Table, order: str) -> tuple[pa.Table, list[bytes], list[bytes]]:
    table = table.sort_by(order)
    return table, *([k.encode() for k in table.column(c).to_pylist()] for c in ("first_key", "last_key"))


def _found(body: bytes, keys: Iterable[tuple[bytes, bytes]]) -> Iterator[list]:
    """The entries of a block whose line keys lie within any of ``keys``, each found by halving."""
    lines = [x.split(b"\t", 1) for x in zlib.decompress(body).split(b"\n")]
    own = [k for k, _ in lines]
    for low, high in keys:
        for i in range(bisect_left(own, low), bisect_right(own, high)):
            yield json.loads(lines[i][1])


def _entries(rows: list[list]) -> pa.RecordBatch:
    kinds = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in ENTRY.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(kinds), kinds, strict=True)], schema=kinds)


class Archive:
    """Archives and index below one folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
        """Write a record per row of ``pages``, then the index; null html is the empty payload.

        Of records with equal payloads of at least REVISIT_BYTES the one with the largest page_id is the response.
        Rows that repeat its page_id are responses too, as are rows without page_id; a record without page_id
        cannot be referred to. A record is named by its page_id, where that is repeated or null by its place in the
        job as well, so names are unique; a revisit of a repeated page names the page in its extension field alone.
        Only ids and digests are shuffled; pages meet the few revisits and repeated ids by joins, broadcast behind
        a check of their size.
        """
        spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc", path)
        rows = pages.select(
            F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
        )
        digest, bytes_ = F.sha1(F.col("html").cast("binary")), F.octet_length("html")
        large = bytes_ >= REVISIT_BYTES
        seen = scratch.save(rows.select("page_id", F.when(large, F.unhex(digest)).alias("digest"), bytes_.alias("bytes")), "seen", small=True)
        repeated = seen.where("page_id is not null").groupBy("page_id").count().where("count > 1")
        repeated = scratch.save(repeated.select("page_id"), "repeated")
        known = seen.where("page_id is not null and digest is not null")
        last = scratch.save(known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "last")
        revisits = known.join(last, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
        revisits = revisits.join(repeated.select(F.col("page_id").alias("refers_to"), F.lit(True).alias("many")), "refers_to", "left")
        revisits = scratch.save(revisits.select("page_id", F.lower(F.hex("digest")).alias("digest"), "refers_to", F.col("many").isNull().alias("single")), "revisits")
        known = rows.withColumn("digest", digest).join(sized(revisits), ["page_id", "digest"], "left")
        known = known.join(sized(repeated).select("page_id", F.lit(True).alias("repeated")), "page_id", "left")
        known = known.select("page_id", "url", "html", "digest", "refers_to", F.coalesce("single", F.lit(True)), F.col("repeated").isNotNull() | F.col("page_id").isNull())
        bounds = [-1, *CLASS_BYTES, (1 << 31) - 1]
        for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
            of_class = lambda b: (b > low) & (b <= high)  # noqa: B023, E731
            if k and seen.where(of_class(F.col("bytes"))).isEmpty():
                continue

            def records(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
                part, n = TaskContext.get().partitionId(), 0
                for batch in batches:
                    for lo in range(0, batch.num_rows, 512):
                        made = []
                        for page_id, url, html, sha, refers_to, single, several in zip(*[batch.column(c).slice(lo, 512).to_pylist() for c in range(7)], strict=True):
                            name = f"{'none' if page_id is None else page_id}:{k}.{part}.{n}" if several else str(page_id)
                            made.append(_record(page_id, name, url, html, sha, refers_to, single))
                            n += 1
                        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

            to = known.where(of_class(bytes_)).mapInArrow(records, "value string").write.mode("overwrite" if k == 0 else "append").option("lineSep", END)
            to.option("maxRecordsPerFile", max(1, FILE_BYTES // high)).text(f"{path}/archives")
        archive = cls(spark, path)
        archive.build_index()
        scratch.drop("seen", "last", "revisits", "repeated")
        return archive

    def captures(self) -> DataFrame:
        """A row per record, parsed from the archive files.

        Length and digest of a response are those of the payload read; ``intact`` tells that its header states the same.
        A revisit has no payload: it states its header's, until :meth:`build_index` compares them to the response's.
        """

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw, at, rows = memoryview(content.as_buffer()), 0, []
                    while at < len(raw):
                        fields, block, after = parse_record(raw, at)
                        head = _BLANK_LINE.search(block).end()
                        size = next(int(x.split(b":")[1]) for x in bytes(block[:head]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        intact = kind == "revisit"
                        if not intact:
                            stated, digest, size = (digest, size), hashlib.sha1(block[head:]).hexdigest(), len(block) - head
                            intact = stated == (digest, size)
                        url = fields.get("warc-target-uri")
                        rows.append((url_key(url), _page(fields.get(PAGE.lower())), url, name, at, after - at, size, digest, kind, _page(fields.get(REFERS_TO.lower())), intact))
                        at = after
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ENTRY.split(", ")])

        files = self.spark.read.format("binaryFile").load(f"{self.path}/archives/*.txt").where("length > 0")
        return files.select("path", "content").mapInArrow(parse, ENTRY)

    def _compared(self, lines: DataFrame) -> DataFrame:
        """Revisits are intact if a sound response of the page that they refer to has the payload that they state.

        Those that are not take the length and digest of what is there, null for nothing.
        """
        names = [c.split()[0] for c in ENTRY.split(", ")]
        revisit = F.col("record_type") == "revisit"
        stored = lines.where(~revisit & F.col("page_id").isNotNull()).select(F.col("page_id").alias("refers_to"), F.struct("intact", "payload_bytes", "payload_digest").alias("stored"))
        needed = stored.join(lines.where(revisit).select("refers_to").distinct(), "refers_to", "left_semi")
        stored = Scratch(self.spark, "warc", self.path).save(needed.groupBy("refers_to").agg(F.array_sort(F.collect_set("stored")).alias("stored")), "stored")
        same = F.exists("stored", lambda x: x["intact"] & (x["payload_bytes"] == F.col("payload_bytes")) & (x["payload_digest"] == F.col("payload_digest")))
        compared = lines.where(revisit).join(stored, "refers_to", "left").withColumn("intact", F.coalesce(same, F.lit(False)))
        found = lambda c: F.when(F.col("intact"), F.col(c)).otherwise(F.get("stored", F.lit(0))[c]).alias(c)
        return lines.where(~revisit).unionByName(compared.select(*[found(n) if n.startswith("payload_") else n for n in names]))

    def build_index(self) -> None:
        """Range-sort the captures by key, pack lines into blocks, and write the directory of first keys."""
        names = [c.split()[0] for c in ENTRY.split(", ")]
        lines = self._compared(Scratch(self.spark, "warc", self.path).save(self.captures(), "lines"))
        lines = lines.withColumn("at", line_key(F.col("key"), F.col("page_id")))
        dealt = lines.repartitionByRange(parallelism(self.spark), "at", "offset").sortWithinPartitions("at", "offset")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, LINES_PER_BLOCK):
                    rows = batch.slice(lo, LINES_PER_BLOCK).to_pylist()
                    body = "\n".join(f"{r['at']}\t{json.dumps([r[n] for n in names])}" for r in rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows[0]["at"]]), pa.array([rows[-1]["at"]]), pa.array([len(rows)], pa.int64()), pa.array([zlib.compress(body.encode())], pa.binary())],
                        names=["first_key", "last_key", "lines", "body"],
                    )

        blocks = dealt.select("at", *names).mapInArrow(pack, "first_key string, last_key string, lines long, body binary")
        blocks.withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/blocks")
        directory = self.blocks().select(F.shiftright("block", PAGE_BITS).alias("page"), "block", "first_key", "last_key", F.col("_metadata.file_name").alias("file"))
        directory.repartitionByRange(parallelism(self.spark), "block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{self.path}/directory")
        directory.groupBy("page").agg(F.min_by("first_key", "block").alias("first_key"), F.max_by("last_key", "block").alias("last_key")).write.mode("overwrite").parquet(f"{self.path}/root")
        Scratch(self.spark, "warc", self.path).drop("lines", "stored")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCK).parquet(f"{self.path}/blocks")

    def entries(self) -> DataFrame:
        """All lines of the index, from its blocks."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column(0).to_pylist():
                    yield _entries([json.loads(line.split(b"\t", 1)[1]) for line in zlib.decompress(body).split(b"\n")])

        return self.blocks().select("body").mapInArrow(unpack, ENTRY)

    def root(self) -> pa.Table:
        return self.spark.read.schema("page long, first_key string, last_key string").parquet(f"{self.path}/root").toArrow()

    def directory(self) -> DataFrame:
        return self.spark.read.schema(DIRECTORY).parquet(f"{self.path}/directory")

    def search(self, captures: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
        """The index's entries of a table of captures ``(url, page_id)``, each URL and page looked up once, by root, directory and block."""
        root, firsts, lasts = _ends(self.root(), "page")
        shared = self.spark.sparkContext.broadcast((root.column("page").to_pylist(), firsts, lasts))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [url_key(u) for u in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(1)], names=["key", "page_id"])

        def to_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pages, first, last = shared.value
            for batch in batches:
                sent = [(pages[i], at) for at in batch.column(0).to_pylist() for i in _reaching(first, last, at.encode(), at.encode())]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in sent], pa.int64()), pa.array([at for _, at in sent], pa.string())], names=["page", "at"])

        def to_blocks(keys: pa.Table, page: pa.Table) -> pa.Table:
            page, first, last = _ends(page, "block")
            blocks = page.column("block").to_pylist()
            sent = [(blocks[i], at) for at in keys.column("at").to_pylist() for i in _reaching(first, last, at.encode(), at.encode())]
            return pa.table([pa.array([b for b, _ in sent], pa.int64()), pa.array([at for _, at in sent], pa.string())], names=["block", "at"])

        def opened(keys: pa.Table, block: pa.Table) -> pa.Table:
            wanted = sorted(k.encode() for k in keys.column("at").to_pylist())
            rows = [row for body in block.column("body").to_pylist() for row in _found(body, zip(wanted, wanted))] if wanted else []
            return pa.Table.from_batches([_entries(rows)])

        asked = captures.select(F.col(url_col).cast("string"), F.col(id_col).cast("long")).mapInArrow(keyed, "key string, page_id long")
        asked = asked.select(line_key(F.col("key"), F.col("page_id")).alias("at")).distinct().mapInArrow(to_pages, "page long, at string")
        salted = asked.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(PAGE_SALTS)).cast("int"))
        pages = self.directory().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PAGE_SALTS - 1))))
        sent = salted.groupBy("page", "salt").cogroup(pages.groupBy("page", "salt")).applyInArrow(to_blocks, "block long, at string")
        return sent.groupBy("block").cogroup(self.blocks().select("block", "body").groupBy("block")).applyInArrow(opened, ENTRY)

    def lookup(self, urls: Iterable[str]) -> list[dict]:
        """Captures of a few URLs with their payloads (none for revisits), by directory, block and range reads."""
        names, out = [c.split()[0] for c in ENTRY.split(", ")], []
        root, firsts, lasts = _ends(self.root(), "page")
        pages = root.column("page").to_pylist()
        for key in dict.fromkeys(map(url_key, urls)):
            low, high = f"{key} ".encode(), f"{key} ~".encode()
            for i in _reaching(firsts, lasts, low, high):
                page, first, last = _ends(self.directory().where(F.col("page") == pages[i]).toArrow(), "block")
                for j in _reaching(first, last, low, high):
                    file, number = page.column("file")[j].as_py(), page.column("block")[j].as_py()
                    body = self.spark.read.schema(BLOCK).parquet(f"{self.path}/blocks/{file}").where(F.col("block") == number).first().body
                    for row in _found(bytes(body), [(low, high)]):
                        entry = dict(zip(names, row, strict=True))
                        _, block, _ = parse_record(self.read_range(entry["archive"], entry["offset"], entry["length"]))
                        entry["payload"] = bytes(block[_BLANK_LINE.search(block).end() :]) if entry["record_type"] == "response" else None
                        out.append(entry)
        return out

    def read_range(self, archive: str, offset: int, length: int) -> bytes:
        """Bytes of one record, through the file system that the archive lies in."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(archive)
        stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(length))
        finally:
            stream.close()


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive one table and look every page up in the index: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact``.

    Null and empty html are payloads of 0 bytes; null URLs have an empty key; a very long page is one record;
    repeated rows are records of their own, all found by the one search for their URL and page; an empty table gives no
    archive and no rows. Other columns are ignored, whatever their names.
    """
    archive = Archive.write(pages, Scratch(pages.sparkSession, "archive").path, id_col, url_col, html_col)
    return archive.search(pages, url_col, id_col).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha1(encode(h)) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as last_id from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> last_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> last_id then last_id end as refers_to
from m
"""
