"""Captured responses as WARC files: a writer in DataFrame functions, and a Python data source that reads byte ranges.

Every response is a ``response`` record with its HTTP message; an attempt that
failed without one is a ``metadata`` record with the error. The source plans
one task for each range of ``splitBytes`` of each file; a record belongs to the
range that its first byte is in. Inside a range records are read by their
Content-Length. A range that does not begin the file looks for the first mark
of a record after which the length leads to another mark or the file's end, so
a mark inside a body is not taken for one unless the body imitates a whole
chain of records. Files are read through ``pyarrow.fs``, which knows local and
the usual shared file systems.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

_EOL, _MARK = "\r\n", b"WARC/1.0\r\n"
SPLIT_BYTES = 64 << 20
#: Bytes read at a time while looking for a mark, and the longest header.
_WINDOW, _HEADER = 1 << 20, 1 << 16


def _line(c: Column) -> Column:
    """A header's value: what would end the line, or the header, becomes a space."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " ")


def write_captures(responses: DataFrame, path: str) -> None:
    """``responses`` (id, attempt, status, headers, body, error) as WARC files below ``path``, one a task."""
    body = F.coalesce(F.col("body").cast("string"), F.lit(""))
    heads = F.array_join(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.concat(_line(e["key"]), F.lit(": "), _line(e["value"]), F.lit(_EOL))), "")
    http = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" -" + _EOL), heads, F.lit(_EOL), body)
    # an attempt without a status keeps what came with it in a message of its own
    failed = F.concat(F.lit("fetch-error: "), _line(F.col("error")), F.lit(_EOL), heads, F.lit(_EOL), body)
    block = F.when(F.col("status").isNotNull(), http).otherwise(failed)
    kind = F.when(F.col("status").isNotNull(), "response").otherwise("metadata")
    error = F.when(F.col("error").isNotNull() & F.col("status").isNotNull(), F.concat(F.lit("Capture-Error: "), _line(F.col("error")), F.lit(_EOL))).otherwise("")
    named = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("attempt").cast("string"), F.sha2(block.cast("binary"), 256)), 256)
    head = F.concat(
        F.lit(_MARK.decode()), F.lit("WARC-Type: "), kind, F.lit(_EOL + "WARC-Record-ID: <urn:sha256:"), named, F.lit(">" + _EOL + "Capture-Id: "), F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit(_EOL + "Capture-Attempt: "), F.coalesce(F.col("attempt").cast("string"), F.lit("")), F.lit(_EOL), error, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_EOL + _EOL),
    )
    responses.select(F.concat(head, block).alias("value")).write.option("lineSep", _EOL + _EOL).text(path)


class CapturedResponses(DataSource):
    """``spark.read.format("captures").option("splitBytes", n).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return "id long, attempt int, status int, headers map<string,string>, body binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, max(1, split)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on id and status is applied before bodies are read; everything else is Spark's."""
        for f in filters:
            known = isinstance(f, (EqualTo, In)) and f.attribute in (("id",), ("status",))
            if not known:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            name = f.attribute[0]
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = _open_system(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                out += [Range(f.path, a, min(a + self.split, f.size)) for a in range(0, f.size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        system, _ = _open_system(self.path)
        with system.open_input_file(part.path) as f:
            yield from records(f, part.start, part.end, self.wanted)


def _open_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(f, at: int) -> tuple[dict[str, str], int] | None:
    """The fields of the record header at ``at`` and where its block begins; None if there is none."""
    f.seek(at)
    raw = f.read(_HEADER)
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(_MARK) or end < 0:
        return None
    lines = [x.partition(b":") for x in raw[len(_MARK) : end].split(b"\r\n")]
    fields = {k.decode("latin-1").lower(): v.strip().decode("utf-8", "replace") for k, _, v in lines}
    return (fields, at + end + 4) if fields.get("content-length", "").isdigit() else None


def _first(f, start: int, end: int, size: int) -> int:
    """Where the first record that begins in the range begins; ``end`` if none does."""
    at = start
    while at < end:
        f.seek(at)
        window = f.read(_WINDOW + len(_MARK))
        if not window:
            return end
        place = window.find(_MARK)
        if place < 0 or at + place >= end:
            at += _WINDOW
            continue
        at += place
        head = _header(f, at)
        if head:
            follows = head[1] + int(head[0]["content-length"]) + 4
            if follows == size or (follows < size and _header(f, follows)):
                return at
        at += 1
    return end


def records(f, start: int, end: int, wanted: dict[str, set]) -> Iterator[tuple]:
    """Rows of the records that begin in the range."""
    f.seek(0, 2)
    size = f.tell()
    at = 0 if start == 0 else _first(f, start, end, size)
    while at < end:
        head = _header(f, at)
        if head is None:
            raise ValueError(f"no record at byte {at}")
        fields, block = head
        length = int(fields["content-length"])
        whole = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None  # noqa: E731, B023
        id, attempt = whole("capture-id"), whole("capture-attempt")
        if "id" not in wanted or id in wanted["id"]:
            row = _row(f, block, length, fields, id, attempt, wanted)
            if row:
                yield row
        at = block + length + 4


def _row(f, block: int, length: int, fields: dict[str, str], id: int | None, attempt: int | None, wanted: dict[str, set]) -> tuple | None:
    f.seek(block)
    raw = f.read(min(length, _HEADER))
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raw += f.read(length - len(raw))
        end = raw.find(b"\r\n\r\n")
    first, *lines = raw[:end].decode("utf-8", "replace").split(_EOL)
    status, error = None, fields.get("capture-error")
    if fields.get("warc-type") == "response":
        status = int(first.split(" ")[1])
    else:
        error = first.partition(": ")[2]
    if "status" in wanted and status not in wanted["status"]:
        return None
    if len(raw) < length:
        raw += f.read(length - len(raw))
    headers = {k: v for k, _, v in (x.partition(": ") for x in lines if x)}
    body = raw[end + 4 :]
    return id, attempt, status, headers, body or None, error


def read_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The responses below ``path``; an empty body is read as null."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedResponses)
    return spark.read.format("captures").option("splitBytes", split_bytes).load(path)
