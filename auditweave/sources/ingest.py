"""Reading delivered audit logs: JSON, gzip and zip files of either layout, into the events table.

Files are recognised by content, not by name, so they come in through ``binaryFile``; a vectorised decoder
unpacks them, cuts them into records and these into columns, with payloads as they were delivered. A unit (a file,
or an entry of an archive) with one bad record is rejected whole and reported; the others go on."""

from __future__ import annotations

import codecs
import gzip
import io
import json
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from auditweave.functions.columns import epoch_ms, text_member
from auditweave.functions.staging import shared_folder
from auditweave.schema import COLUMNS, PATHS

NAMES = r"(?i)\.(json|gz|zip|log)$"
ENTRY_NAMES = (".json", ".gz", ".log")
GZIP = b"\x1f\x8b"
#: What the decoder passes on: records; attempts at a layout whose records do not count; a row a unit, with the number
#: of its records or the reason of its rejection.
RECORD, VOID, UNIT = "record", "void", "unit"
HEAD = [("kind", T.StringType()), ("path", T.StringType()), ("entry", T.IntegerType()), ("layout", T.StringType()), ("pos", T.LongType()), ("error", T.StringType())]
#: The columns that a record gives; the others follow from these.
GIVEN = [(name, kind) for name, kind in COLUMNS if name not in ("record_id", "ts_ms")]
DECODED = T.StructType([T.StructField(name, kind) for name, kind in HEAD + GIVEN])
Row = tuple
#: The arrays of the two layouts; the first counts if a document has both and its records fit.
LAYOUTS = ("Records", "Events")
#: Bytes read, and characters passed on, at a time.
CHUNK = 1 << 20
UNFIT = "json: a record does not fit the delivery format"


def find_files(spark: SparkSession, root: str, single: bool = False, start_ms: int | None = None, end_ms: int | None = None, archives: bool = True) -> DataFrame:
    """(path, length, content) of the log files below ``root``; with ``single`` the one file, whatever its name.

    With a time bound, folders ``YYYY/MM/DD`` of other days are not even listed (folders_in_window); files of other
    layouts stay. Without ``archives`` zip files are left to archives.read()."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if single:
        return reader.load(root).select("path", "length", "content")
    if start_ms is None and end_ms is None:
        files = reader.load(root)
    else:
        files = reader.schema(BINARY).load(files_in_window(spark, root, start_ms, end_ms))
    files = files.select("path", "length", "content").where(F.col("path").rlike(NAMES))
    return files if archives else files.where(~F.col("path").rlike(r"(?i)\.zip$"))


#: The columns of binaryFile.
BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def listing(spark: SparkSession) -> Callable[[str], list[tuple[str, bool]]]:
    """A function from a folder to (path, is a folder) of what it holds, by Spark's own file systems."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def listed(folder: str) -> list[tuple[str, bool]]:
        path = hadoop(folder)
        return [(found.getPath().toString(), found.isDirectory()) for found in path.getFileSystem(conf).listStatus(path)]

    return listed


def files_in_window(spark: SparkSession, root: str, start_ms: int | None, end_ms: int | None, listed: Callable[[str], list[tuple[str, bool]]] | None = None) -> list[str]:
    """The day folders that can hold events of [start, end), and the files that lie in no day folder.

    Folders are walked from ``root``; a folder YYYY, YYYY/MM or YYYY/MM/DD outside the window is left out with all
    below it (of whatever layout), and a day folder inside is not listed here. So what is listed grows with the window, not with the keys."""
    listed = listed or listing(spark)
    out: list[str] = []

    def walk(folder: str, date: tuple[int, ...]) -> None:
        for path, is_folder in sorted(listed(folder)):
            name = path.rstrip("/").rsplit("/", 1)[1]
            if not is_folder:
                out.append(path)
            elif re.fullmatch(r"\d{4}" if not date else r"\d{1,2}", name):
                at = (*date, int(name))
                if meets(at, start_ms, end_ms):
                    if len(at) == 3:
                        out.append(path)
                    else:
                        walk(path, at)
            else:
                walk(path, ())

    walk(root, ())
    return out


def meets(date: tuple[int, ...], start_ms: int | None, end_ms: int | None) -> bool:
    """Whether a year, month or day meets [start, end); what is no date does."""
    try:
        year, month, day = (*date, 1, 1)[:3]
        begin = datetime(year, month, day, tzinfo=UTC)
        after = (begin + timedelta(days=1)) if len(date) == 3 else datetime(year + (len(date) == 1 or month == 12), 1 if len(date) == 1 or month == 12 else month + 1, 1, tzinfo=UTC)
    except (ValueError, OverflowError):
        return True
    return (start_ms is None or after.timestamp() * 1000 > start_ms) and (end_ms is None or begin.timestamp() * 1000 < end_ms)


def in_window(path: Column, start_ms: int | None = None, end_ms: int | None = None) -> Column:
    """Whether an object key can hold events of [start, end): judged by the day in ``/YYYY/MM/DD/name``, both
    bounds optional; keys of other layouts stay. A filter on ``path`` alone, so contents are not read."""
    day = F.regexp_extract(path, r"(?:^|/)(\d+)/(\d+)/(\d+)/[^/]*$", 0)
    parts = [F.regexp_extract(path, r"(?:^|/)(\d+)/(\d+)/(\d+)/[^/]*$", k).try_cast("int") for k in (1, 2, 3)]
    text = F.format_string("%04d-%02d-%02d", *parts)
    begin = F.when(day != "", F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))
    kept = F.lit(True)
    if start_ms is not None:
        kept = kept & (begin + 86_400_000 > start_ms)
    if end_ms is not None:
        kept = kept & (begin < end_ms)
    return path.rlike(r"(?i)\.(json|gz|log)$") & F.coalesce(kept, F.lit(True))


def no_number(text: str) -> None:
    raise ValueError(f"{text} is no JSON number")


VALUES = json.JSONDecoder(parse_int=len, parse_float=len, parse_constant=no_number)
BLANK = re.compile(r"[ \t\n\r]*")


class Reader:
    """A JSON document read by chunks of text: the part that holds the next value, never all of it."""

    def __init__(self, chunks: Iterator[str]) -> None:
        self.chunks, self.text, self.at, self.ended = chunks, "", 0, False

    def more(self) -> None:
        """Holds at least twice as much as is left, so that a long value is not scanned at every chunk."""
        parts = [self.text[self.at :]]
        wanted, size = max(1, len(parts[0])), 0
        while size < wanted and not self.ended:
            chunk = next(self.chunks, None)
            self.ended = chunk is None
            parts.append(chunk or "")
            size += len(parts[-1])
        self.text, self.at = "".join(parts), 0

    def peek(self) -> str:
        """The next character but white space; empty at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in " \t\n\r":
                    return self.text[self.at]
                self.at += 1
            if self.ended:
                return ""
            self.more()

    def take(self, allowed: str) -> str:
        found = self.peek()
        if not found or found not in allowed:
            raise ValueError(f"one of {allowed} is missing")
        self.at += 1
        return found

    def value(self) -> str:
        """The text of the next value."""
        self.peek()
        while True:
            try:
                end = VALUES.raw_decode(self.text, self.at)[1]
                if end < len(self.text) or self.ended:
                    break
            except json.JSONDecodeError as error:
                cut = error.msg.startswith("Unterminated string") or error.pos > len(self.text) - 16
                if self.ended or not cut:
                    raise
            self.more()
        found, self.at = self.text[self.at : end], end
        return found


def elements(chunks: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """(layout, text) of each element of the document's members of LAYOUTS; with no text where such a member begins,
    and with an empty one where it is no array."""
    reader = Reader(chunks)
    if reader.peek() != "{":
        reader.value()
        return
    reader.take("{")
    if reader.peek() == "}":
        return
    while True:
        if reader.peek() != '"':
            raise ValueError("a name is missing")
        name = json.loads(reader.value())
        reader.take(":")
        if name in LAYOUTS:
            yield name, None
        if name in LAYOUTS and reader.peek() == "[":
            reader.take("[")
            if reader.peek() == "]":
                reader.take("]")
            else:
                while True:
                    yield name, reader.value()
                    if reader.take(",]") == "]":
                        break
        else:
            reader.value()
            if name in LAYOUTS:
                yield name, ""
        if reader.take(",}") == "}":
            break
    if reader.peek():
        raise ValueError("there is more after the document")


def chunks_of(opened: Callable[[], BinaryIO]) -> Iterator[str]:
    """The text of a stream, unpacked if it is gzip."""
    with opened() as stream:
        packed = stream.read(2) == GZIP
    decoder = codecs.getincrementaldecoder("utf-8")()
    with opened() as raw, gzip.GzipFile(fileobj=raw) if packed else raw as stream:
        while data := stream.read(CHUNK):
            yield decoder.decode(data)
    yield decoder.decode(b"", True)


def members(text: str, at: int) -> Iterator[tuple[str, object, int, int]]:
    """(name, value, begin, end) of each member of the object at ``at`` of a JSON text; the value's own text lies
    between begin and end. Numbers come as their length."""
    at = BLANK.match(text, at + 1).end()
    while text[at] != "}":
        name, at = VALUES.raw_decode(text, at)
        begin = BLANK.match(text, BLANK.match(text, at).end() + 1).end()
        value, end = VALUES.raw_decode(text, begin)
        yield name, value, begin, end
        at = BLANK.match(text, end).end()
        if text[at] == ",":
            at = BLANK.match(text, at + 1).end()


#: How a member is read, by its name in the record and in userIdentity: its column, and what it has to be.
REQUIRED = {"event_time", "event_source", "event_name", "aws_region"}
NESTED = {"session_context", "request_parameters", "response_elements", "additional_event_data"}
TOP = {path: (name, "needed" if name in REQUIRED else "raw" if name in NESTED else "text") for name, path in PATHS.items() if "." not in path}
TOP |= {"readOnly": ("read_only", "bool"), "managementEvent": ("management_event", "bool"), "requestId": ("request_id", "text"), "sharedEventId": ("shared_event_id", "text")}
IDENTITY = {path.split(".")[1]: (name, "raw" if name in NESTED else "text") for name, path in PATHS.items() if "." in path}
#: Other spellings, of which any value is accepted and only texts are kept.
SPELLINGS = {"requestID": "request_id", "sharedEventID": "shared_event_id"}
RESOURCE = {"accountId": "account_id", "type": "type", "ARN": "arn"}


class Unfit(Exception):
    """A record does not fit the delivery format."""


def text_of(value: object) -> str | None:
    """A text or null, and nothing else; a text that is no Unicode does not fit."""
    if value is not None and not isinstance(value, str):
        raise Unfit
    if value and not value.isascii():
        try:
            value.encode()
        except UnicodeEncodeError:
            raise Unfit from None
    return value


def read_members(text: str, at: int, known: dict[str, tuple[str, str]], found: dict, other: Callable[[str, object, int], None]) -> None:
    """Fills ``found`` with the columns of the known members of an object, payloads as they stand in the text. A known
    member that comes twice does not fit; ``other`` gets the rest."""
    for name, value, begin, end in members(text, at):
        if name not in known:
            other(name, value, begin)
            continue
        column, kind = known[name]
        if column in found:
            raise Unfit
        if kind == "raw":
            found[column] = None if value is None else text[begin:end]
            if column == "request_parameters" and isinstance(value, dict) and isinstance(value.get("bucketName"), str):
                found["bucket_name"] = text_of(value["bucketName"])
        elif kind == "bool":
            if value is not None and not isinstance(value, bool):
                raise Unfit
            found[column] = value
        else:
            found[column] = text_of(value)
            if kind == "needed" and value is None:
                raise Unfit


def fields_of(text: str) -> tuple:
    """The GIVEN columns of a record, whose text is a JSON value; Unfit unless it is an object whose members have the
    types of the schema, has the required ones, and has no known one twice. Unknown members are passed over."""
    at = BLANK.match(text).end()
    if text[at : at + 1] != "{":
        raise Unfit
    found: dict = {}
    spelt: dict = {}

    def other(name: str, value: object, begin: int) -> None:
        if name == "userIdentity":
            if "identity" in spelt or not isinstance(value, dict):
                raise Unfit
            spelt["identity"] = True
            read_members(text, begin, IDENTITY, found, lambda *_: None)
        elif name == "resources":
            if "resources" in found or not isinstance(value, list):
                raise Unfit
            found["resources"] = resources(text, begin, len(value))
        elif name in SPELLINGS and isinstance(value, str):
            spelt[SPELLINGS[name]] = text_of(value)

    read_members(text, at, TOP, found, other)
    if "identity" not in spelt or not REQUIRED <= found.keys():
        raise Unfit
    for column in SPELLINGS.values():
        found[column] = spelt.get(column, found.get(column))
    found.setdefault("resources", [])
    return tuple([found.get(name) for name, _ in GIVEN])


def resources(text: str, at: int, n: int) -> list[dict]:
    """The n objects of the array at ``at``."""
    out = []
    for _ in range(n):
        at = BLANK.match(text, at + 1).end()
        if text[at] != "{":
            raise Unfit
        each: dict = {}
        for name, value, _, _ in members(text, at):
            if name in RESOURCE:
                if RESOURCE[name] in each:
                    raise Unfit
                each[RESOURCE[name]] = text_of(value)
        out.append({name: each.get(name) for name in RESOURCE.values()})
        at = BLANK.match(text, VALUES.raw_decode(text, at)[1]).end()
    return out


def nested_text(text: str) -> str:
    """The record inside a lookup event: a JSON text of its own, the only member that counts."""
    at = BLANK.match(text).end()
    held = [value for name, value, _, _ in members(text, at) if name == "CloudTrailEvent"] if text[at : at + 1] == "{" else []
    if len(held) != 1 or not isinstance(held[0], str):
        raise Unfit
    return held[0]


def checked(text: str) -> str:
    """The text, if it is one JSON value."""
    end = VALUES.raw_decode(text, BLANK.match(text).end())[1]
    if BLANK.match(text, end).end() < len(text):
        raise Unfit
    return text


#: What an archive or an entry that can't be unpacked raises; encrypted ones are runtime errors.
UNREADABLE = (zipfile.BadZipFile, OSError, EOFError, zlib.error, RuntimeError)
NO_FIELDS = (None,) * len(GIVEN)


def split_unit(path: str, entry: int, opened: Callable[[], BinaryIO], lenient: bool = False) -> Iterator[Row]:
    """The records of a unit as they are read, then a row of its own: with their number, or with an error.

    An array Records is tried first. Where it is missing or holds a record that does not fit, what it gave is void and
    an array Events is tried in a second reading; if neither fits, the error is that of Records. With ``lenient``
    records that do not fit are left out instead."""
    error, n = None, 0
    for layout in LAYOUTS:
        seen, given, why = 0, 0, None
        try:
            for name, text in elements(chunks_of(opened)):
                if name != layout:
                    continue
                if text is None:
                    seen += 1
                    why = why or (UNFIT if seen > 1 else None)
                elif text == "":
                    why = UNFIT
                elif why is None:
                    try:
                        fields = fields_of(text if layout == LAYOUTS[0] else checked(nested_text(text)))
                    except (Unfit, ValueError, RecursionError):
                        why = None if lenient else UNFIT
                        continue
                    yield RECORD, path, entry, layout, given, None, *fields
                    given += 1
        except (OSError, EOFError, zlib.error) as failure:
            why = f"gzip: {failure}"
        except UnicodeDecodeError as failure:
            why = f"json: {failure}"
        except (ValueError, RecursionError):
            why = "json: not a JSON document"
        if seen and not why:
            error, n = None, given
            break
        if given:
            yield VOID, path, entry, layout, None, None, *NO_FIELDS
        if layout == LAYOUTS[0] or seen:
            error = error if error and error != "json: no Records in the document" else why or "json: no Records in the document"
        if why and not why.startswith("json: a record"):
            break  # a second reading would meet the same
    yield UNIT, path, entry, None, n, error, *NO_FIELDS


def records_of(path: str, content: bytes, lenient: bool = False) -> Iterator[Row]:
    """split_unit() of a file's units: itself, or the log entries of an archive, none of which counts unless all
    can be read."""
    if not path.lower().endswith(".zip"):
        yield from split_unit(path, 0, lambda: io.BytesIO(content), lenient)
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            entries = [name for name in archive.namelist() if name.lower().endswith(ENTRY_NAMES)]
            for k, name in enumerate(entries):
                yield from archive_entry(path, k, partial(archive.open, name), lenient)
    except UNREADABLE as error:
        yield UNIT, path, None, None, None, f"zip: {error}", *NO_FIELDS


def archive_entry(path: str, k: int, opened: Callable[[], BinaryIO], lenient: bool = False) -> Iterator[Row]:
    """split_unit() of an archive's entry; one that can't be unpacked gives a row for the whole archive, without entry."""
    torn = None
    for row in split_unit(path, k, opened, lenient):
        if row[0] == UNIT and row[5] and row[5].startswith("gzip:"):
            torn = row[5]
        yield row
    if torn:
        yield UNIT, path, None, None, None, f"zip: {torn.removeprefix('gzip: ')}", *NO_FIELDS


ARROW = to_arrow_schema(DECODED)


def row_batches(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum([len(x) for x in row if isinstance(x, str)])
        if len(held) >= 4096 or size >= CHUNK:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def packed(rows: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def decode(files: DataFrame, lenient: bool = False) -> DataFrame:
    """DECODED rows of (path, content): each unit is read once, by chunks, and never held but for one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from row_batches(records_of(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), lenient))

    return files.select("path", "content").mapInArrow(run, DECODED)


def spooled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Callable[[], BinaryIO]]]:
    """(path, a function that opens it) of each file whose parts (path, number from 1, text) follow each other, from a copy on the task's disk."""
    with tempfile.TemporaryDirectory() as folder:
        name, path, out = f"{folder}/unit", None, None
        for batch in batches:
            for at, n, text in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if n == 1:
                    if out is not None:
                        out.close()
                        yield path, partial(open, name, "rb")
                    path, out = at, open(name, "wb")
                out.write(text.encode())
        if out is not None:
            out.close()
            yield path, partial(open, name, "rb")


def decode_parts(parts: DataFrame, *order: str, lenient: bool = False) -> DataFrame:
    """DECODED rows, for load(), of plain files that come as rows (path, text, order...) of their parts: those of a path meet
    in one task, which sorts them, keeps the file on disk and reads it by chunks, whatever its size.

    The window that numbers them brings them together. A repartition() would not: Spark leaves it out where both sides of
    a union are dealt by path already, and then merges the partitions of each side in its own way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, opened in spooled(batches):
            yield from row_batches(split_unit(path, 0, opened, lenient))

    place = F.row_number().over(Window.partitionBy("path").orderBy(*order or ["path"]))
    return parts.select("path", place.alias("n"), "text").mapInArrow(run, DECODED)


def with_derived(decoded: DataFrame) -> DataFrame:
    """Decoded rows with the columns that follow from the others."""
    return decoded.withColumns({"ts_ms": epoch_ms(F.col("event_time")), "record_id": F.xxhash64("path", "entry", "pos")})


def bucket_name() -> Column:
    """The request's bucket, where it is a text."""
    return text_member("request_parameters", "bucketName")


@dataclass
class Loaded:
    """What load() gives: events with their path, entry and event_date; warnings (path, entry, error) of rejected
    units; report (path, records) of the files that have accepted ones."""

    events: DataFrame
    warnings: DataFrame
    report: DataFrame

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.events, self.warnings))


#: Rejected units up to which their list is sent to every task; beyond, events and units are joined by shuffle.
FEW = 100_000


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` but for those whose keys are in ``gone``, whose size decides how."""
    n = gone.count()
    return rows if n == 0 else rows.join(F.broadcast(gone) if n <= FEW else gone, keys, "left_anti")


def load(files: DataFrame | None, archives: DataFrame | None = None) -> Loaded:
    """(events, warnings) of find_files(), and of archives.read() if given.

    Units are decoded once and written as they are read: records, and apart from these a row for each unit. Whether
    a unit counts is known at its end, so the few records of rejected ones are left out by an anti join afterwards;
    the rows of units alone give warnings and the report."""
    parts = [part for part in (None if files is None else decode(files), archives) if part is not None]
    decoded = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    spark = decoded.sparkSession
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    full = with_derived(decoded)
    full.write.partitionBy("kind").parquet(folder)
    schema = T.StructType([field for field in full.schema if field.name != "kind"] + [full.schema["kind"]])
    read = spark.read.schema(schema).parquet(folder)
    units = read.where(F.col("kind") == UNIT).select("path", "entry", "error", F.col("pos").alias("records"))
    torn = units.where("entry IS NULL").select("path", "error").groupBy("path").agg(F.min("error").alias("error"))
    sound = without(units.where("entry IS NOT NULL"), torn.select("path"), ["path"])
    void = read.where(F.col("kind") == VOID).select("path", "entry", "layout")
    # A unit that breaks off has records of its layout too.
    records = without(read.where(F.col("kind") == RECORD), void, ["path", "entry", "layout"])
    records = without(records, torn.select("path"), ["path"])
    date = F.to_date(F.timestamp_millis("ts_ms"))
    events = records.select(*[name for name, _ in COLUMNS], "path", "entry", date.alias("event_date"))
    warnings = sound.where("error IS NOT NULL").select("path", "entry", "error").unionByName(torn.select("path", F.lit(0).alias("entry"), "error"))
    report = sound.where("error IS NULL").groupBy("path").agg(F.sum("records").alias("records")).where("records > 0")
    return Loaded(events, warnings, report)


def from_events(events: DataFrame) -> DataFrame:
    """An events table with the derived columns filled in from a table that has the others."""
    have = {name: F.col(name) if name in events.columns else F.lit(None).cast(kind) for name, kind in COLUMNS}
    if "bucket_name" not in events.columns:
        have["bucket_name"] = bucket_name()
    return events.withColumns({k: v for k, v in have.items() if k != "bucket_name"}).withColumn("bucket_name", have["bucket_name"]).select(*[name for name, _ in COLUMNS])
