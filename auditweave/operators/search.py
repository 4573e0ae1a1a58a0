"""Search: a small notation of field tests becomes one predicate, which Spark plans.

``eventName=Get* userName!=ann OR errorCode=* earliest=-2h`` reads: tests in a row must all hold, OR divides
alternatives, and the time bounds hold for all of them. ``=`` is exact; a ``*`` at an end of the value makes
it a prefix, suffix or containment test without regard to ASCII case; a lone ``*`` asks for a value.
``!=`` negates a test, and events without the field then match."""

from __future__ import annotations

import re
import string
import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.schema import FIELDS

UNITS_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
#: Presets of the time bar.
PRESETS = {"1h": 3_600_000, "6h": 21_600_000, "24h": 86_400_000, "7d": 604_800_000}
PAGE, MOST = 100, 500


def ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


@dataclass(frozen=True)
class FieldTest:
    field: str
    mode: str
    value: str
    negated: bool = False


@dataclass
class Search:
    groups: list[list[FieldTest]] = field(default_factory=list)
    earliest: int | None = None
    latest: int | None = None


def words(text: str) -> list[str]:
    """Cut at white space outside double quotes; the quotes go."""
    found = re.findall(r'(?:"[^"]*(?:"|$)|[^\s"])+', text)
    return [word.replace('"', "") for word in found]


def moment(text: str, now: int) -> int:
    """Epoch milliseconds of ``now``, ``-<n><m|h|d|w>``, a whole number or an RFC 3339 time."""
    if text == "now":
        return now
    if text.startswith("-"):
        if not re.fullmatch(r"-\d+[mhdw]", text):
            raise ValueError(f"not a relative time: {text}")
        return now - int(text[1:-1]) * UNITS_MS[text[-1]]
    if re.fullmatch(r"\+?\d+", text):
        return int(text)
    read = datetime.fromisoformat(text)
    if read.tzinfo is None:
        raise ValueError(f"a time needs an offset: {text}")
    return int(read.timestamp() * 1000)


def mode_of(value: str) -> tuple[str, str]:
    if value in ("*", "**"):
        return "exists", ""
    if len(value) > 2 and value[0] == value[-1] == "*":
        return "contains", ascii_lower(value[1:-1])
    if value.endswith("*"):
        return "prefix", ascii_lower(value[:-1])
    if value.startswith("*"):
        return "suffix", ascii_lower(value[1:])
    return "exact", value


def parse(text: str | None, now: int | None = None, strict: bool = False) -> Search:
    """Read the notation. Unknown fields and words without ``=`` are passed over, or refused when strict."""
    now = int(time.time() * 1000) if now is None else now
    out, group = Search(), []
    for word in words(text or ""):
        if word.upper() == "OR":
            out.groups.append(group)
            group = []
            continue
        if word.upper() == "AND":
            continue
        name, equals, value = word.partition("=")
        if equals and name == "earliest":
            out.earliest = moment(value, now)
        elif equals and name == "latest":
            out.latest = moment(value, now)
        elif equals and name.removesuffix("!") in FIELDS:
            group.append(FieldTest(name.removesuffix("!"), *mode_of(value), negated=name.endswith("!")))
        elif strict:
            raise ValueError(f"not a test: {word}")
    out.groups = [g for g in [*out.groups, group] if g]
    return out


def test_column(test: FieldTest) -> Column:
    """The test as a Column for a filter. Only negation needs to settle nulls first; plain tests stay as they
    are, so that the scan can take them."""
    column = F.col(FIELDS[test.field])
    folded = F.translate(column, string.ascii_uppercase, string.ascii_lowercase)
    held = {
        "exists": lambda: column.isNotNull(),
        "exact": lambda: column == test.value,
        "prefix": lambda: folded.startswith(test.value),
        "suffix": lambda: folded.endswith(test.value),
        "contains": lambda: folded.contains(test.value),
    }[test.mode]()
    return ~F.coalesce(held, F.lit(False)) if test.negated else held


def predicate(search: Search) -> Column:
    """One Column for the whole search."""
    either = None
    for group in search.groups:
        every = None
        for test in group:
            every = test_column(test) if every is None else every & test_column(test)
        either = every if either is None else either | every
    out = F.lit(True) if either is None else either
    return out & between(search.earliest, search.latest)


def between(earliest: int | None, latest: int | None) -> Column:
    """Inclusive bounds on ts_ms, either of them optional. They reach the scan as pushed filters; over a
    table written by event date, add ``dates()`` so that whole days are never listed."""
    out = F.lit(True)
    if earliest is not None:
        out = out & (F.col("ts_ms") >= earliest)
    if latest is not None:
        out = out & (F.col("ts_ms") <= latest)
    return out


def dates(earliest: int | None, latest: int | None) -> Column:
    """The bounds that ``between`` implies for the partition column event_date."""
    out = F.lit(True)
    if earliest is not None:
        out = out & (F.col("event_date") >= F.lit(datetime.fromtimestamp(earliest // 1000, tz=UTC).date()))
    if latest is not None:
        out = out & (F.col("event_date") <= F.lit(datetime.fromtimestamp(latest // 1000, tz=UTC).date()))
    return out


def search(events: DataFrame, text: str | None, now: int | None = None, strict: bool = False) -> DataFrame:
    """The events that the notation asks for, unordered."""
    read = parse(text, now, strict)
    held = predicate(read)
    return events.where(held & dates(read.earliest, read.latest) if "event_date" in events.columns else held)


def compose(text: str = "", include: dict[str, str] | None = None, exclude: dict[str, str] | None = None, earliest: int | None = None, latest: int | None = None, compat: bool = False) -> Search:
    """Search text AND panel filters AND time bounds. The filters bind to every alternative of the text;
    with ``compat`` they are appended to it, so that after OR they bind to the last one only."""
    read = parse(text)
    panel = [FieldTest(f, "exact", v) for f, v in (include or {}).items()] + [FieldTest(f, "exact", v, True) for f, v in (exclude or {}).items()]
    if not read.groups:
        read.groups = [panel] if panel else []
    elif compat:
        read.groups[-1] = read.groups[-1] + panel
    else:
        read.groups = [group + panel for group in read.groups]
    read.earliest = earliest if earliest is not None else read.earliest
    read.latest = latest if latest is not None else read.latest
    return read


def preset(name: str, now: int | None = None) -> tuple[int, int]:
    now = int(time.time() * 1000) if now is None else now
    return now - PRESETS[name], now


def in_time_order(events: DataFrame) -> DataFrame:
    return events.orderBy("ts_ms", "record_id")


def page(events: DataFrame, number: int = 0, size: int = PAGE, most: int = MOST) -> DataFrame:
    """Page ``number`` (from 0) in time order."""
    size = max(1, min(size, most))
    return in_time_order(events).offset(number * size).limit(size)


def page_of_days(events: DataFrame, number: int = 0, size: int = PAGE, most: int = MOST) -> DataFrame:
    """Page ``number`` in time order, sorting only the days that hold it: the events of each day are counted first (a
    row a day), which needs no sort. Over a table written by event date, only those days are read for the page."""
    size = max(1, min(size, most))
    low, high = number * size, (number + 1) * size
    dated = "event_date" in events.columns
    day = F.col("event_date") if dated else F.to_date(F.timestamp_millis("ts_ms"))
    counts = events.groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy("day").collect()  # a row a day
    seen, skipped, days = 0, None, []
    for row in counts:
        if seen + row.n > low and seen < high:
            skipped = seen if skipped is None else skipped
            days.append(row.day)
        seen += row.n
    rows = events.where(day.between(days[0], days[-1])) if days else events.where(F.lit(False))
    return in_time_order(rows).offset(low - (skipped or 0)).limit(size)


def page_after(events: DataFrame, ts_ms: int, record_id: int, size: int = PAGE) -> DataFrame:
    """The page after an event, by key: as cheap for the last page as for the first."""
    after = (F.col("ts_ms") > ts_ms) | ((F.col("ts_ms") == ts_ms) & (F.col("record_id") > record_id))
    return in_time_order(events.where(after)).limit(size)


def total(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total"))


def list_rows(events: DataFrame) -> DataFrame:
    """The table row: id, time and eight fields, no payloads."""
    return events.select("record_id", "ts_ms", "event_time", "event_name", "event_source", "aws_region", "source_ip", "user_name", "user_arn", "error_code")


def record(events: DataFrame, record_id: int) -> DataFrame:
    return events.where(F.col("record_id") == record_id)


def field_values(events: DataFrame, name: str) -> DataFrame:
    """(record_id, value) of a searchable field; null for unknown names."""
    return events.select("record_id", (F.col(FIELDS[name]) if name in FIELDS else F.lit(None).cast("string")).alias("value"))


def payload(events: DataFrame, column: str, path: str = "$") -> DataFrame:
    """(record_id, value) at a JSON path of a payload column."""
    return events.select("record_id", F.get_json_object(column, path).alias("value"))


def tree_column(tree: dict, fields: dict[str, str]) -> Column:
    """A filter tree of and / or / not / {field, value} as a Column for a filter."""
    if "field" in tree:
        return F.col(fields[tree["field"]]) == tree["value"]
    if "not" in tree:
        return ~F.coalesce(tree_column(tree["not"], fields), F.lit(False))
    name = "and" if "and" in tree else "or"
    out = F.lit(name == "and")
    for part in tree[name]:
        out = out & tree_column(part, fields) if name == "and" else out | tree_column(part, fields)
    return out
