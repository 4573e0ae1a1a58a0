"""Column expressions over audit events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def actor() -> Column:
    """Who acted, for detection rules: ARN, else user name, else ``unknown``."""
    return F.coalesce("user_arn", "user_name", F.lit(UNKNOWN))


def actor_or_ip() -> Column:
    return F.coalesce("user_arn", "user_name", "source_ip", F.lit(UNKNOWN))


def identity() -> Column:
    """Who acted, for sessions: ARN, user name, principal id, else ``unknown``."""
    return F.coalesce("user_arn", "user_name", "principal_id", F.lit(UNKNOWN))


def text_member(payload: str, name: str) -> Column:
    """A string member of a JSON payload; members of other types and missing ones are null."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(payload)), f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.get_json_object(payload, f"$.{name}"))


def has_member(payload: str, name: str) -> Column:
    """Whether a JSON object has the member, null values included."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), name), F.lit(False))


def whole_bytes(payload: str, name: str) -> Column:
    """A number member as long: fractions cut, negatives and other types 0."""
    return F.coalesce(F.greatest(F.get_json_object(payload, f"$.{name}").try_cast("double"), F.lit(0.0)).cast("long"), F.lit(0).cast("long"))


def epoch_ms(time: Column) -> Column:
    """Milliseconds of an RFC 3339 time with date, time and offset; 0 for anything else."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return F.coalesce(F.when(time.rlike(shape), F.unix_millis(F.try_to_timestamp(F.upper(time)))), F.lit(0).cast("long"))


def arn_account(arn: Column) -> Column:
    """The fifth of the parts between colons, null where there are fewer."""
    return F.try_element_at(F.split(arn, ":"), F.lit(5))


def decimals(n: Column, size: int, places: int) -> Column:
    """n / size of a whole n as text, rounded as C does: exactly, halves to even. Spark's formats round halves up."""
    whole = F.abs(n.cast("long"))
    scale = 10**places

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def text(n: Column) -> Column:
        def parts(cut: Column) -> Column:
            rest = (n % size) * scale - cut * size
            up = (rest * 2 > size) | ((rest * 2 == size) & (cut % 2 == 1))
            units = div(n, F.lit(size)) * scale + cut + up.cast("long")
            return F.concat(div(units, F.lit(scale)).cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), places, "0"))

        return F.transform(F.array(div((n % size) * scale, F.lit(size))), parts)[0]

    return F.concat(F.when(n < 0, "-").otherwise(""), F.transform(F.array(whole), text)[0])


def readable_bytes(n: Column, largest: str = "TB") -> Column:
    """Bytes as text: 1024 a step, one decimal, from KB on to the ``largest`` unit."""
    steps = [(1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB"), (1 << 40, "TB")]
    out = F.format_string("%d B", n.cast("long"))
    for size, unit in steps[: [unit for _, unit in steps].index(largest) + 1]:
        out = F.when(n >= size, F.concat(decimals(n, size, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def fixed_bytes(n: Column, unit: str = "auto") -> Column:
    """Bytes as text with two decimals in ``unit`` (B, KB, MB, GB), or in the largest that gives 1 or more."""
    sizes = {"GB": 1 << 30, "MB": 1 << 20, "KB": 1 << 10}
    if unit == "B":
        return F.format_string("%d B", n.cast("long"))
    if unit != "auto":
        return F.concat(decimals(n, sizes[unit], 2), F.lit(f" {unit}"))
    out = F.format_string("%d B", n.cast("long"))
    for name in ("KB", "MB", "GB"):
        out = F.when(n >= sizes[name], fixed_bytes(n, name)).otherwise(out)
    return out
