"""IP addresses as sortable text keys, by column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One number of an IPv4 address, without leading zeros, and the address.
BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FOUR = rf"{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}"
#: Groups of an IPv6 address, or none.
GROUPS = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"
#: The IPv4 addresses that lookups skip - three private ranges, loopback, link-local, broadcast and
#: unspecified - and the keys of the IPv6 ones, unspecified and loopback.
PRIVATE_4 = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|169\.254\.|255\.255\.255\.255$|0\.0\.0\.0$)"
PRIVATE_6 = ("6" + "0" * 32, "6" + "0" * 31 + "1")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.transform(F.array(value), then)[0]


def number(text: Column, nth: int, pattern: str = FOUR) -> Column:
    return F.regexp_extract(text, f"^{pattern}$", nth).cast("long")


def key_4(text: Column) -> Column:
    whole = number(text, 1) * (1 << 24) + number(text, 2) * (1 << 16) + number(text, 3) * (1 << 8) + number(text, 4)
    return F.concat(F.lit("4"), F.lpad(F.lower(F.hex(whole)), 32, "0"))


def key_6(text: Column) -> Column:
    tail = rf"([0-9a-f:]*:){FOUR}"

    def hex_tail(low: Column) -> Column:
        """The IPv4 form of the last two groups in hex."""
        pairs = [F.lower(F.hex(number(low, k, tail) * 256 + number(low, k + 1, tail))) for k in (2, 4)]
        return F.concat(F.regexp_extract(low, f"^{tail}$", 1), pairs[0], F.lit(":"), pairs[1])

    def hexes(half: Column) -> Column:
        """The digits of some groups, four each; null if they are none."""
        split = F.transform(F.split(half, ":", -1), lambda g: F.lpad(g, 4, "0"))
        return F.when(half == "", F.lit("")).when(half.rlike(GROUPS), F.array_join(split, ""))

    def filled(parts: Column) -> Column:
        left, right = parts[0], F.try_element_at(parts, F.lit(2))
        short = F.when(F.length(left) + F.length(right) <= 28, F.concat(left, F.repeat(F.lit("0"), 32 - F.length(left) - F.length(right)), right))
        return F.when(F.size(parts) == 2, short).when((F.size(parts) == 1) & (F.length(left) == 32), left)

    whole = let(F.lower(text), lambda low: F.when(low.rlike(f"^{tail}$"), hex_tail(low)).otherwise(low))
    return F.concat(F.lit("6"), let(F.transform(F.split(whole, "::", -1), hexes), filled))


def ip_key(text: str | Column) -> Column:
    """The family (4 or 6) and 32 hex digits of the address: of equal length, so text order is address order. Null for
    anything that is not an address."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(f"^{FOUR}$"), key_4(text)).when(text.contains(":"), key_6(text))


def is_public(text: Column, key: Column) -> Column:
    """Whether the text is an address, of this ip_key(), that lookups do not skip; never null."""
    return ~text.rlike(PRIVATE_4) & F.coalesce(~key.isin(*PRIVATE_6), F.lit(False))
