"""Column expressions for nodes, orientations and edges. Orientations are 0 (forward) and 1 (reverse)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest identifier that integer mode takes.
MAX_ID = (1 << 64) - 1


def flip(rev: Column) -> Column:
    return F.lit(1) - rev


def sign(rev: Column) -> Column:
    return F.when(rev == 0, "+").otherwise("-")


def parse_sign(field: Column) -> Column:
    """0 or 1; null for anything but a plus or minus sign."""
    return F.when(field == "+", 0).when(field == "-", 1)


def is_canonical(src: Column, src_rev: Column, dst: Column, dst_rev: Column) -> Column:
    """Edges run from the smaller node; a self-loop needs one forward end."""
    return (src < dst) | ((src == dst) & ((src_rev == 0) | (dst_rev == 0)))


def parse_id(name: Column, least: int = 1) -> Column:
    """Decimal identifier of a name, or null: digits with an optional plus sign, from ``least`` to 2**64 - 1."""
    digits = F.regexp_replace(name, r"\A\+?0*(?=[0-9])", "")
    ok = name.rlike(r"\A\+?[0-9]+\z") & (F.length(digits) <= 20)
    value = F.when(ok, digits).try_cast("decimal(20,0)")
    return F.when((value >= least) & (value <= F.lit(str(MAX_ID)).cast("decimal(20,0)")), value)


def parse_long(name: Column, least: int = 1) -> Column:
    """parse_id() as a long: null also for numbers beyond 2**63 - 1."""
    ok = name.rlike(r"\A\+?[0-9]+\z")
    value = F.when(ok, name).try_cast("bigint")
    return F.when(value >= least, value)


def shown(name: Column) -> Column:
    """A name as messages print it: bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(name.cast("string"))


def id_error(name: Column, least: int) -> Column:
    """What is wrong with an integer identifier; null if nothing is."""
    digits = F.regexp_replace(name, r"\A\+", "")
    why = F.when(name == "", "cannot parse integer from empty string").when(~digits.rlike(r"\A[0-9]+\z"), "invalid digit found in string").otherwise("number too large to fit in target type")
    text = F.concat(F.lit("Error parsing node name "), shown(name), F.lit(": "), why)
    return F.when(parse_id(name, 0).isNull(), text).when((parse_id(name, 0) == 0) & F.lit(least > 0), F.lit("Node identifier 0 is reserved for technical purposes"))
