"""Scalar functions of the reduce surface, and codecs whose byte order is the value order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arithmetic(op: str, a: Column, b: Column, lenient: bool = False) -> Column:
    """``+ - *`` checked for overflow, ``/`` always double; null if an operand is.

    Strict ones raise on overflow and division by zero; lenient ones give null, and the reduce surface drops
    such rows.
    """
    if op == "/":
        a, b = a.cast("double"), b.cast("double")
        return F.try_divide(a, b) if lenient else a / b
    strict = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
    return tried[op](a, b) if lenient else strict[op]()


def day(c: Column, kind: str) -> Column:
    """Start of the day, rounded down before 1970, too; a date stays a date."""
    return c if kind == "date32" else F.date_trunc("day", c).cast("timestamp_ntz" if kind in ("timestamp", "date64") else "timestamp")


def morton(columns: list[Column], bits: int) -> Column:
    """Bits of unsigned integers interleaved, highest first, the first column first; len * bits <= 62."""
    n, out = len(columns), F.lit(0).cast("long")
    if n * bits > 62:
        raise ValueError("the code must fit 62 bits")
    for i, c in enumerate(columns):
        for b in range(bits):
            bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            out = out + F.shiftleft(bit, b * n + n - 1 - i)
    return out


def unmorton(code: Column, n: int, bits: int) -> list[Column]:
    """The columns that morton() interleaved."""
    out = []
    for i in range(n):
        c = F.lit(0).cast("long")
        for b in range(bits):
            c = c + F.shiftleft(F.shiftright(code, b * n + n - 1 - i).bitwiseAND(F.lit(1).cast("long")), b)
        out.append(c)
    return out


def int_key(c: Column) -> Column:
    """8 bytes, big-endian, sign flipped."""
    return F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def u64_key(c: Column) -> Column:
    """8 bytes, big-endian, of a decimal(20, 0) from 0 to 2 ** 64 - 1."""
    half = F.lit(1 << 32).cast("decimal(20,0)")
    high, low = F.floor(c / half), c % half
    word = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.concat(word(high), word(low)))


def decimal_key(c: Column, scale: int) -> Column:
    """Decimals of up to 18 digits as their unscaled value."""
    return int_key((c * F.lit(10**scale).cast("decimal(19,0)")).cast("long"))


def text_key(c: Column) -> Column:
    """UTF-8 with zero bytes as 00 FF, ended by 00 00: no key is another's prefix, and order is kept."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.unhex(F.concat(F.array_join(F.transform(pairs, lambda b: F.when(b == "00", "00FF").otherwise(b)), ""), F.lit("0000")))


@F.pandas_udf(T.BinaryType())
def float_key(values):
    """8 bytes: sign flipped for positive, all bits for negative numbers; -0.0 sorts below 0.0."""
    import numpy as np
    import pandas as pd

    bits = values.to_numpy(dtype="float64", na_value=np.nan).view("u8")
    keys = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63)).astype(">u8").tobytes()
    return pd.Series([None if null else keys[8 * i : 8 * i + 8] for i, null in enumerate(values.isna())])


def capture(payload: Column, pattern: str, group: int) -> Column:
    """A capture group of a binary payload, read as Latin-1 so that each byte is a character."""
    return F.encode(F.regexp_extract(F.decode(payload, "ISO-8859-1"), pattern, group), "ISO-8859-1")
