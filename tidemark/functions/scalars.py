"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of sizes, in order of magnitude.
PREFIXES = ("", "k", "M", "G", "T", "P", "E")
IEC_PREFIXES = ("", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei")


def parse_size(text: Column, unit: str = "") -> Column:
    """Bytes in a size such as '10 GiB', '5k' or '7'; SI prefixes are powers of 1000, IEC ones of 1024.  Null if it is none.

    unit: the prefix of a number with neither prefix nor B; a small letter is an SI prefix, a capital an IEC one.
    """
    form = r"^\s*([0-9]+)\s*([kmgtpeKMGTPE]?)(i?)([bB]?)\s*$"
    number, prefix, binary, byte = (F.regexp_extract(text, form, n) for n in (1, 2, 3, 4))
    power = F.instr(F.lit("kmgtpe"), F.lower(prefix))
    base = F.when(binary == "i", F.lit(1024)).otherwise(F.lit(1000))
    factor = F.when(prefix == "", F.lit(1)).otherwise(F.pow(base.cast("double"), power.cast("double")).cast("bigint"))
    if unit:
        own = (1024 if unit.isupper() else 1000) ** ("kmgtpe".index(unit.lower()) + 1)
        factor = F.when((prefix == "") & (byte == ""), F.lit(own)).otherwise(factor)
    return F.when(text.rlike(form) & ~((prefix == "") & (binary == "i")), number.cast("bigint") * factor)


def _format(size: Column, base: int, prefixes: tuple[str, ...]) -> Column:
    x = size.cast("double")
    out = F.lit(None).cast("string")
    for k in reversed(range(len(prefixes))):
        text = F.format_string("%.3f " + prefixes[k], x / F.lit(float(base**k)))
        out = text if k == len(prefixes) - 1 else F.when(x < float(base ** (k + 1)), text).otherwise(out)
    return out


def format_si(size: Column) -> Column:
    return _format(size, 1000, PREFIXES)


def format_iec(size: Column) -> Column:
    return _format(size, 1024, IEC_PREFIXES)


def div_ceil(a: Column, b: Column) -> Column:
    return (((a + b - 1) - F.pmod(a + b - 1, b)) / b).cast("bigint")


def ilog2_floor(x: Column) -> Column:
    """Of a positive bigint, by its binary digits, so that no rounding is involved."""
    return F.length(F.bin(x)) - 1


def ilog2_ceil(x: Column) -> Column:
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1)))


def round_up_to_power_of_two(x: Column) -> Column:
    return F.when(x <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(x - 1))))


def wrap(x: Column, bits: int) -> Column:
    """x modulo 2^bits, as unsigned numbers of so many bits behave (40 and 48 bits fit a bigint)."""
    return F.pmod(x.cast("decimal(38,0)"), F.lit(1 << bits).cast("decimal(38,0)")).cast("bigint" if bits < 63 else "decimal(20,0)")


def multiplicative_hash(x: Column) -> Column:
    """x * 2654435761 on unsigned 32-bit numbers (the factor is a fixed value)."""
    return wrap(wrap(x, 32) * F.lit(2654435761).cast("decimal(20,0)"), 32)


def linear_congruential(x: Column) -> Column:
    """The successor of x in the generator x * 1664525 + 1013904223 on 32 bits (fixed values)."""
    return wrap(x.cast("decimal(38,0)") * 1664525 + 1013904223, 32)


def varint(x: Column) -> Column:
    """x (not negative) as bytes of seven bits, lowest first; the high bit says that more follow."""
    n = F.when(x <= 0, F.lit(1)).otherwise(F.floor((F.length(F.bin(x)) + 6) / 7).cast("int"))

    def byte(i: Column) -> Column:
        low = F.call_function("shiftright", x.cast("bigint"), (i * 7).cast("int")).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(F.when(i < n - 1, low + 128).otherwise(low)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), ""))


def from_varint(data: Column) -> Column:
    """The number that varint wrote."""
    digits = F.hex(data)
    n = F.floor(F.length(digits) / 2).cast("int")

    def part(i: Column) -> Column:
        value = F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        return F.call_function("shiftleft", value.bitwiseAND(F.lit(127)), (i * 7).cast("int"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"), lambda a, i: a + part(i))


def permuted_index(pos: Column, rows: int, columns: int) -> Column:
    """Where the element at pos of a row-major rows x columns array stands once transposed."""
    return F.pmod(pos, F.lit(columns)) * rows + F.floor(pos / columns)


def to_int64(text: Column) -> Column:
    """The signed number that a string begins with, after white space; 0 if there is none, null beyond 64 bits."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")), F.lit("0")).try_cast("bigint")


def to_uint64(text: Column) -> Column:
    """The unsigned number that a string begins with, as decimal(20,0); 0 if there is none, null beyond 64 bits."""
    number = F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*\+?([0-9]+)", 1), F.lit("")), F.lit("0")).try_cast("decimal(38,0)")
    return F.when(number < F.lit(str(1 << 64)).cast("decimal(38,0)"), number).cast("decimal(20,0)")


def _plus(a: Column, b: Column) -> Column:
    """a + b on 64 bits that wrap, by halves, so that nothing overflows."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


# The steps of a well-known mix of 64-bit integers.  "add": x + ((x << n) or its complement); "xor": x ^ (x >> n).
MIX = (("add complement", 32), ("xor", 22), ("add complement", 13), ("xor", 8), ("add", 3), ("xor", 15), ("add complement", 27), ("xor", 31))


def _mixed(x: Column, step: str, n: int) -> Column:
    if step == "xor":
        return x.bitwiseXOR(F.shiftrightunsigned(x, n))
    shifted = F.shiftleft(x, n)
    return _plus(x, shifted if step == "add" else F.bitwise_not(shifted))


def mix64(x: Column) -> Column:
    """A bijection of 64-bit integers that spreads their bits, as a signed bigint (see unsigned)."""
    out = x.cast("bigint")
    for step, n in MIX:
        # Each step's value is used several times: bound by a lambda, it is computed once.
        def change(v: Column, step: str = step, n: int = n) -> Column:
            return _mixed(v, step, n)

        out = F.get(F.transform(F.array(out), lambda v: change(v)), F.lit(0))  # noqa: B023  called at once
    return out


def unsigned(x: Column) -> Column:
    """The decimal digits of a bigint read as an unsigned number."""
    return F.conv(F.hex(x), 16, 10)
