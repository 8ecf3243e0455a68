"""Functions on byte-string keys.

Keys are BINARY: any bytes, the empty string included, ordered as unsigned bytes.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most bytes of a key, and of a key in a log record.
MAX_KEY, MAX_LOG_KEY = 65_536, 65_545
NUL = b"\x00"


def binary(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def key_of(text: Column) -> Column:
    """The UTF-8 of a string. A string with a NUL character is an error: it can't be told from a word and its payload."""
    return F.when(F.contains(text, F.lit("\x00")), F.raise_error(F.lit("a string key holds a NUL character"))).otherwise(F.encode(text, "UTF-8"))


def successor(prefix: bytes) -> bytes | None:
    """The least string above all that begin with prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def in_prefix(key: Column, prefix: bytes) -> Column:
    """Whether key begins with prefix, as a range of keys, which Parquet scans can skip row groups by."""
    above = successor(prefix)
    inside = key >= binary(prefix)
    return inside if above is None else inside & (key < binary(above))


def successor_column(prefix: Column) -> Column:
    """successor() of a column; null if there is none."""
    kept = F.regexp_replace(F.hex(prefix), "(FF)+$", "")
    last = F.conv(F.right(kept, F.lit(2)), 16, 10).cast("int") + 1
    return F.when(F.length(kept) > 0, F.unhex(F.concat(F.substring(kept, F.lit(1), F.length(kept) - 2), F.lpad(F.hex(last), 2, "0"))))


def _latin(key: Column) -> Column:
    """One character per byte, so that string functions count bytes."""
    return F.decode(key, "ISO-8859-1")


def nul_at(key: Column) -> Column:
    """1-based place of the first NUL byte, 0 if there is none."""
    return F.instr(_latin(key), F.lit("\x00"))


def word_of(key: Column) -> Column:
    """Bytes before the first NUL; null without one."""
    return F.when(nul_at(key) > 0, F.substring(key, F.lit(1), nul_at(key) - 1))


def payload_of(key: Column) -> Column:
    """Bytes after the first NUL; null without one."""
    return F.when(nul_at(key) > 0, F.substring(key, nul_at(key) + 1, F.octet_length(key)))


def composite(word: Column, payload: Column) -> Column:
    return F.concat(word, binary(NUL), payload)


def u32_be(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))


def u64_be(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def be_to_long(value: Column) -> Column:
    return F.conv(F.hex(value), 16, 10).cast("bigint")


def to_hex(key: Column) -> Column:
    return F.lower(F.hex(key))


def from_hex(text: Column) -> Column:
    """Bytes of a hex string; null if its length is odd or it holds other characters."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def crc32(key: Column) -> Column:
    return F.crc32(key)


def crc32_table() -> list[int]:
    """What each byte does to a CRC-32."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in out]
    return out


def crc32_init() -> int:
    """The register that a CRC-32 over parts starts with."""
    return 0xFFFFFFFF


def crc32_update(register: int, part: bytes) -> int:
    return zlib.crc32(part, register ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def crc32_finalize(register: int) -> int:
    return register ^ 0xFFFFFFFF


def varint(n: Column) -> Column:
    """A number in base-128 varint form: seven bits a byte, the lowest first, all but the last with the high bit set."""
    size = varint_length(n)
    parts = [F.lpad(F.hex(F.shiftright(n, 7 * i).bitwiseAND(127) + F.when(F.lit(i + 1) < size, 128).otherwise(0)), 2, "0") for i in range(9)]
    return F.unhex(F.array_join(F.slice(F.array(*parts), F.lit(1), size), ""))


def varint_length(n: Column) -> Column:
    """Bytes of a number in base-128 varint form."""
    out = F.when(n < 1 << 7, 1)
    for k in range(2, 9):
        out = out.when(n < 1 << 7 * k, k)
    return out.otherwise(9)


def label_of(sym: Column) -> Column:
    """A printable character for a byte, ? for the rest."""
    return F.when(sym.between(32, 126), F.chr(sym.cast("long"))).otherwise(F.lit("?"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Bytes that two keys have in common from the start.

    The keys are bound to a lambda's variable: a column named inside a lambda would
    give way to an alias of the same name in the same select.
    """
    def of(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        n = F.least(F.octet_length(x), F.octet_length(y))
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        differ = F.filter(places, lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
        return F.coalesce(F.get(differ, F.lit(0)) - 1, n)

    pairs = F.array(F.struct(a.alias("x"), b.alias("y")))
    return F.when(a.isNotNull() & b.isNotNull(), F.element_at(F.transform(pairs, of), 1))


def _fnv(values: pd.Series) -> pd.Series:
    def one(value):
        h = 0xCBF29CE484222325
        for b in bytes(value):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >= 1 << 63 else h

    return values.map(one, na_action="ignore").astype("Int64")


def fnv1a64(key: Column) -> Column:
    """FNV-1a of 64 bits, as a signed number. For interchange only; use xxhash64 to group."""
    return F.pandas_udf(_fnv, "bigint")(key)
