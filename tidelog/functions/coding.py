"""Byte codecs: fixed and variable-length integers, keys, checksums, printing."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.model import MAX_SEQ


def pack(seq: Column, type_: Column) -> Column:
    """Sequence number and type in one number."""
    return F.shiftleft(seq.cast("long"), 4).bitwiseOR(type_.cast("long"))


def unpack(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 4), packed.bitwiseAND(F.lit(15)).cast("int")


def internal_key(key: Column, seq: Column, type_: Column) -> Column:
    """The key's bytes, then the packed number in eight bytes, big end first and inverted, so that newer sorts first."""
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(F.bitwise_not(pack(seq, type_))), 16, "0")))


def fixed_le_hex(x: Column, width: int) -> Column:
    """Hex of ``width`` bytes of a number, little end first."""
    big = F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(2 * width))
    return F.concat(*[F.substring(big, 2 * (width - k) - 1, 2) for k in range(width)])


def varint_width(x: Column) -> Column:
    """Bytes of a non-negative number, seven bits in each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x.cast("long"))) / F.lit(7))).cast("int")


#: Holds every product of two longs.
_WIDE = "decimal(38,0)"


def _split(x: Column) -> tuple[Column, Column]:
    """Quotient and rest of a wide number by 2**63, which is what nine bytes hold."""
    nine = F.lit(Decimal(2**63)).cast(_WIDE)
    rest = (x % nine).cast(_WIDE)
    return ((x - rest) / nine).cast(_WIDE), rest


def product_varint_width(x: Column, y: Column, z: Column) -> Column:
    """:func:`varint_width` of the product of three longs, however large; a negative product must be within 64 bits."""
    x, y, z = (c.cast("long") for c in (x, y, z))
    sign = F.signum(x) * F.signum(y) * F.signum(z)
    # Logarithms tell the width, but for products so near to a power of 128 that rounding counts.
    digits = sum(F.log2(F.abs(c.cast("double"))) for c in (x, y, z)) / 7
    least, most = F.floor(digits - 1e-9), F.floor(digits + 1e-9)
    high, low = _split(x.cast(_WIDE) * y.cast(_WIDE))
    over = high * z.cast(_WIDE) + _split(low * z.cast(_WIDE))[0]  # the product by 2**63
    power = F.element_at(F.array(*[F.lit(Decimal(128**k)).cast(_WIDE) for k in range(19)]), (most - 8).cast("int"))  # 128**most by 2**63
    exact = F.when(most < 9, varint_width(x * y * z)).when(over >= power, most + 1).otherwise(most)
    width = F.when(sign > 0, F.when(least == most, most + 1).otherwise(exact)).when(sign < 0, varint_width(x * y * z)).otherwise(1)
    return width.cast("int")


def ordered_bytes(x: Column) -> Column:
    """Eight bytes of a long that sort as the numbers do."""
    return F.unhex(F.lpad(F.hex(x.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def encode_varint(x: int) -> bytes:
    if x < 0:
        raise ValueError("only non-negative numbers of 63 bits")
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def decode_varint(data: bytes, at: int = 0, limit: int = 10) -> tuple[int, int]:
    """The number at a place and the place after it."""
    x = 0
    for k in range(limit):
        if at >= len(data):
            raise ValueError("the number is cut off")
        b = data[at]
        at += 1
        x |= (b & 127) << 7 * k
        if b < 128:
            return x, at
    raise ValueError("the number is too long")


def prefixed(data: bytes) -> bytes:
    return encode_varint(len(data)) + data


def common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def separator(start: bytes, limit: bytes) -> bytes:
    """A short key with ``start <= key < limit``, for start below limit; else start."""
    n = common_prefix(start, limit)
    if n < min(len(start), len(limit)) and start[n] < 255 and start[n] + 1 < limit[n]:
        return start[:n] + bytes([start[n] + 1])
    return start


def successor(key: bytes) -> bytes:
    """A short key at or above ``key``."""
    for n, b in enumerate(key):
        if b != 255:
            return key[:n] + bytes([b + 1])
    return key


def internal_separator(start: bytes, seq: int, limit: bytes) -> tuple[bytes, int]:
    """Separator of internal keys: a shorter user key gets the largest sequence number, so that it sorts first."""
    short = separator(start, limit)
    return (short, MAX_SEQ) if len(short) < len(start) and start < short else (start, seq)


def internal_successor(key: bytes, seq: int) -> tuple[bytes, int]:
    short = successor(key)
    return (short, MAX_SEQ) if len(short) < len(key) and key < short else (key, seq)


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("int")


def _first(data: Column, n: Column, holds) -> Column:
    """The first of the places 1 to n where something holds, or null."""
    return F.when(n > 0, F.try_element_at(F.filter(F.sequence(F.lit(1), n), holds), F.lit(1)))


def _raised(data: Column, at: Column) -> Column:
    """The bytes up to a place, with one more in the last of them."""
    return F.concat(F.substring(data, F.lit(1), at - 1), F.unhex(F.lpad(F.hex(_byte(data, at).cast("long") + 1), 2, "0")))


def separator_column(start: Column, limit: Column) -> Column:
    """:func:`separator` of two binary columns."""
    n = F.least(F.length(start), F.length(limit))
    at = _first(start, n, lambda i: F.substring(start, i, F.lit(1)) != F.substring(limit, i, F.lit(1)))
    short = at.isNotNull() & (_byte(start, at) + 1 < _byte(limit, at))
    return F.when(start.isNotNull() & limit.isNotNull(), F.when(short, _raised(start, at)).otherwise(start))


def successor_column(key: Column) -> Column:
    """:func:`successor` of a binary column."""
    at = _first(key, F.length(key), lambda i: F.substring(key, i, F.lit(1)) != F.unhex(F.lit("FF")))
    return F.when(at.isNotNull(), _raised(key, at)).otherwise(key)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C, optionally going on from an earlier one."""
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = _CRC[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def mask(crc: int) -> int:
    """A checksum as it is stored, so that checksums of checksums stay good."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def unmask(masked: int) -> int:
    x = (masked - 0xA282EAD8) & 0xFFFFFFFF
    return (x >> 17 | x << 15) & 0xFFFFFFFF


def crc32c_column(data: Column) -> Column:
    """CRC-32C of a binary column: one lookup for each byte, inside the engine."""
    lookup = F.array(*[F.lit(x).cast("long") for x in _CRC])

    def step(crc: Column, at: Column) -> Column:
        k = crc.bitwiseXOR(_byte(data, at).cast("long")).bitwiseAND(F.lit(255)).cast("int")
        return F.element_at(lookup, k + 1).bitwiseXOR(F.shiftrightunsigned(crc, 8))

    whole = F.aggregate(F.sequence(F.lit(1), F.length(data)), F.lit(0xFFFFFFFF).cast("long"), step)
    return F.when(F.length(data) > 0, whole.bitwiseXOR(F.lit(0xFFFFFFFF))).when(F.length(data) == 0, 0)


def mask_column(crc: Column) -> Column:
    turned = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc.bitwiseAND(F.lit(32767)), 17))
    return (turned + F.lit(0xA282EAD8)).bitwiseAND(F.lit(0xFFFFFFFF))


#: Bytes that are shown by a letter or themselves after a backslash; other bytes beyond printable ASCII by three octal digits.
SHOWN = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r", 34: '"', 92: "\\"}


def escape(data: bytes) -> str:
    """Printable text of bytes."""
    return "".join(f"\\{SHOWN[b]}" if b in SHOWN else chr(b) if 32 <= b < 127 else f"\\{b:03o}" for b in data)


def escape_column(data: Column) -> Column:
    """:func:`escape` of a binary column."""
    shown = F.create_map(*[F.lit(x) for b, c in SHOWN.items() for x in (b, c)])

    def one(at: Column) -> Column:
        b = _byte(data, at)
        octal = F.lpad(F.conv(b.cast("string"), 10, 8), 3, "0")
        return F.when(F.map_contains_key(shown, b), F.concat(F.lit("\\"), F.try_element_at(shown, b))).when((b >= 32) & (b < 127), F.char(b)).otherwise(F.concat(F.lit("\\"), octal))

    return F.when(F.length(data) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(data)), one), "")).when(F.length(data) == 0, "")


def hex_dump(data: bytes, width: int = 16) -> list[str]:
    """Lines of a place, ``width`` bytes in hex, and the printable ones."""
    rows = (data[k : k + width] for k in range(0, len(data), width))
    return [f"{k * width:08x}  {r.hex(' '):<{3 * width - 1}}  {''.join(chr(b) if 32 <= b < 127 else '.' for b in r)}" for k, r in enumerate(rows)]
