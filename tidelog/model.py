"""Types, options and errors of the engine."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import types as T

#: Value types of a change.
DELETION, VALUE = 0, 1
#: The largest sequence number, 56 bits.
MAX_SEQ = (1 << 56) - 1

LEVELS = 7
L0_COMPACTION_TRIGGER, L0_SLOWDOWN, L0_STOP = 4, 8, 12
MAX_FLUSH_LEVEL = 2
MIB = 1 << 20
#: A file's overlap with the level after next, and the growth of a compaction, are bounded by so many file sizes.
GRANDPARENT_FILES, EXPANSION_FILES = 10, 25
BYTES_PER_SEEK, LEAST_SEEKS = 16384, 100

LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("type", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)


class Code(Enum):
    OK = "OK"
    NOT_FOUND = "NotFound"
    CORRUPTION = "Corruption"
    NOT_SUPPORTED = "NotSupported"
    INVALID_ARGUMENT = "InvalidArgument"
    IO_ERROR = "IOError"
    FAULT = "Fault"


class StoreError(RuntimeError):
    """An error with a code."""

    code = Code.FAULT


class NotFound(StoreError):
    code = Code.NOT_FOUND


class Corruption(StoreError):
    code = Code.CORRUPTION


class NotSupported(StoreError):
    code = Code.NOT_SUPPORTED


class InvalidArgument(StoreError):
    code = Code.INVALID_ARGUMENT


class StorageFailure(StoreError):
    code = Code.IO_ERROR


def _clip(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


@dataclass(frozen=True)
class Options:
    """Settings of a store; :meth:`sanitised` brings them into their ranges."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    paranoid_checks: bool = False
    max_open_files: int = 1000
    max_file_size: int = 2 * MIB
    write_buffer_size: int = 4 * MIB
    block_size: int = 4096
    compression: str = "snappy"
    bloom_bits_per_key: int | None = None
    order_name: str = "bytewise"

    def sanitised(self) -> Options:
        return replace(
            self,
            max_open_files=_clip(self.max_open_files, 74, 50_000),
            max_file_size=_clip(self.max_file_size, MIB, 1 << 30),
            write_buffer_size=_clip(self.write_buffer_size, 64 << 10, 1 << 30),
            block_size=_clip(self.block_size, 1 << 10, 4 * MIB),
        )


def max_bytes_for_level(level: int) -> int:
    """Byte budget of a level: 10 MiB for the first two, ten times more for each level after."""
    return 10 * MIB * 10 ** max(0, level - 1)
