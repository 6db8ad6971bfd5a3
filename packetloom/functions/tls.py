"""Application bytes of a TCP payload that carries TLS records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Record types of TLS, the one for application data, and its major version.
RECORD_TYPES = range(20, 25)
APPLICATION_DATA = 23
MAJOR_VERSION = 3
HEADER = 5


def application_bytes(payload: bytes | None, least: int = 40) -> int | None:
    """Summed length of the application-data records in one payload; None below ``least``.

    Stops at the first header that is not TLS or has no length.  A record cut off by the end of the
    payload counts in full.
    """
    total, seen, at = 0, False, 0
    while payload is not None and len(payload) - at >= HEADER:
        kind, major, size = payload[at], payload[at + 1], payload[at + 3] << 8 | payload[at + 4]
        if kind not in RECORD_TYPES or major != MAJOR_VERSION or size == 0:
            break
        if kind == APPLICATION_DATA:
            total, seen = total + size, True
        at += HEADER + size
    return total if seen and total >= least else None


def tls_application_bytes(payload: Column, least: int = 40) -> Column:
    """``application_bytes`` over a binary column, a batch at a time."""
    @F.pandas_udf(T.LongType())
    def walk(batch: pd.Series) -> pd.Series:
        return pd.Series([application_bytes(p, least) for p in batch], dtype="Int64")
    return walk(payload)
