"""Arrays in binary columns, and sums of such columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 64  # in which values are added first, so that no group takes one of every task


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; integers are not negative and take as few bytes as they need."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind != "f":
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        head += [ord("f" if a.dtype.kind == "f" else "u"), a.itemsize, len(a)]
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = np.array(head, "<i8").tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    """What pack() packed; integers as int64, those of eight bytes as uint64."""
    raw = pa.Codec("zstd").decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), asbytes=True)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 3 * count, 8).reshape(count, 3).tolist()
    at, out = 8 + 24 * count, []
    for kind, width, n in head:
        plane = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        a = np.ascontiguousarray(plane.T).reshape(-1).view(f"<{chr(kind)}{width}")
        out.append(a.astype(np.int64) if kind == ord("u") and width < 8 else a)
        at += width * n
    return out


def added(df: DataFrame, keys: str, value: str, union: bool = False) -> DataFrame:
    """The keys ("a int, b long") and, of each group, the sum of packed arrays of one length, or the union of bit sets.

    Groups are added in two steps: first about _PARTS parts of each, then these.
    """
    names = [k.split()[0] for k in keys.split(", ")]
    schema = f"{keys}, part long, {value} binary"

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for x in rows[value]:
            own = unpack(x)[0]
            total = own if total is None else total | own if union else total + own
        return rows[[*names, "part"]].iloc[:1].assign(**{value: [pack(total)]})

    parts = df.select(*names, F.pmod(F.xxhash64(value), F.lit(_PARTS)).alias("part"), value).groupBy(*names, "part").applyInPandas(add, schema)
    return parts.withColumn("part", F.lit(0).cast("long")).groupBy(*names, "part").applyInPandas(add, schema).select(*names, value)
