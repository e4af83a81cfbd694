"""Scalar functions: time, decay, vectors, hashes, keys."""

from __future__ import annotations

import hashlib
import hmac
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_time(c: Column) -> Column:
    """Timestamp of RFC 3339 or ``YYYY-MM-DD HH:MM:SS[.f][±tz]`` text in UTC; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), r"^(\d{4}-\d\d-\d\d)[Tt]", "$1 "))


def decayed(importance: Column, since: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """importance * 0.5^(day boundaries / half life)."""
    return importance * F.pow(F.lit(0.5), F.datediff(now, since) / F.lit(max(half_life_days, 0.001)))


def recency(updated: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """0.5^(age in days / half life), 1 for rows from the future."""
    age = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(updated), F.lit(0)) / 86400.0
    return F.pow(F.lit(0.5), age / half_life_days)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null for different lengths or a zero vector."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Larger is nearer, for cosine, l2 (negated distance) and ip."""
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric {metric}")
    return cosine(a, b) if metric == "cosine" else -l2(a, b) if metric == "l2" else F.when(F.size(a) == F.size(b), dot(a, b))


def scope_key(tenant: Column, user: Column, agent: Column, session: Column) -> Column:
    """One key of an exact scope; a null part is empty."""
    return F.concat_ws("\u001f", *[F.coalesce(c, F.lit("")) for c in (tenant, user, agent, session)])


def task_prefix(text: Column, model: str, query: bool, override: str | None = None) -> Column:
    """The text as an embedding model wants it: with its prefix for queries or documents."""
    if override is None:
        m = model.lower()
        override = ("search_query: " if query else "search_document: ") if "nomic" in m else ("query: " if query else "passage: ") if "e5" in m else ""
    return F.concat(F.lit(override), text)


def fnv1a64(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _fnv_hex(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else f"{fnv1a64(x.encode()):016x}")


def fnv1a64_hex(c: Column) -> Column:
    return F.pandas_udf(_fnv_hex, T.StringType())(c)


def _edge_ids(memory_id: pd.Series, name: pd.Series) -> pd.Series:

    def one(m, n):
        try:
            return None if m is None or n is None else str(uuid.uuid5(uuid.UUID(m), n))
        except ValueError:
            return None

    return pd.Series([one(m, n) for m, n in zip(memory_id, name)])


def edge_id(memory_id: Column, name: Column) -> Column:
    """UUID v5 of ``name`` in the namespace of a memory's id; null where that is no UUID."""
    return F.pandas_udf(_edge_ids, T.StringType())(memory_id, name)


def hmac_sha256(secret: bytes, data: bytes) -> str:
    return hmac.new(secret, data, hashlib.sha256).hexdigest()


def signature_valid(secret: bytes, body: bytes, header: str) -> bool:
    """A webhook signature ``sha256=<hex>`` compared in constant time."""
    return hmac.compare_digest("sha256=" + hmac_sha256(secret, body), header or "")


def context_fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts of an assembled context."""
    return F.sha2(F.concat_ws("\u001e", *parts), 256)


def _histograms(image: pd.Series) -> pd.Series:
    import numpy as np

    def one(b):
        if b is None or len(b) < 3:
            return None
        a = np.frombuffer(bytes(b)[: len(b) // 3 * 3], np.uint8).reshape(-1, 3) >> 4
        h = np.concatenate([np.bincount(a[:, c], minlength=16) for c in range(3)]).astype(np.float32)
        return h / np.linalg.norm(h)

    return image.map(one)


def histogram_embedding(image: Column) -> Column:
    """16 buckets for each of three channels of raw RGB bytes, as a unit vector of 48."""
    return F.pandas_udf(_histograms, T.ArrayType(T.FloatType()))(image)


#: Dimensions of the offline embedder.
HASHED_DIMENSIONS = 64


def _hashed(text: pd.Series) -> pd.Series:
    import re

    import numpy as np

    def one(t):
        v = np.zeros(HASHED_DIMENSIONS, np.float32)
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            h = fnv1a64(w.encode())
            v[h % HASHED_DIMENSIONS] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    return text.map(one)


def hashed_embedding(text: Column | str) -> Column:
    """Offline default embedder: hashed bag of words, unit length. For tests; real models plug in as a pandas UDF."""
    return F.pandas_udf(_hashed, T.ArrayType(T.FloatType()))(text)
