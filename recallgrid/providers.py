"""What may be plugged in. Each is a plain Python protocol; on the data path they become pandas UDFs."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    def complete(self, system: str, prompt: str) -> str: ...


class Reranker(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[float]: ...


class Authorizer(Protocol):
    def may_read(self, identity: str, tenant: str) -> bool: ...


class ToolExecutor(Protocol):
    def call(self, tool: str, arguments: dict) -> dict: ...


def embedder_udf(provider: Embedder):
    """A column function from an embedder; texts go to it in Arrow batches, failures give null vectors."""

    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(provider.embed(texts.fillna("").tolist()))
        except Exception:  # best effort, as for any enrichment
            return pd.Series([None] * len(texts))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}

    def column(c: Column | str) -> Column:
        return F.pandas_udf(run, T.ArrayType(T.FloatType()))(c)

    return column


def reranker_udf(provider: Reranker):
    """A scorer (query, content) from a reranker; a wrong number of scores or a failure gives nulls."""

    def run(query: pd.Series, content: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(query), dtype="float64")
        for q, at in query.groupby(query).groups.items():
            try:
                got = provider.rerank(q, content[at].fillna("").tolist())
            except Exception:
                continue
            if len(got) == len(at):
                out[at] = got
        return out

    run.__annotations__ = {"query": pd.Series, "content": pd.Series, "return": pd.Series}

    def column(query: Column, content: Column) -> Column:
        return F.pandas_udf(run, T.DoubleType())(query, content)

    return column


def register_sql_functions(spark) -> None:
    """The library's scalar functions for SQL text."""
    from .functions.scalars import _fnv_hex, _hashed

    spark.udf.register("fnv1a64_hex", F.pandas_udf(_fnv_hex, T.StringType()))
    spark.udf.register("hashed_embedding", F.pandas_udf(_hashed, T.ArrayType(T.FloatType())))


# Names of SQL types on a Postgres wire surface, by Spark type.
POSTGRES_TYPES = {
    "boolean": "bool", "byte": "int2", "short": "int2", "integer": "int4", "long": "int8", "float": "float4", "double": "float8", "decimal": "numeric", "string": "text", "date": "date",
    "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea", "variant": "json",
}


def wire_types(df) -> list[tuple[str, str]]:
    """(column, Postgres type) of a result; nested types go as text."""
    return [(f.name, POSTGRES_TYPES.get(f.dataType.typeName().split("(")[0], "text")) for f in df.schema]
