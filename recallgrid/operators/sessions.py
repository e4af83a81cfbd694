"""Sessions of activity: runs of events without a pause longer than a gap.

Method: secondary sort by key and time, then one linear scan per partition that
emits each session as soon as it ends, with constant memory: the open session
only, and of it the set of its types.

Defined results: a pause of more than ``gap_us`` begins a session, one of
exactly ``gap_us`` does not; equal times share a session; rows with a null key
field or time take no part; a null type counts as an event, not as a type; an
empty input gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..skew import HOT_ROWS, with_slices


def _scan(gap_us: int, sliced: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, start, end, n, types, first = None, 0, 0, 0, set(), True

        def row(last: bool):
            edge = open_key[2] > 0 and sliced and (first or last)
            return (open_key[0], open_key[1], start, end, n, len(types), edge, list(types) if edge else None)

        names = ["a", "b", "start_us", "end_us", "n_events", "n_types", "edge", "types"]
        for pdf in batches:
            if not len(pdf):
                continue
            a, b, sl = pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["_slice"].to_numpy()
            ts, ty = pdf["ts"].to_numpy(), pdf["ty"].to_numpy()
            fresh = np.ones(len(ts), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (sl[1:] != sl[:-1])
            fresh[0] = open_key != (a[0], b[0], sl[0])
            begins = fresh.copy()
            begins[1:] |= np.diff(ts) > gap_us
            begins[0] |= not fresh[0] and ts[0] - end > gap_us
            at = np.flatnonzero(begins)
            codes, values = pd.factorize(ty)
            sid = np.cumsum(begins)
            have = codes >= 0
            pairs = np.unique(sid[have] * (len(values) + 1) + codes[have])
            psid, pcode = pairs // (len(values) + 1), pairs % (len(values) + 1)
            head = len(ts) if not len(at) else at[0]
            out = []
            if head:  # the open session goes on
                end, n = int(ts[head - 1]), n + int(head)
                types.update(values[c] for c in pcode[psid == 0])
            if len(at):
                if open_key is not None:
                    out.append(row(bool(fresh[at[0]])))
                stop = np.append(at[1:], len(ts))
                per = np.bincount(psid, minlength=len(at) + 1)
                whole = len(at) - 1  # the last one stays open
                i = at[:whole]
                if whole:
                    last = fresh[stop[:whole]]
                    edge = sliced & (fresh[i] | last) & (sl[i] > 0)
                    kinds = [None] * whole
                    for j in np.flatnonzero(edge):
                        kinds[j] = [values[c] for c in pcode[psid == j + 1]]
                    yield pd.DataFrame(dict(zip(names, [a[i], b[i], ts[i], ts[stop[:whole] - 1], stop[:whole] - i, per[1 : whole + 1], edge, kinds])))
                z = at[-1]
                open_key, start, end, n, first = (a[z], b[z], sl[z]), int(ts[z]), int(ts[-1]), len(ts) - int(z), bool(fresh[z])
                types = {values[c] for c in pcode[psid == len(at)]}
            if out:
                yield pd.DataFrame(out, columns=names)
        if open_key is not None:
            yield pd.DataFrame([row(True)], columns=names)

    return run


def sessionize(df: DataFrame, tenant: str, source: str, ts_us: str, kind: str, gap_us: int, hot_rows: int = HOT_ROWS, count_from: DataFrame | None = None) -> DataFrame:
    """(tenant_id, source, start_us, end_us, duration_us, n_events, n_types), one row per session.

    A source with more than ``hot_rows`` rows is cut along time into slices that
    are scanned in different tasks; only the first and last session of a slice
    are joined afterwards, at most two rows per slice. ``count_from`` may give a
    cheaper relation with columns a, b to count sources in.
    """
    ev = df.select(F.col(tenant).alias("a"), F.col(source).alias("b"), F.col(ts_us).alias("ts"), F.col(kind).alias("ty"))
    ev = ev.filter("a is not null and b is not null and ts is not null")
    # a burst at one time is cut too: edges of slices are joined by their times
    ev, slices = with_slices(ev, ["a", "b"], "ts", hot_rows, count_from, (F.xxhash64("ty"), F.rand(7)))
    ordered = ev.repartition("a", "b", "_slice").sortWithinPartitions("a", "b", "_slice", "ts")
    found = ordered.mapInPandas(_scan(gap_us, slices > 0), "a string, b string, start_us long, end_us long, n_events long, n_types long, edge boolean, types array<string>")
    if slices:
        w = Window.partitionBy("a", "b").orderBy("start_us", "end_us")
        cut = found.filter("edge").withColumn("_p", F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        cut = cut.withColumn("_id", F.sum(F.when(F.col("_p").isNull() | (F.col("start_us") - F.col("_p") > gap_us), 1).otherwise(0)).over(w))
        cut = cut.groupBy("a", "b", "_id").agg(
            F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"), F.size(F.array_distinct(F.flatten(F.collect_list("types")))).cast("long").alias("n_types")
        )
        found = found.filter("not edge").select("a", "b", "start_us", "end_us", "n_events", "n_types").unionByName(cut.drop("_id"))
    return found.select(
        F.col("a").alias("tenant_id"), F.col("b").alias("source"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events", "n_types"
    )
