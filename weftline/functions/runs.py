"""Group functions on numpy columns: groups are runs of sorted rows, handed over many at a time instead of one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Columns = dict[str, np.ndarray]


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys, also if it is a union. Of a union whose sides are dealt by the same keys Spark 4.1 drops the shuffle and
    then merges the partitions of each side for itself, which tears groups apart; the session is left without that shortcut."""
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return df.repartition(*keys)


def _columns(t: pa.Table) -> Columns:
    return {name: t.column(name).combine_chunks().to_numpy(zero_copy_only=False) for name in t.column_names}


def _starts(c: Columns, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(c[keys[0]]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= c[k][1:] != c[k][:-1]
    return np.flatnonzero(new)


def by_runs(df: DataFrame, keys: list[str], order: list[str], f: Callable, schema: str | StructType, rows_out: int = 20_000, together: int = 0) -> DataFrame:
    """f on every group of equal keys, its rows in `order`; like a grouped map, but without a data frame per group.

    Columns reach f as numpy arrays; key and number columns must not be null. A group is held in one task. With `together`,
    f takes a list of groups, which have about that many rows in all, and gives a list of results.
    """
    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def batch(parts: list[Columns]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[x.name] for p in parts]), type=x.type, from_pandas=x.type in (pa.string(), pa.large_string())) for x in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        parts: list[Columns] = []
        n = 0

        def groups(t: pa.Table) -> Iterator[Columns]:
            c = _columns(t)
            starts = _starts(c, keys)
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
                yield {k: v[i:j] for k, v in c.items()}

        def whole() -> Iterator[Columns]:
            nonlocal held
            for b in batches:
                if not b.num_rows:
                    continue
                last = [b.column(k)[-1] for k in keys]
                if held and [held[-1].column(k)[-1] for k in keys] == last:
                    held.append(b)  # one group goes on
                    continue
                start = int(_starts(_columns(pa.Table.from_batches([b]).select(keys)), keys)[-1])  # the last group may go on
                yield from groups(pa.Table.from_batches([*held, b.slice(0, start)]))
                held = [b.slice(start)]
            if held:
                yield from groups(pa.Table.from_batches(held))

        def results() -> Iterator[Columns]:
            if not together:
                yield from map(f, whole())
                return
            some: list[Columns] = []
            held_rows = 0
            for g in whole():
                some.append(g)
                held_rows += len(g[keys[0]])
                if held_rows >= together:
                    yield from f(some)
                    some, held_rows = [], 0
            if some:
                yield from f(some)

        for part in results():
            parts.append(part)
            n += len(part[arrow.names[0]])
            if n >= rows_out:
                yield batch(parts)
                parts, n = [], 0
        if n:
            yield batch(parts)

    return dealt_by(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, struct)
