"""Sequential work on many small groups: rows are dealt by key, sorted, and streamed
group after group through one Arrow exchange a partition, without a frame for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def per_group(df: DataFrame, keys: list[str], order: list, work: Callable, schema: str) -> DataFrame:
    """work(key, columns) -> rows: columns are lists of a group's values in `order`."""
    names = df.columns
    at = [names.index(k) for k in keys]
    out_schema = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out_schema)
        last, held, out = None, None, []

        def flush():
            cols = list(zip(*out, strict=True)) or [()] * len(arrow)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            marks = list(zip(*(cols[i] for i in at), strict=True))
            start = 0
            for i in range(len(marks) + 1):
                if i < len(marks) and (marks[i] == marks[start]):
                    continue
                if start < len(marks):
                    part = [c[start:i] for c in cols]
                    if last == marks[start]:
                        held = [a + b for a, b in zip(held, part, strict=True)]
                    else:
                        if held is not None:
                            out.extend(work(last, dict(zip(names, held, strict=True))))
                        last, held = marks[start], part
                start = i
            if len(out) >= 4096:
                yield flush()
        if held is not None:
            out.extend(work(last, dict(zip(names, held, strict=True))))
        if out:
            yield flush()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole groups of a stream sorted by keys (never null), with the groups' starts and the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        one = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(one.num_rows - 1, bool)
        for k in keys:
            c = one.column(k)
            new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        if len(starts) > 1:
            yield one.slice(0, starts[-1]), starts
        held = [one.slice(starts[-1])]
    if held:
        yield held[0], [0, held[0].num_rows]


def annotate(df: DataFrame, keys: list[str], order: list, needs: list[str], work: Callable, extra: str) -> DataFrame:
    """df with the columns of extra (DDL): work(columns of a group, `needs` only, as lists in
    `order`) gives a list for each of them. All other columns stay in Arrow and are never Python objects."""
    more = StructType.fromDDL(extra)
    out_schema = StructType([*df.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out_schema)
        held: list[pa.RecordBatch] = []
        last = None

        def worked(batch: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
            cols = {c: batch.column(c).to_pylist() for c in needs}
            new: list[list] = [[] for _ in more]
            for a, b in zip(bounds, bounds[1:], strict=False):
                for into, got in zip(new, work({c: v[a:b] for c, v in cols.items()}), strict=True):
                    into.extend(got)
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns)]
            columns += [pa.array(v, arrow.field(len(columns) + i).type) for i, v in enumerate(new)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        def whole() -> pa.RecordBatch:
            return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            starts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1])]
            if held and marks[0] != last:
                one = whole()
                yield worked(one, [0, one.num_rows])
                held = []
            if len(starts) > 1:  # what was held goes on in the first group, and ends there
                first = batch.slice(0, starts[1])
                if held:
                    held.append(first)
                    one = whole()
                    yield worked(one, [0, one.num_rows])
                    held, starts = [], starts[1:]
                cut = starts[-1]
                if cut > starts[0]:
                    yield worked(batch.slice(starts[0], cut - starts[0]), [x - starts[0] for x in starts])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
            last = marks[-1]
        if held:
            one = whole()
            yield worked(one, [0, one.num_rows])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)
