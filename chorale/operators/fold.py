"""Streaming folds over sorted keys for rules whose next step depends on the last decision.

Rows are hashed by key, sorted inside the partition and read in Arrow batches; only the fold's small state is kept,
so neither a key nor a partition has to fit in memory.  Callers split keys at exact breaks (islands) first.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """True on the first row and wherever a column differs from the row before; nulls are equal."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= (c[1:] != c[:-1]) & ~(pd.isna(c[1:]) & pd.isna(c[:-1]))
    return new


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str,
                step: Callable, finish: Callable | None = None) -> DataFrame:
    """``step(state, rows) -> (state, rows out)`` over consecutive rows of one key, ``state`` is None at its start;
    ``finish(state) -> rows out`` at its end."""
    keys, order = list(keys), list(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            columns = [pdf[k].to_numpy() for k in keys]
            starts = [*np.flatnonzero(changes(columns)).tolist(), len(pdf)]
            out = []
            for a, b in zip(starts, starts[1:]):
                key = tuple(None if pd.isna(c[a]) else c[a] for c in columns)
                if key != current:
                    if current is not None and finish is not None:
                        out.append(finish(state))
                    current, state = key, None
                state, rows = step(state, pdf.iloc[a:b])
                out.append(rows)
            out = [o for o in out if o is not None and len(o)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if current is not None and finish is not None:
            last = finish(state)
            if last is not None and len(last):
                yield last

    # Hashing an expression of the key, not the key itself: a repartition equal to an earlier exchange would be dropped
    # as redundant, and adaptive execution may later read that exchange locally, tearing keys apart.
    sorted_rows = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInPandas(run, schema)


def fold_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], out: str, step: Callable, **late: Column) -> DataFrame:
    """``fold_sorted`` for many short keys: ``step(state, *values) -> (state, value of out)`` of each row, ``out`` is ``name type``.

    ``late`` are columns that are made after the shuffle.
    Keys are told apart by one comparison a batch, so a key of few rows costs no frame of its own.
    """
    keys, columns, name = list(keys), list(columns), out.split()[0]
    sorted_rows = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *list(order)).withColumns(late)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields) + f", {out}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            held = [pdf[k].to_numpy() for k in keys]
            fresh = changes(held)
            fresh[0] = tuple(None if pd.isna(c[0]) else c[0] for c in held) != current
            values = []
            for new, row in zip(fresh.tolist(), zip(*[pdf[c].tolist() for c in columns])):
                state, value = step(None if new else state, *row)
                values.append(value)
            current = tuple(None if pd.isna(c[-1]) else c[-1] for c in held)
            yield pdf.assign(**{name: values})

    return sorted_rows.mapInPandas(run, fields)
