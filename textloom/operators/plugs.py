"""Functions of the caller's (a model's answer, correction, judgement) run over rows, a batch at a time, with each row's error kept beside it."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_results(rows: DataFrame, call: Callable[[dict], dict], schema: str, name: str = "result") -> DataFrame:
    """Add ``<name>`` (a struct of ``schema``, null if the call failed) and ``<name>_error`` (null if it did not); ``call`` gets a row as a dict
    and gives the fields it knows. Rows and columns pass through."""
    out = rows.select(*rows.columns, F.lit(None).cast("string").alias(name), F.lit(None).cast("string").alias(f"{name}_error"))
    names = out.columns

    def run(batches):
        for batch in batches:
            results, errors = [], []
            for row in batch.select(names[:-2]).to_pylist():
                try:
                    results.append(json.dumps(call(row)))
                    errors.append(None)
                except Exception as e:  # whatever a model's client raises belongs to this row alone
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            columns = [*(batch.column(k) for k in range(batch.num_columns - 2)), pa.array(results, pa.string()), pa.array(errors, pa.string())]
            yield pa.record_batch(columns, names=names)

    done = out.mapInArrow(run, out.schema)
    return done.withColumn(name, F.from_json(name, schema))
