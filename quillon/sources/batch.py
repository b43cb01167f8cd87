"""Fault-isolated batch runs: one code path for one document and for many."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.shipping import ship


def isolated(rows: DataFrame, record: Callable[[dict], dict], schema: str, keep: list[str]) -> DataFrame:
    """record(row) for every row, in Arrow batches; a row that raises has nulls, the kept columns and an error."""
    out = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    names = out.fieldNames()

    def run(batches):
        for pdf in batches:
            got = []
            for row in pdf.to_dict("records"):
                try:
                    got.append(record(row) | {"error": None})
                except Exception as e:  # the point of this function: no row may fail the job
                    got.append({k: row[k] for k in keep} | {"error": f"{type(e).__name__}: {e}"})
            frame = pd.DataFrame(got, columns=[*names, "error"])
            for f in out.fields:
                if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                    frame[f.name] = frame[f.name].astype("Int64")
            yield frame

    ship(rows.sparkSession)
    return rows.mapInPandas(run, schema + ", error string")
