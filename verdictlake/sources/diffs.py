"""Diff tables: changed lines of many diffs, one error row for a malformed one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from ..functions.diffs import BadDiff, changed_lines


def parse_diffs(diffs: DataFrame, *, key: str = "id", text: str = "diff") -> DataFrame:
    """(key, file, line, error): distinct changed lines; of a malformed diff only its error."""
    kind = diffs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(k, f, n, None) for f, n in dict.fromkeys(changed_lines(d or ""))]
                except BadDiff as e:
                    rows.append((k, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], [key, "file", "line", "error"])

    bound_batches(diffs.sparkSession)
    return diffs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, file string, line long, error string")
