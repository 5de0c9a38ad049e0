"""User code hooks (Y01-Y03): batched Python over Arrow, never per row.

* ``map_batches``: ``dataset.map(fn, batched=True)`` -> ``mapInPandas``; the
  function receives a pandas DataFrame per Arrow batch and returns new
  columns; the caller states the output schema.
* ``apply_rows``: a row function applied through a scalar pandas UDF on a
  struct column (prefer native expressions; this is the escape hatch).
* ``batch_infer``: a model built once per task by ``model_factory`` and
  called on whole batches of text; failures become an ``error`` value (P06)
  and an optional ``confidence`` column feeds the P08 gate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, text_batches


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch (a pandas DataFrame of
    ``session.BATCH_ROWS`` rows, unless the user has set another size)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)
    text_batches(df.sparkSession)
    return df.mapInPandas(run, schema)


def apply_rows(columns: list[str], fn: Callable[[dict], object], return_type: T.DataType | str) -> Column:
    """``fn(row_dict)`` over a struct of ``columns`` via a pandas UDF."""
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)

    @F.pandas_udf(return_type)
    def _apply(s: pd.DataFrame) -> pd.Series:
        return pd.Series([fn(r) for r in s.to_dict("records")], index=s.index)
    return _apply(F.struct(*[F.col(c) for c in columns]))


def batch_infer(df: DataFrame, text_col: str, model_factory: Callable[[], Callable[[list[str]], list]],
                out_col: str = "output", with_confidence: bool = True) -> DataFrame:
    """Run a batch model over ``text_col``.

    ``model_factory()`` is called once per task and must return a callable
    mapping a list of strings to a list of outputs; an output may be a
    string or a ``(text, confidence)`` pair.  When a batch fails, its rows are
    run one by one, so that only the failing rows have an ``error`` instead of
    an output."""
    fields = [T.StructField(f.name, f.dataType, f.nullable) for f in df.schema.fields]
    fields += [T.StructField(out_col, T.StringType(), True)]
    if with_confidence:
        fields += [T.StructField("confidence", T.DoubleType(), True)]
    fields += [T.StructField("error", T.StringType(), True)]
    schema = T.StructType(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None

        def outputs(texts: list[str]) -> list[tuple]:
            nonlocal model
            if model is None:
                model = model_factory()
            res = [r if isinstance(r, tuple) else (r, None) for r in model(texts)]
            if len(res) != len(texts):
                raise ValueError(f"{len(res)} outputs for {len(texts)} texts")
            return [(t, None if c is None else float(c), None) for t, c in res]

        def one(text: str) -> tuple:
            try:
                return outputs([text])[0]
            except Exception as e:  # noqa: BLE001 - error as value
                return None, None, f"{type(e).__name__}: {e}"

        for pdf in batches:
            out = pdf.copy()
            texts = [("" if t is None else str(t)) for t in pdf[text_col].tolist()]
            try:
                res = outputs(texts)
            except Exception:  # noqa: BLE001 - the rows are run one by one
                res = [one(t) for t in texts]
            out[out_col] = [r[0] for r in res]
            if with_confidence:
                out["confidence"] = pd.Series([r[1] for r in res], index=out.index, dtype="float64")
            out["error"] = pd.Series([r[2] for r in res], index=out.index, dtype="object")
            yield out[[f.name for f in schema.fields]]
    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)
