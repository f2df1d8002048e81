"""Batch scoring with a model that the caller brings (labels of inference, captions, embeddings)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def score_with_model(df: DataFrame, make_predict: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], outputs: str, columns: Sequence[str] | None = None, batch: int = 1024) -> DataFrame:
    """``df`` plus the columns of ``outputs`` (a DDL string), as ``make_predict()`` gives them for batches of rows.

    ``make_predict`` is called once in a task; the frame it gets has ``columns`` (all by default).
    """
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(outputs)
    schema = StructType([*df.schema.fields, *extra.fields])
    names = [f.name for f in extra.fields]
    given = list(columns or df.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].reset_index(drop=True)
                made = predict(part[given])
                for n in names:
                    part[n] = list(made[n])
                yield part

    return df.mapInPandas(run, schema)
