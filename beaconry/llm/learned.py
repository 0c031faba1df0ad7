"""What the trained operators share: one task that fits a bounded sample, and scores as one struct column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.llm.common import give_back, released

#: Characters of all texts together that one model is fitted to.
CHARACTERS = 96 << 20


def fit(sample: DataFrame, train: Callable[[list, list], bytes], text: str, target: str) -> bytes | None:
    """The model that `train(texts, targets)` makes of a bounded sample, in one task; None of no rows.

    Texts come in the order of a hash; one that would bring them over `CHARACTERS` is left out, whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, targets, held = [], [], 0
        for batch in batches:
            for own, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held + len(own) <= CHARACTERS:
                    held += len(own)
                    texts.append(own)
                    targets.append(wanted)
        give_back()  # what Arrow held of the batches, before the fit needs room
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([train(texts, targets)], pa.binary())], names=["model"])

    rows = (
        sample.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(target).alias("target"))
        .repartition(1).sortWithinPartitions(F.xxhash64("text"), "target", "text").mapInArrow(released(run), "model binary").collect()
    )
    return bytes(rows[0]["model"]) if rows else None


def scored(docs: DataFrame, text: str, out: str, kind: T.DataType, scorer: Callable[[], Callable[[list], list]]) -> DataFrame:
    """All columns of `docs` and `out`, a struct; a column of that name is replaced.

    Each task has its own `scorer()`, which gives structs for texts and goes when the task ends.
    """
    rest = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(out, kind)])
    place = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow, score = to_arrow_type(kind), scorer()
        for batch in batches:
            found = pa.array(score(batch.column(place).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return docs.select(*rest).mapInArrow(released(run), schema)
