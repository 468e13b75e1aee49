"""Running a function over the texts of a table inside one narrow Arrow stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliomill.llm.text import SLICE_BYTES, slices


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[pa.Array], dict[str, pa.Array | list]]],
    result: T.StructType,
    text: str = "text",
    carry: Sequence[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Columns ``row`` (a struct of the carried input columns) and those of ``result``.

    ``make`` is called once in each task and gives a function from a string
    array (nulls included) to one value per row for every column of
    ``result``.  Input columns sit inside ``row``, so they can't clash with
    the added ones.  No shuffle; order and number of rows are kept.
    """
    carry = list(docs.columns if carry is None else carry)
    row = F.struct(*[docs[c] for c in carry]).alias("row") if carry else F.struct(F.lit(1).alias("_")).alias("row")
    # A carried text crosses to Python once, inside the row.
    inside = carry.index(text) if carry.count(text) == 1 and docs.schema[text].dataType == T.StringType() else None
    source = docs.select(row) if inside is not None else docs.select(row, docs[text].cast("string").alias("_text"))
    schema = T.StructType([source.schema["row"], *result.fields])
    kinds = {f.name: f.type for f in to_arrow_schema(result)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column("_text") if inside is None else batch.column("row").field(inside)
            for start, part in slices(texts, limit):
                made = work(part)
                columns = [made[k] if isinstance(made[k], pa.Array) else pa.array(made[k], kind) for k, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(start, len(part)), *columns], ["row", *kinds])
            del batch, texts
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def unpacked(mapped: DataFrame, *names: str) -> DataFrame:
    """The carried columns beside the named result columns."""
    return mapped.select("row.*", *names)
