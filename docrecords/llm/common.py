"""Helpers the operators of this subpackage share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

# Bytes that end a word of letters and digits: ASCII but for 0-9 and a-z.  All else is a word's.
_ALNUM = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id's text; a null id is always held out (remainder null)."""
    return F.crc32(doc_id.cast("string")) % folds


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters (lower-cased), digits and any other character; null has none."""
    return text.lower().translate(_ALNUM).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased; null has none."""
    return text.lower().split() if text else []


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def without(df: DataFrame, names) -> DataFrame:
    """`df` without the columns an operator is about to add: its own columns win."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding them."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def add_columns(
    df: DataFrame,
    schema: str,
    rows: Callable[[], Callable[[pa.RecordBatch], list[list]]],
) -> DataFrame:
    """Add columns computed from whole Arrow batches, row by row, in the order of the rows.

    `rows()` is called once in each task and returns the function from a batch to lists of column
    values.  No shuffle; a lost task is computed again from its own input.
    """
    fields = T.StructType.fromDDL(schema)
    df = without(df, fields.names)
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(fields).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = rows()
        for batch in batches:
            values = convert(batch)
            arrays = [pa.array(v, type=t) for v, t in zip(values, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *arrays], names=[*batch.schema.names, *fields.names]
            )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields.fields]))


def shared_stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the cluster's shared folder and read it back."""
    from ..plans.stages import stage

    return stage(df, name)


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables that `shared_stage` wrote and that nothing reads any more."""
    from ..plans.stages import discard

    discard(*tables)
