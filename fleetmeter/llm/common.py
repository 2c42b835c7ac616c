"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..session import shared_dir

#: The white space that separates words everywhere here: space and the five controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"
#: Rows, and bytes of text, that a Python task works on at once.
SLICE_ROWS = 1024
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that the frame doesn't have, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (MapType, VariantType))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; those that Spark can't hash (maps) count as JSON."""
    return F.xxhash64(*[
        F.col(quoted(f.name)) if _hashable(f.dataType) else F.to_json(F.struct(F.col(quoted(f.name)))) for f in df.schema
    ])


def word_count(text: Column) -> Column:
    """Words of a text as BIGINT, without building an array of them; null has none."""
    led = F.regexp_replace(text, rf"^[{SPACE}]++", "")
    return F.coalesce(F.length(F.regexp_replace(led, rf"[^{SPACE}]++[{SPACE}]*+", "x")), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` cuts at exactly the six characters of SPACE."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def least_texts(rows: DataFrame) -> DataFrame:
    """One row per ``doc_id``, with its ``label`` and of its ``text`` values the one with the least hash."""
    least = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return least.select("doc_id", F.col("least.text").alias("text"), "label")


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder; later steps read the files and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS rows whose ``column`` has about ``size`` bytes (one row at least)."""
    import pyarrow.compute as pc

    start = used = 0
    measure = pc.list_value_length if pa.types.is_list(batch.schema.field(column).type) else pc.binary_length
    lengths = pc.fill_null(measure(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and (i - start >= SLICE_ROWS or used + n > size):
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(
    df: DataFrame, column: str, work: Callable[[pa.RecordBatch], dict], schema: StructType | str, size: int = SLICE_BYTES
) -> DataFrame:
    """Apply ``work`` (a slice -> columns by name) to every slice of every Arrow batch; rows stay in their partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    fields, names = to_arrow_schema(kind), df.columns
    if any("." in n or "`" in n for n in names):  # mapInArrow takes names for expressions
        df = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns(names), column, size):
                out = work(part)
                yield pa.RecordBatch.from_arrays(
                    [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in fields],
                    schema=fields,
                )

    return df.mapInArrow(run, kind)
