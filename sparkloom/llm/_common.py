"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import empty, remove, scope, small_batches, written  # noqa: F401


def keyed_text(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """The key, the text and the columns in ``carry``, under fixed names, so that other columns of ``docs`` cannot clash."""
    extra = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(carry)]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra)


def id_field(docs: DataFrame, id_col: str, name: str = "id") -> T.StructField:
    return T.StructField(name, docs.schema[id_col].dataType, True)


def text_chunks(batches: Iterable[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut Arrow batches, whose second column is a text, into runs of rows with about ``max_bytes`` of text, each with its texts.

    A row with a longer text is a run of its own.
    """
    for batch in batches:
        text = batch.column(1)
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > max_bytes:
                yield batch.slice(begin, i - begin), text.slice(begin, i - begin).to_pylist()
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin), text.slice(begin).to_pylist()


def small(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has no more than so many rows; else it is shuffled."""
    return F.broadcast(table) if table.count() <= rows else table


def carried(names: Sequence[str], made: Iterable[str]) -> list[str]:
    """The columns of ``names`` that an operator can hand through: its own columns take the place of any of their names."""
    own = {n.lower() for n in made}
    return [n for n in dict.fromkeys(names) if n.lower() not in own]


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str | None]], dict]],
    max_bytes: int = 1 << 18,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Apply a function to runs of texts on the executors, through Arrow.

    ``make()`` is called once in each task and returns the function. It gets a list of texts and returns the columns
    named in ``fields``; if it returns ``row`` too, that column says from which text each output row comes (else one
    row for each text, in order). The result has the id, ``fields``, and the columns of ``docs`` named in ``carry``,
    but for those whose names the others have. A carried text is sent to Python once.
    """
    small_batches(docs.sparkSession)
    carry = carried(carry, [id_col, *(f.name for f in fields)])
    own = [c for c in carry if c != text_col or not isinstance(docs.schema[c].dataType, T.StringType)]
    place = {c: own.index(c) + 2 if c in own else 1 for c in carry}
    schema = T.StructType([id_field(docs, id_col, id_col), *fields, *(docs.schema[c] for c in carry)])
    names = [f.name for f in schema.fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for rows, texts in text_chunks(batches, max_bytes):
            columns = function(texts)
            held = [rows.column(0), *(rows.column(place[c]) for c in carry)]
            if "row" in columns:  # what isn't carried isn't repeated: a text of many lines would be copied for each of them
                at = pa.array(columns["row"], pa.int64())
                held = [c.take(at) for c in held]
            yield pa.RecordBatch.from_arrays([held[0], *(to_arrow(columns[f.name], f.dataType) for f in fields), *held[1:]], names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on and may have nothing to do with Arrow next

    return keyed_text(docs, id_col, text_col, own).mapInArrow(apply, schema)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<bigint>": pa.list_(pa.int64()),
}


def to_arrow(values: object, kind: T.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, _ARROW[kind.simpleString()])


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind), True)
