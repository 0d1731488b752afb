"""Deeply nested JSON records to related flat tables, in one pass.

A depth-first visitor walks each record once, with a stack of its own, and emits one row per object or value it meets: the
tag of the table it belongs to, its primary key, its parent's key, the two positions and its payload, the fields of that
table as JSON. ``write_tables`` stores the rows partitioned by tag and ``read_table`` applies that table's schema to the payload.

Defined cases: null, blank, truncated and non-object lines give no rows, nor do lines with NaN or Infinity; a byte order
mark is ignored; wrapping objects around the record, however many, and arrays or objects delivered as JSON text are opened;
an object or scalar in the place of an array counts as an array of one; null elements keep their position and give no row; a
missing value is the empty string; a field of another type than its schema's is null in its table, unless that is text,
which takes any value as JSON text. Two rows with the same key column give two sets of children. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.functions import jsontext

#: child tag: (array field in its parent, tag of its parent or None for the record, field that holds its value or None for the element)
LAYOUT = {
    "passage": ("full_text", None, "section_type"),
    "patient": ("patient", None, "patient_id"),
    "mention": ("mention", "patient", "text"),
    "entity": ("entities", None, "identifier"),
    "association": ("association", None, "patient_id"),
    "phenotype": ("phenotype", "association", None),
}
#: the schema of each table; the element itself is the field ``value`` where a table holds plain values
PAYLOAD = {
    "passage": "section_type string, offset int, text string",
    "patient": "patient_id string",
    "mention": "text string, offset int, length int",
    "entity": "identifier string, type string, offset int, length int, text string, note string",
    "association": "patient_id string",
    "phenotype": "value string",
}
_FIELDS = {tag: [tuple(f.split()) for f in schema.split(", ")] for tag, schema in PAYLOAD.items()}
_CHILDREN = {parent: [tag for tag, (_, p, _) in LAYOUT.items() if p == parent] for parent in (None, *LAYOUT)}
_COLUMNS = ["child", "pk", "parent_key", "parent_pos", "pos", "payload"]
_ROOTS = {field for field, parent, _ in LAYOUT.values() if parent is None}


def _decode(value):
    """JSON text of an array or object stands for that array or object; any other text for itself."""
    while isinstance(value, str) and value.lstrip("\ufeff \t\r\n")[:1] in ("[", "{", '"'):
        try:
            inner = jsontext.read(value.lstrip("\ufeff"))
        except ValueError:
            break
        if not isinstance(inner, (list, dict, str)) or inner == value:
            break
        value = inner
    return value


def _record(line: str | None) -> dict | None:
    """The record of one line, without wrappers."""
    if line is None:
        return None
    try:
        value = jsontext.read(line.lstrip("\ufeff"))
    except ValueError:
        return None
    while isinstance(value, dict):
        if _ROOTS & value.keys():
            return value
        inner = [x for x in map(_decode, value.values()) if isinstance(x, dict)]
        inner = [x for x in inner if _ROOTS & x.keys()] or inner
        if len(inner) != 1:
            return value
        value = inner[0]
    return None


def _elements(value) -> list:
    value = _decode(value)
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def _text(value) -> str:
    text = value if isinstance(value, str) else jsontext.write(value)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _typed(value, kind: str):
    if value is None or kind == "string":
        return None if value is None else _text(value)
    try:
        return int(value) if isinstance(value, (int, str)) and not isinstance(value, bool) else None
    except ValueError:
        return None


def _visit(key: str, record: dict) -> Iterator[tuple]:
    """The rows of one record, children right after their parent."""
    waiting = [(record, tag, key, -1) for tag in reversed(_CHILDREN[None])]
    while waiting:
        node, tag, parent_key, parent_pos = waiting.pop()
        array, _, value_field = LAYOUT[tag]
        for pos, element in enumerate(_elements(node.get(array))):
            if element is None:
                continue
            element = _decode(element) if value_field else element
            own = f"{parent_key}/{tag}:{pos}"
            # a bare value in the place of an object is that object's value
            held = element if isinstance(element, dict) and value_field else {value_field or "value": element}
            fields = {name: typed for name, kind in _FIELDS[tag] if (typed := _typed(held.get(name), kind)) is not None}
            yield tag, own, parent_key, parent_pos, pos, jsontext.write(fields)
            waiting += [(held, child, own, pos) for child in reversed(_CHILDREN[tag])]


def flatten_records(lines: DataFrame, key: str = "line_no", payload: str = "payload") -> DataFrame:
    """One row per child: key, child, pk, parent_key, parent_pos, pos, payload. No shuffle; each line is parsed once."""
    whole = lines.schema[key].dataType.simpleString() == "bigint"
    names = [key, *_COLUMNS]
    types = [pa.int64() if whole else pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    schema = f"{key} {'bigint' if whole else 'string'}, child string, pk string, parent_key string, parent_pos int, pos int, payload string"

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = _record(line)
                for row in _visit(str(k), record) if record is not None else ():
                    rows.append((k, *row))
                    if len(rows) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    keys = F.col(key) if whole else F.col(key).cast("string").alias(key)
    return lines.select(keys, F.col(payload)).mapInArrow(run, schema)


def write_tables(tagged: DataFrame, path: str) -> None:
    """Store the tagged rows, one folder per table."""
    tagged.write.mode("overwrite").partitionBy("child").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, key: str = "line_no", kind: str = "bigint") -> DataFrame:
    """One flat table of what ``write_tables`` stored, its payload opened by the table's schema; empty if no record has such a child."""
    stored = spark.read.schema(f"{key} {kind}, pk string, parent_key string, parent_pos int, pos int, payload string, child string").parquet(path)
    opened = stored.filter(F.col("child") == tag).withColumn("_p", F.from_json("payload", PAYLOAD[tag]))
    return opened.select(key, "pk", "parent_key", "parent_pos", "pos", "_p.*")


def child_values(spark: SparkSession, path: str, key: str = "line_no", kind: str = "bigint") -> DataFrame:
    """(key, child, parent_pos, pos, val) of all stored tables: each child with its value, the empty string where it has none."""
    rows = None
    for tag, (_, _, value_field) in LAYOUT.items():
        one = read_table(spark, path, tag, key, kind).select(key, F.lit(tag).alias("child"), "parent_pos", "pos", F.coalesce(value_field or "value", F.lit("")).alias("val"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
