"""Schemas that grow with the landed documents.

Lines are parsed to one VARIANT column.  A batch's own schema comes from a distributed
aggregate over it; new fields widen the stored schema, and whatever a row holds that the
stored types cannot express, up to a line that is no JSON at all, is kept as text in
``_rescued_data``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, NullType, StringType, StructField, StructType

from .. import fsio

DOCUMENT, UNPARSED = "_document", "_unparsed"
RESCUED = "_rescued_data"


class SchemaStore:
    """Numbered schema versions in a folder; the highest number is current."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, f"{location}/_schemas"

    def _versions(self) -> list[int]:
        names = [p.rsplit("/", 1)[1] for p in fsio.children(self.spark, self.location)]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def load(self) -> StructType:
        versions = self._versions()
        if not versions:
            return StructType()
        return StructType.fromJson(json.loads(fsio.read_text(self.spark, f"{self.location}/{versions[-1]}.json")))

    def save(self, schema: StructType) -> None:
        following = (self._versions() or [-1])[-1] + 1
        fsio.write_text(self.spark, f"{self.location}/{following}.json", schema.json())


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row per document: a line holds an object or an array of objects; blank lines hold none."""
    parsed = (lines.filter(F.trim("value") != "")
              .select("value", F.try_parse_json("value").alias("_parsed")))
    items = F.coalesce(F.col("_parsed").try_cast("array<variant>"), F.array("_parsed"))
    return parsed.select(F.explode(items).alias(DOCUMENT),
                         F.when(F.col("_parsed").isNull(), F.col("value")).alias(UNPARSED))


def _entries() -> Column:
    """Fields of a document by name; NULL when it is not an object.  Copies every value."""
    return F.col(DOCUMENT).try_cast("map<string,variant>")


def _is_object() -> Column:
    return F.col(DOCUMENT).try_cast("struct<_:boolean>").isNotNull()


def _keys(held: Column, path: str) -> Column:
    """Names of the fields at a path, without a copy of their values; NULL where no object is."""
    return F.map_keys(F.try_variant_get(held, path, "map<string,boolean>"))


def observed_schema(documents: DataFrame) -> StructType:
    """Schema of all objects of a frame: one short text reaches the driver."""
    objects = documents.filter(_is_object())
    described = objects.agg(F.schema_of_variant_agg(DOCUMENT).alias("s")).first()["s"]
    if not described or not described.startswith("OBJECT<") or described == "OBJECT<>":
        return StructType()
    parsed = StructType.fromDDL(f"d {_TYPES.sub(_as_ddl, described)}")["d"].dataType
    return StructType([StructField(f.name, _settled(f.dataType)) for f in parsed.fields
                       if not isinstance(f.dataType, NullType)])


# A field's name with its colon, or a type that has no name in DDL.
_TYPES = re.compile(r"((?:`(?:``|[^`])*`|[^\s<>:,`()]+)\s*:)|OBJECT<>|OBJECT(?=<)|VARIANT|DECIMAL\((\d+),\s*(\d+)\)")


def _as_ddl(found: re.Match) -> str:
    """JSON knows no decimals: fractions are doubles, integers beyond BIGINT text, like mixed types."""
    if found[1]:
        return found[1]
    if found[0].startswith("DECIMAL"):
        return "DOUBLE" if int(found[2]) - int(found[3]) <= 15 else "STRING"
    return "STRUCT" if found[0] == "OBJECT" else "STRING"


def _settled(kind: DataType) -> DataType:
    if isinstance(kind, NullType):
        return StructType.fromDDL("x STRING")["x"].dataType
    if isinstance(kind, ArrayType):
        return ArrayType(_settled(kind.elementType))
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _settled(f.dataType)) for f in kind.fields])
    return kind


def widen(stored: StructType, seen: StructType) -> StructType:
    """Stored fields in their order and type, then the new ones; nested objects grow likewise."""
    by_name = {f.name: f for f in seen.fields}
    kept = []
    for field in stored.fields:
        other = by_name.pop(field.name, None)
        kept.append(field if other is None else StructField(field.name, _widen_type(field.dataType, other.dataType)))
    return StructType([*kept, *[f for f in seen.fields if f.name in by_name]])


def _widen_type(stored: DataType, seen: DataType) -> DataType:
    if isinstance(stored, StructType) and isinstance(seen, StructType):
        return widen(stored, seen)
    if isinstance(stored, ArrayType) and isinstance(seen, ArrayType):
        return ArrayType(_widen_type(stored.elementType, seen.elementType))
    return stored


def _place(held: Column, path: str, name: str) -> tuple[Column, str]:
    """Where a field of the object at a path lies: the variant to look into, and the path in it."""
    if re.fullmatch(r"[\w -]+", name):
        return held, f"{path}['{name}']"
    # paths know no quoting
    return F.try_element_at(F.try_variant_get(held, path, "map<string,variant>"), F.lit(name)), "$"


def _extract(field: StructField) -> Column:
    place = _place(F.col(DOCUMENT), "$", field.name)
    value = F.try_variant_get(*place, field.dataType.simpleString())
    if isinstance(field.dataType, (LongType, DoubleType)):
        value = F.when(~_changed(*place, field.dataType), value)
    return value


def _changed(held: Column, path: str, kind: DataType) -> Column:
    """Whether a number's type would change it: a fraction where it has whole numbers, or digits
    a double cannot hold."""
    if isinstance(kind, LongType):
        changed = F.try_variant_get(held, path, "double") != F.try_variant_get(held, path, "bigint").cast("double")
    elif isinstance(kind, DoubleType):
        digits = F.try_variant_get(held, path, "string")
        changed = (F.length(digits) >= 16) & digits.rlike(r"^-?\d{16,}$")
    else:
        return F.lit(False)
    return F.coalesce(changed, F.lit(False))


def _exceeds(held: Column, path: str, kind: DataType) -> Column:
    """Whether the value at a path holds what its type cannot express, at any depth of objects and
    arrays: a field the type does not name, a value of another kind, or a number its type
    would change.

    Values are looked up by their path from the document or the array's item, since every
    cast to a map of variants copies all below it.
    """
    if isinstance(kind, StructType):
        typed = _keys(held, path)
        more = F.exists(typed, lambda k: ~k.isin(kind.names))
        for field in kind.fields:
            if _can_exceed(field.dataType):
                more = more | _exceeds(*_place(held, path, field.name), field.dataType)
    elif isinstance(kind, ArrayType):
        typed = F.try_variant_get(held, path, "array<variant>")
        more = (F.exists(typed, lambda item: _exceeds(item, "$", kind.elementType)) if _can_exceed(kind.elementType)
                else F.lit(False))
    else:
        typed, more = F.try_variant_get(held, path, kind.simpleString()), _changed(held, path, kind)
    value = F.try_variant_get(held, path, "variant")
    return F.coalesce(more, F.lit(False)) | (typed.isNull() & value.isNotNull() & ~F.is_variant_null(value))


def _can_exceed(kind: DataType) -> bool:
    return not isinstance(kind, StringType)


def conform(documents: DataFrame, schema: StructType) -> DataFrame:
    """Typed columns of a schema, plus ``_rescued_data`` for all that did not fit.

    An object or array with a nested field that the schema lacks, or a nested number that its
    type would change, is rescued whole beside its typed form.
    """
    document = F.col(DOCUMENT)
    schema = StructType([f for f in schema.fields if f.name != RESCUED])
    names = [f.name for f in schema.fields]
    typed = documents.select(document, UNPARSED, _keys(document, "$").alias("_document_keys"),
                             *[_extract(f).alias(f.name) for f in schema.fields])

    def fits(field: StructField) -> Column:
        held = F.col(f"`{field.name}`").isNotNull()
        if isinstance(field.dataType, (StructType, ArrayType)):
            held = held & ~_exceeds(*_place(document, "$", field.name), field.dataType)
        return F.when(held, F.lit(field.name))

    # Columns that a later step reads twice stay projections of their own: within the lambda
    # they would be computed anew for every field of the document.
    known = typed.withColumn("_document_fitting", F.array_compact(F.array(F.lit(None).cast("string"), *map(fits, schema.fields))))
    left_over = F.when(F.size("_document_keys") > F.size("_document_fitting"), F.map_filter(
        _entries(), lambda key, value: ~F.is_variant_null(value) & ~F.array_contains("_document_fitting", key)))
    rest = known.withColumn("_document_left", left_over)
    rescued = (F.when(document.isNull(), F.col(UNPARSED))
               .when(F.col("_document_keys").isNull(), F.to_json(document))
               .when(F.size("_document_left") > 0, F.to_json("_document_left")))
    return rest.select(*[F.col(f"`{n}`") for n in names], rescued.alias(RESCUED))


def evolve(documents: DataFrame, store: SchemaStore) -> DataFrame:
    """Widen the stored schema by a batch, then shape the batch by it."""
    stored = store.load()
    merged = widen(stored, observed_schema(documents))
    if merged != stored:
        store.save(merged)
    return conform(documents, merged)
