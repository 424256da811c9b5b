"""Strict scans of JSON lines: nothing is skipped, bad lines come back with the reason they are bad."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.labels import as_flag
from plumbline.operators.quality import violation

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with their file; partition columns of the path (such as run_id) come along."""
    return spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))


#: Types of values that are no object or list, and a member's name, as ``schema_of_variant`` writes them.
PLAIN, NAME = r"[A-Z]+(?:\(\d+,\d+\))?", r"(?:\w+|`(?:[^`]|``)*`)"
#: More partitions than any table has.
MANY = 2**31 - 1
#: Levels of objects and lists that are looked through below an undeclared member.
DEEPEST = 6
_SCALARS = {
    T.StringType(): "STRING",
    T.LongType(): "BIGINT",
    T.IntegerType(): "BIGINT",
    T.DoubleType(): r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))",
    T.BooleanType(): "BOOLEAN",
}


def _members(each: list[str], times: str) -> str:
    """An object of such members; what follows a member is a comma or the end."""
    return f"OBJECT<(?:(?:{'|'.join(each)})(?:, |(?=>))){times}>" if each else "OBJECT<>"


def _anything(levels: int = DEEPEST) -> str:
    inner = _anything(levels - 1) if levels else None
    return f"(?:{PLAIN}|ARRAY<{inner}>|{_members([f'{NAME}: {inner}'], '*')})" if levels else PLAIN


def _shape(kind: T.DataType, of_object) -> str:
    """How a value of this type is written, null aside; ``of_object`` writes an object."""
    if isinstance(kind, T.StructType):
        return of_object(kind)
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<(?:VOID|{_shape(kind.elementType, of_object)})>"
    return _SCALARS[kind]


def _right(schema: T.StructType) -> str:
    """Objects with all that is required, nothing undeclared, every value of its type and no null where a default would stand.

    The objects of a list are written as one, so what a single one lacks shows in the row only.
    """
    members = []
    for field in sorted(schema.fields, key=lambda f: f.name):
        kept = "default" in field.metadata
        kind = _shape(field.dataType, _declared if isinstance(field.dataType, T.ArrayType) else _right)
        kind = f"(?:VOID|{kind})" if field.nullable and not kept else kind
        members.append(f"(?:{field.name}: {kind}(?:, |(?=>)))" + ("?" if field.nullable or kept else ""))
    return f"OBJECT<{''.join(members)}>"


def _declared(schema: T.StructType) -> str:
    """Objects whose members are declared and of their types, or null."""
    return _members([f"{f.name}: (?:VOID|{_shape(f.dataType, _declared)})" for f in schema.fields], "*")


def _typed(schema: T.StructType) -> str:
    """Objects whose declared members are of their types, or null."""
    names = "|".join(f.name for f in schema.fields)
    known = [f"{f.name}: (?:VOID|{_shape(f.dataType, _typed)})" for f in schema.fields]
    return _members([*known, f"(?!(?:{names}):){NAME}: {_anything()}"], "*")


def _outside(row: Column, schema: T.StructType) -> Column:
    """Some value breaks a rule of its field: ``values``, ``pattern``, ``shortest``, ``longest`` (in letters), ``most`` (of a list) or ``least``."""
    wrong = F.lit(False)
    for field in schema.fields:
        column, rules = row[field.name], field.metadata
        if "values" in rules:
            wrong = wrong | F.coalesce(~column.isin(rules["values"]), F.lit(False))
        if "pattern" in rules:
            wrong = wrong | F.coalesce(~column.rlike(rules["pattern"]), F.lit(False))
        if "shortest" in rules:
            wrong = wrong | F.coalesce(F.char_length(column) < rules["shortest"], F.lit(False))
        if "longest" in rules:
            wrong = wrong | F.coalesce(F.char_length(column) > rules["longest"], F.lit(False))
        if "most" in rules:
            wrong = wrong | F.coalesce(F.size(column) > rules["most"], F.lit(False))
        if "least" in rules:
            wrong = wrong | F.coalesce(column < rules["least"], F.lit(False))
        if isinstance(field.dataType, T.StructType):
            wrong = wrong | _outside(column, field.dataType)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            wrong = wrong | _any_outside(column, field.dataType.elementType)
    return wrong


def _any_outside(objects: Column, schema: T.StructType) -> Column:
    return F.coalesce(F.exists(objects, lambda x: _null_inside(x, schema) | _outside(x, schema)), F.lit(False))


def _null_inside(row: Column, schema: T.StructType) -> Column:
    """A null member of a list of objects, or one without a required field."""
    missing = row.isNull()
    for field in schema.fields:
        missing = missing if field.nullable else missing | row[field.name].isNull()
    return missing


def _filled(row: Column, schema: T.StructType) -> Column:
    """The row with the defaults of absent fields, in nested objects too."""
    columns = []
    for field in schema.fields:
        column = row[field.name]
        if isinstance(field.dataType, T.StructType):
            column = _filled(column, field.dataType)
        elif "default" in field.metadata:
            value = field.metadata["default"]
            other = F.array() if value == [] else F.lit(value)
            column = F.coalesce(column, other.cast(field.dataType))
        columns.append(column.alias(field.name))
    return F.when(row.isNotNull(), F.struct(*columns))


def _open(schema: T.StructType) -> T.StructType:
    """The same fields, all nullable, so that a missing one is seen instead of refused."""
    return T.StructType(
        [
            T.StructField(f.name, _open(f.dataType) if isinstance(f.dataType, T.StructType) else f.dataType, True)
            for f in schema.fields
        ]
    )


def judge_lines(lines: DataFrame, schema: T.StructType, text: str = "value") -> DataFrame:
    """Each line with its parsed ``row`` and a ``reason`` that is null for a good line.

    Absent fields take the ``default`` in the metadata of ``schema``; the other rules there bound their values. A nullable field may be
    absent or null, one with a default may not be null, and a number is no text. A line is parsed once, into a variant. Names, types
    and nulls of all its objects are read off the variant's schema, which is one text; values off the row taken from it.
    """
    # narrow and into no fewer partitions: it only keeps what makes the lines out of the method that judges them, too long to be compiled with it
    apart = lines.coalesce(MANY)
    parsed = apart.withColumn("_json", F.try_parse_json(text))
    parsed = parsed.withColumns({"row": F.try_variant_get("_json", "$", _open(schema).simpleString()), "_shape": F.schema_of_variant("_json")})
    shape = F.col("_shape")
    reason = (
        F.when(F.trim(text) == "", "blank_line")
        .when(shape.isNull() | ~F.startswith(shape, F.lit("OBJECT<")) | ~F.endswith(F.rtrim(text), F.lit("}")), "invalid_json")
        .when(shape.rlike(f"^{_right(schema)}$"), F.when(_outside(F.col("row"), schema), "bad_value"))
        .when(~shape.rlike(f"^{_typed(schema)}$"), "invalid_json")
        .when(~shape.rlike(f"^{_declared(schema)}$"), "unknown_field")
        .otherwise("missing_field")
    )
    judged = parsed.withColumn("reason", reason).withColumn("row", _filled(F.col("row"), schema))
    return judged.drop("_json", "_shape")


def scan_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``judge_lines`` over all lines of the files in a path."""
    return judge_lines(read_lines(spark, path), schema)


def good_rows(judged: DataFrame, carry: list[str] = ()) -> DataFrame:
    return judged.filter("reason IS NULL").select(*carry, "row.*")


def bad_lines(judged: DataFrame) -> DataFrame:
    return judged.filter("reason IS NOT NULL").drop("row")


def scan_summary(judged: DataFrame) -> DataFrame:
    """One row per outcome; a scan with no good row at all says so."""
    counted = judged.groupBy(F.coalesce("reason", F.lit("good")).alias("outcome")).agg(F.count("*").alias("lines"))
    empty = judged.agg(F.sum(as_flag(F.col("reason").isNull())).alias("n")).filter("coalesce(n, 0) = 0")
    return counted.unionByName(empty.select(F.lit("empty").alias("outcome"), F.lit(0).cast("bigint").alias("lines")))


def taxonomy_order(names: DataFrame) -> DataFrame:
    """Names, by position, rise and do not repeat. Neighbours meet by an equi-join on the position."""
    after = names.select((F.col("position") - 1).alias("position"), F.col("name").alias("next_name"))
    wrong = names.join(after, "position").filter("next_name <= name")
    return violation(wrong, "S05", "position", F.concat_ws(">=", "name", "next_name"))
