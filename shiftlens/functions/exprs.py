"""Column expressions. All take and return Columns; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITER = "§"

# Catalog type codes with their families and names.
TYPE_CODES = {
    "I1": ("fixed", "BYTEINT"), "I2": ("fixed", "SMALLINT"), "I": ("fixed", "INTEGER"), "I8": ("fixed", "BIGINT"),
    "D": ("decimal", "DECIMAL"), "N": ("decimal", "NUMBER"),
    "F": ("fixed", "FLOAT"), "R": ("fixed", "REAL"), "FD": ("fixed", "DOUBLE PRECISION"),
    "CV": ("charlen", "VARCHAR"), "CF": ("charlen", "CHAR"), "CO": ("charlen", "CLOB"),
    "BV": ("charlen", "VARBYTE"), "BF": ("charlen", "BYTE"), "BO": ("charlen", "BLOB"),
    "DA": ("fixed", "DATE"), "AT": ("timewithprec", "TIME"), "TS": ("timewithprec", "TIMESTAMP"),
    "TZ": ("timewithprec", "TIME WITH TIME ZONE"), "SZ": ("timewithprec", "TIMESTAMP WITH TIME ZONE"),
    "YR": ("fixed", "INTERVAL YEAR"), "YM": ("fixed", "INTERVAL YEAR TO MONTH"), "MO": ("fixed", "INTERVAL MONTH"),
    "DY": ("fixed", "INTERVAL DAY"), "DH": ("fixed", "INTERVAL DAY TO HOUR"), "DM": ("fixed", "INTERVAL DAY TO MINUTE"),
    "DS": ("fixed", "INTERVAL DAY TO SECOND"), "HR": ("fixed", "INTERVAL HOUR"), "HM": ("fixed", "INTERVAL HOUR TO MINUTE"),
    "HS": ("fixed", "INTERVAL HOUR TO SECOND"), "MI": ("fixed", "INTERVAL MINUTE"), "MS": ("fixed", "INTERVAL MINUTE TO SECOND"),
    "SC": ("fixed", "INTERVAL SECOND"),
    "PD": ("fixed", "PERIOD(DATE)"), "PT": ("timewithprec", "PERIOD(TIME)"), "PZ": ("timewithprec", "PERIOD(TIME WITH TIME ZONE)"),
    "PS": ("timewithprec", "PERIOD(TIMESTAMP)"), "PM": ("timewithprec", "PERIOD(TIMESTAMP WITH TIME ZONE)"),
    "JN": ("fixed", "JSON"), "XM": ("fixed", "XML"), "UT": ("fixed", "USER_DEFINED_TYPE"), "A1": ("fixed", "ARRAY"), "AN": ("fixed", "ARRAY"),
    "++": ("fixed", "TD_ANYTYPE"), "GE": ("fixed", "ST_GEOMETRY"),
}
# Table kinds and usage object types.
TABLE_KINDS = {
    "T": "TABLE", "O": "TABLE", "Q": "TABLE", "V": "VIEW", "M": "MACRO", "P": "STORED_PROCEDURE", "E": "STORED_PROCEDURE",
    "F": "FUNCTION", "R": "FUNCTION", "A": "FUNCTION", "B": "FUNCTION", "I": "TRIGGER", "G": "TRIGGER", "N": "SEQUENCE", "J": "TRIGGER", "X": "INDEX",
}
USAGE_TYPES = {"Col": "COLUMN", "Tab": "TABLE", "Viw": "VIEW", "Idx": "INDEX", "Mac": "MACRO", "Vol": "VOLATILE"}
# Base names of known column types.
KNOWN_TYPES = [
    "INTEGER", "INT", "SMALLINT", "BYTEINT", "BIGINT", "FLOAT", "REAL", "DOUBLE PRECISION", "NUMBER", "NUMERIC", "DECIMAL",
    "CHAR", "CHARACTER", "VARCHAR", "CHARACTER VARYING", "LONG VARCHAR", "CLOB", "BLOB", "BYTE", "VARBYTE", "LONG VARBYTE",
    "DATE", "TIME", "TIMESTAMP", "TIME WITH TIME ZONE", "TIMESTAMP WITH TIME ZONE", "INTERVAL", "PERIOD", "BOOLEAN", "JSON", "XML", "ST_GEOMETRY", "MBR",
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed table, null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def split_escaped(c: Column | str) -> Column:
    """Fields between delimiters; an escaped delimiter stays part of its field, without the escape. Text without escapes is split at the plain sign,
    which takes no pattern."""
    text, escaped = col(c), F.lit(f"\\{DELIMITER}")
    fields = F.transform(F.split(text, rf"(?<!\\){DELIMITER}", -1), lambda x: F.replace(x, escaped, F.lit(DELIMITER)))
    return F.when(F.contains(text, escaped), fields).otherwise(F.split(text, DELIMITER, -1))


def parse_int_lenient(c: Column | str) -> Column:
    """Whole number with or without thousands commas, else null."""
    return F.replace(F.trim(col(c)), F.lit(","), F.lit("")).try_cast("bigint")


def blank_to_null(c: Column | str) -> Column:
    trimmed = F.trim(col(c))
    return F.when(trimmed != "", trimmed)


def format_type(code, length, digits, fraction) -> Column:
    """Canonical type name of a catalogued column."""
    code, length, digits, fraction = F.trim(F.coalesce(col(code), F.lit(""))), col(length), col(digits), col(fraction)
    family = lookup({k: v[0] for k, v in TYPE_CODES.items()}, code)
    base = lookup({k: v[1] for k, v in TYPE_CODES.items()}, code)
    number = F.concat(F.lit("("), length.cast("string"), F.lit(")"))
    zone, sized = F.lit(" WITH TIME ZONE"), (length > 0)
    timed = (
        F.when(F.contains(base, zone), F.concat(F.substring_index(base, " WITH", 1), number, F.lit(" WITH"), F.substring_index(base, " WITH", -1)))
        .when(F.startswith(base, F.lit("PERIOD(")), F.concat(F.regexp_replace(base, r"\)$", ""), number, F.lit(")")))
        .otherwise(F.concat(base, number))
    )
    decimal = F.when(digits.isNull(), base).when(fraction.isNull(), F.concat(base, F.lit("("), digits.cast("string"), F.lit(")"))).otherwise(
        F.concat(base, F.lit("("), digits.cast("string"), F.lit(","), fraction.cast("string"), F.lit(")"))
    )
    return (
        F.when(family.isNull(), F.concat(F.lit("UNKNOWN("), F.when(code == "", F.lit("?")).otherwise(code), F.lit(")")))
        .when(family == "fixed", base)
        .when(family == "decimal", decimal)
        .when(F.coalesce(sized, F.lit(False)), F.when(family == "charlen", F.concat(base, number)).otherwise(timed))
        .otherwise(base)
    )


def object_type_from_kind(kind) -> Column:
    return F.coalesce(lookup(TABLE_KINDS, F.upper(F.trim(col(kind)))), F.lit("UNKNOWN"))


def is_nullable(flag) -> Column:
    return F.coalesce(F.upper(F.trim(col(flag))) == "Y", F.lit(True))


def parse_timestamp(c, *formats: str) -> Column:
    """The first format that fits, as a timestamp without zone; null if none does. A format is tried only where the text has the point and the T that
    it has and no others: an attempt that fails costs many times one that fits."""
    text = F.trim(col(c))
    alike = lambda f: (F.contains(text, F.lit(".")) == ("." in f)) & (F.contains(text, F.lit("T")) == ("T" in f)) & (text != "")
    return F.coalesce(*(F.when(alike(f), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")) for f in formats))


def parse_catalog_ts(c) -> Column:
    return parse_timestamp(c, "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss")


def parse_usage_ts(c) -> Column:
    return parse_timestamp(c, "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")


def parse_log_date(c) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(col(c)), F.lit(f)).cast("date") for f in ("yyyy/MM/dd", "yyyy-MM-dd")))


def run_id_timestamp(c) -> Column:
    """UTC time at the head of an extract run id, as 20240131T235959Z."""
    head = F.regexp_extract(col(c), r"^(\d{8}T\d{6})Z", 1)
    return F.try_to_timestamp(F.when(head != "", head), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")


def schema_of(ident) -> Column:
    return F.substring_index(col(ident), ".", 1)


def parent_object(ident, object_type) -> Column:
    """schema.table for columns, the identifier itself otherwise."""
    ident = col(ident)
    return F.when((col(object_type) == "COLUMN") & (F.size(F.split(ident, r"\.")) >= 3), F.substring_index(ident, ".", 2)).otherwise(ident)


def leaf(ident) -> Column:
    return F.substring_index(col(ident), ".", -1)


def column_key_parts(key) -> tuple[Column, Column]:
    """(table, column) of 'SCHEMA.TABLE|COLUMN'."""
    parts = F.split(col(key), r"\|", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def map_dataset_type(t) -> Column:
    t = col(t)
    return F.when(t.isNull() | (t == ""), F.lit("UNKNOWN")).when(F.upper(F.trim(t)).isin(["TABLE", "VIEW", "STORED_PROCEDURE", "MACRO", "FUNCTION", "UDF", "TRIGGER", "INDEX", "SEQUENCE"]), F.upper(F.trim(t))).otherwise(F.upper(t))


def known_type(t) -> Column:
    base = F.upper(F.trim(F.split_part(F.split_part(col(t), F.lit("("), F.lit(1)), F.lit(" CHARACTER"), F.lit(1))))
    return base.isin(KNOWN_TYPES)


def clamp(c, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col(c)))


def share(part, whole, places: int = 4) -> Column:
    """part / max(whole, 1), rounded half up."""
    return F.round(col(part) / F.greatest(col(whole), F.lit(1)), places)


def file_date(path, modified) -> Column:
    """Date in a file's name (yyyymmdd), else the day of its last change."""
    digits = F.regexp_extract(F.substring_index(col(path), "/", -1), r"(\d{8})", 1)
    return F.coalesce(F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMdd")).cast("date"), col(modified).cast("date"))


def json_field(text: Column | str, name: str, kind: str = "string") -> Column:
    """One field of a JSON object; null where the text is no object or lacks it."""
    return F.from_json(text, f"`{name}` {kind}")[name]


def state_json(**fields: Column) -> Column:
    """A JSON object of the fields that are not null, as before and after states are kept."""
    return F.to_json(F.struct(*(value.alias(name) for name, value in fields.items())))
