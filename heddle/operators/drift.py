"""Schemas that drift between files: per-file schemas, ordered differences, one table.

Every file's header schema (top-level members and their JSON types) is read in parallel as
an aggregate, the schemas are folded through a type-promotion lattice, each file is cast to
the union schema, and consecutive files of a feed are compared for an ordered log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import BROADCAST_BYTES, materialise, with_ordinal

#: JSON types as bits of a file's type set for a field.
TYPES = ("boolean", "integer", "decimal", "string", "array", "object")
#: Digits of the widest decimal column; wider numbers are kept as text.
MAX_DIGITS = 38
#: Type of a whole number that takes more than 64 bits (a smaller one is a BIGINT).
BIG_INTEGER = r"^DECIMAL\((?:19|[23]\d),0\)$"
_LINE = ("feed", "file_id", "exported_at", "line_no", "payload")


def members(lines: DataFrame) -> DataFrame:
    """(feed, file_id, line_no, field, bit): top-level members of JSON objects.

    bit is the bit of the member's type, 0 for null. Lines that are no JSON
    objects (broken, empty, null, other values) give nothing. Whole numbers are integers
    whatever their size; beyond 38 digits, or with an exponent, a number is a decimal.
    """
    exploded = lines.sparkSession.tvf.variant_explode(F.col("p").outer())
    out = _objects(lines).lateralJoin(exploded).select("feed", "file_id", "line_no", F.col("key").alias("field"), F.col("value").alias("v"))
    return out.select("feed", "file_id", "line_no", "field", _bit(F.schema_of_variant("v")).alias("bit"))


def _bit(kind: Column) -> Column:
    return (
        F.when(kind == "VOID", 0)
        .when(kind == "BOOLEAN", 1)
        .when((kind == "BIGINT") | kind.rlike(BIG_INTEGER), 2)
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), 4)
        .when(kind == "STRING", 8)
        .when(kind.startswith("ARRAY"), 16)
        .otherwise(32)
    )


def _objects(lines: DataFrame) -> DataFrame:
    texts = lines.where(F.col("payload").rlike(r"^\s*\{"))
    return texts.select("feed", "file_id", "exported_at", "line_no", F.try_parse_json("payload").alias("p")).where("p IS NOT NULL")


def file_schemas(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(feed, file_id, at, fields): one row per file, fields a map of name to type bits.

    Files without any JSON object have an empty map.
    """
    per_field = found.groupBy("feed", "file_id", "field").agg(F.bit_or("bit").alias("bits"))
    maps = per_field.groupBy("feed", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "bits"))).alias("fields"))
    files = lines.groupBy("feed", "file_id").agg(F.max("exported_at").alias("at"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return files.join(maps, ["feed", "file_id"], "left").withColumn("fields", F.coalesce("fields", empty))


def schema_changes(lines: DataFrame, key_field: Column) -> DataFrame:
    """Ordered differences between consecutive files of a feed.

    (feed, exported_at, file_id, change_kind, field_before, field_after, type_before,
    type_after). ``key_field`` is an expression over ``feed`` naming the member that
    identifies a record. Files are compared by exported_at (nulls first), then file_id;
    file_id names the later; lines without a feed or file_id belong to no file. A field that goes and one that comes are one rename if their
    values agree for every record with both values, and at least one has both; if several
    pairs would fit, the first in name order of each is taken, so that no field is used
    twice. Repeated lines change nothing.
    """
    lines = lines.select(*_LINE).where("feed IS NOT NULL AND file_id IS NOT NULL")  # whatever other columns are called
    # Files are numbered by a parallel sort, so that one feed may hold any share of them.
    files = with_ordinal(file_schemas(lines, members(lines)), [F.col(c) for c in ("feed", "at", "file_id")])
    before = files.select("feed", (F.col("ordinal") + 1).alias("ordinal"), F.col("fields").alias("before"),
        F.col("file_id").alias("before_id"))
    pairs = materialise(
        files.join(before, ["feed", "ordinal"]).select(
            "feed", "at", "file_id", "before_id", "before", F.col("fields").alias("after"),
            F.array_except(F.map_keys("before"), F.map_keys("fields")).alias("gone"),
            F.array_except(F.map_keys("fields"), F.map_keys("before")).alias("came"),
        )
    )
    renamed = _renames(lines, pairs, key_field)
    out = pairs.join(renamed, ["feed", "file_id"], "left").withColumn("renames",
        F.coalesce("renames", F.array().cast("array<struct<a:string,b:string>>")))
    ren = F.transform("renames", lambda r: F.struct(F.lit("renamed").alias("kind"), r["a"].alias("a"), r["b"].alias("b")))
    gone = F.transform(F.array_except("gone", F.transform("renames", lambda r: r["a"])),
        lambda x: F.struct(F.lit("removed").alias("kind"), x.alias("a"), F.lit("").alias("b")))
    came = F.transform(F.array_except("came", F.transform("renames", lambda r: r["b"])),
        lambda x: F.struct(F.lit("added").alias("kind"), F.lit("").alias("a"), x.alias("b")))
    both = F.filter(F.array_intersect(F.map_keys("before"), F.map_keys("after")),
        lambda x: F.element_at("before", x) != F.element_at("after", x))
    retyped = F.transform(both, lambda x: F.struct(F.lit("retyped").alias("kind"), x.alias("a"), x.alias("b")))
    return out.select(
        "feed", "at", "file_id", "before", "after", F.explode(F.array_sort(F.concat(gone, ren, retyped, came))).alias("c")
    ).select(
        "feed", F.col("at").alias("exported_at"), "file_id", F.col("c.kind").alias("change_kind"),
        F.col("c.a").alias("field_before"), F.col("c.b").alias("field_after"),
        _type_text(F.try_element_at("before", F.col("c.a"))).alias("type_before"),
        _type_text(F.try_element_at("after", F.col("c.b"))).alias("type_after"),
    )


def _renames(lines: DataFrame, pairs: DataFrame, key_field: Column) -> DataFrame:
    """(feed, file_id, renames): for the later file of a pair its (a, b) renames.

    Only lines of files in which fields went and came are read again, and only those fields'
    values are kept, as hashes by record.
    """
    candidates = pairs.where("size(gone) > 0 AND size(came) > 0")
    wanted = candidates.select("feed", F.col("before_id").alias("file_id"), F.col("file_id").alias("later"), F.lit(0).alias("side"),
        F.col("gone").alias("wanted")).unionByName(
        candidates.select("feed", "file_id", F.col("file_id").alias("later"), F.lit(1).alias("side"), F.col("came").alias("wanted"))
    )
    # Both sides of every candidate, by the bytes of its names and 64 for each row's place.
    size = wanted.agg(F.sum(F.octet_length("feed") + F.octet_length(F.array_join("wanted",
        "")) + 16 * F.size("wanted") + 64)).first()[0] or 0
    hint = F.broadcast if size <= BROADCAST_BYTES else (lambda d: d)
    # Variants of the same value print alike: members sorted, spacing and escapes gone.
    texts = lines.where(F.col("payload").rlike(r"^\s*\{")).join(hint(wanted), ["feed", "file_id"])
    record = F.call_function("get_json_object", F.col("payload"), F.concat(F.lit("$['"), key_field, F.lit("']")))
    rows = texts.select("feed", "later", "side", "wanted", "line_no", record.alias("r"),
        F.try_parse_json("payload").alias("p")).where("p IS NOT NULL AND r IS NOT NULL")
    rows = rows.withColumn("k", F.xxhash64("r")).drop("r")
    exploded = rows.lateralJoin(lines.sparkSession.tvf.variant_explode(F.col("p").outer())).where(F.array_contains("wanted",
        F.col("key")) & ~F.is_variant_null("value"))
    values = exploded.select("feed", "later", "side", "line_no", "k", F.col("key").alias("field"),
        F.xxhash64(F.to_json("value"), F.schema_of_variant("value") == "STRING").alias("hash"))
    # Of several values of one record and field in a file, the last line's holds.
    held = values.groupBy("feed", "later", "side", "k", "field").agg(F.max(F.struct("line_no", "hash"))["hash"].alias("hash"))
    # A record's values on both sides meet in one row: no more than the fields that went and came.
    met = held.groupBy("feed", "later", "k").agg(F.collect_list(F.struct("side", "field", "hash")).alias("v"))
    of = lambda i: F.filter("v", lambda x: x["side"] == i)
    pair = lambda x, y: F.struct(x["field"].alias("a"), y["field"].alias("b"), (x["hash"] == y["hash"]).alias("equal"))
    pairs_of = F.flatten(F.transform(of(0), lambda x: F.transform(of(1), lambda y: pair(x, y))))
    agree = met.select("feed", "later", F.inline(pairs_of)).groupBy("feed", "later", "a", "b").agg(F.min("equal").alias("same")).where("same")
    # One partner each: fields are few, so mutual first choices settle within the array.
    ordered = agree.groupBy("feed", "later").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("fits"))
    start = F.array().cast("array<struct<a:string,b:string>>")
    settled = F.aggregate(
        "fits", start, lambda acc, x: F.when(F.exists(acc, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"])),
        acc).otherwise(F.concat(acc, F.array(x)))
    )
    return ordered.select("feed", F.col("later").alias("file_id"), settled.alias("renames"))


def _type_text(bits: Column) -> Column:
    names = F.filter(F.array(*[F.when(bits.bitwiseAND(1 << i) != 0, t) for i, t in enumerate(TYPES)]), lambda x: x.isNotNull())
    return F.coalesce(F.array_join(names, "|"), F.lit(""))


def rename_map(lines: DataFrame, key_field: Column) -> dict[str, str]:
    """Names that mean one field, by the renames seen: {name: name kept}.

    Renames link names into groups; the name kept is that of most files, of equal ones the
    first. A group of which one file has two names is left apart: they aren't one field
    everywhere. The driver gets distinct pairs of names only: what it needs to know for the
    columns of the one table.
    """
    seen = schema_changes(lines, key_field).where("change_kind = 'renamed'").select("field_before", "field_after").distinct().collect()
    group: dict[str, set[str]] = {}
    for a, b in sorted(map(tuple, seen)):
        both = group.get(a, {a}) | group.get(b, {b})
        for name in both:
            group[name] = both
    if not group:
        return {}
    known = members(lines).where(F.col("field").isin(list(group))).select("feed", "file_id", "field").distinct()
    files = {r["field"]: r["count"] for r in known.groupBy("field").count().collect()}
    keep = {name: min(both, key=lambda n: (-files.get(n, 0), n)) for name, both in group.items()}
    # Groups whose names meet in a file.
    to_kept = F.create_map(*[F.lit(x) for pair in sorted(keep.items()) for x in pair])
    met = known.groupBy("feed", "file_id", F.element_at(to_kept, F.col("field")).alias("kept")).agg(F.count("*").alias("n"))
    apart = {r["kept"] for r in met.where("n > 1").select("kept").distinct().collect()}
    return {name: k for name, k in keep.items() if k not in apart and name != k}


def promoted(bits: int, whole: int = 0, scale: int = 0, inexact: bool = False) -> str:
    """Least type of the lattice boolean, integer < decimal; all < string that holds all values.

    ``bits`` are the types seen, ``whole`` and ``scale`` the most digits before and after the
    point, ``inexact`` whether a number was beyond 38 digits or had an exponent. Integers
    beyond 18 digits and decimals are decimals of just the digits needed, text where that is
    more than 38. Inexact numbers are doubles, as JSON readers take them; beside exact ones
    they are text. Arrays and objects stay JSON text; with nothing but nulls the type is
    string.
    """
    if bits == 1:
        return "boolean"
    if bits & ~6 or not bits:
        return "string"
    if inexact:
        return "string" if whole or scale else "double"
    if bits == 2 and whole <= 18:
        return "bigint"
    return f"decimal({max(1, whole + scale)},{scale})" if whole + scale <= MAX_DIGITS else "string"


def field_types(lines: DataFrame) -> DataFrame:
    """(field, bits, whole, scale, inexact): all that ``promoted`` needs, one row per field."""
    exploded = lines.sparkSession.tvf.variant_explode(F.col("p").outer())
    kinds = _objects(lines).lateralJoin(exploded).select(F.col("key").alias("field"), F.col("value").alias("v"),
        F.schema_of_variant("value").alias("kind"))
    part = lambda i: F.nullif(F.regexp_extract("kind", r"^DECIMAL\((\d+),(-?\d+)\)$", i), F.lit("")).cast("int")
    digits = F.when(F.col("kind") == "BIGINT", F.length(F.replace(F.variant_get("v", "$", "string"), F.lit("-"), F.lit(""))))
    widths = kinds.select("field", "v", "kind", F.coalesce(part(1) - part(2), digits, F.lit(0)).alias("whole"),
        F.greatest(part(2), F.lit(0)).alias("scale"))
    return widths.groupBy("field").agg(
        F.bit_or(_bit(F.col("kind"))).alias("bits"), F.max("whole").alias("whole"), F.max("scale").alias("scale"),
            F.bool_or(F.col("kind").isin("DOUBLE", "FLOAT")).alias("inexact")
    )


def unified_table(lines: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """All JSON-object lines as one table with one column and type per field.

    Columns: feed, file_id, exported_at, line_no, then the union's fields in name order;
    those clashing with an earlier column, in any case, as ``field_<name>``. The lattice's
    join of all types seen holds every value exactly (see ``promoted`` for numbers that JSON
    readers take as doubles), so none is lost by the cast; a value is null where it was null
    or absent. ``rename`` maps old names to the names kept. Repeated lines stay; an empty
    table has only the first four columns. The driver gets one row per field, which is what a
    table's columns are.
    """
    rename = rename or {}
    kinds: dict[str, tuple] = {}
    sources: dict[str, list[str]] = {}
    for r in field_types(lines).orderBy("field").collect():
        name = rename.get(r["field"], r["field"])
        bits, whole, scale, inexact = kinds.get(name, (0, 0, 0, False))
        kinds[name] = (bits | r["bits"], max(whole, r["whole"]), max(scale, r["scale"]), inexact or r["inexact"])
        sources.setdefault(name, []).append(r["field"])
    parsed = _objects(lines)
    cols, used = [], {"feed", "file_id", "exported_at", "line_no"}
    for name in sorted(kinds):
        # Names may hold any character: paths quote them.
        path = lambda s: "$['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']"
        got = [F.variant_get("p", path(s), promoted(*kinds[name])) for s in sorted(sources[name], key=lambda s: (s != name, s))]
        column = name
        while column.lower() in used:  # names that differ in case only are one column name to Spark
            column = f"field_{column}"
        used.add(column.lower())
        cols.append((got[0] if len(got) == 1 else F.coalesce(*got)).alias(column))
    return parsed.select("feed", "file_id", "exported_at", "line_no", *cols)
