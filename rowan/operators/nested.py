"""Deeply nested records as related flat tables with parent-child links.

Every nested object that is an element of an array becomes one row with its path (column name, keys and
zero-based positions joined by dots) and the path of the nearest enclosing such object. All of it is
higher-order SQL: nested transform calls attach keys and positions, flatten joins the arrays, and one
inline for each target table emits its rows; no row leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

LINK = "array<struct<child_path:string,parent_path:string>>"
# Fixed value: rounds of the walk before the text is asked how deep it may be.
FIRST_LEVELS = 24
# A text that may hold a key with a dot in it.
DOTTED_KEY = r'\.[^".]*+"\s*+:|\\u002[eE]|\\"'


def _holds_objects(kind: DataType) -> bool:
    """The type has an array of objects somewhere."""
    if isinstance(kind, ArrayType):
        return isinstance(kind.elementType, StructType) or _holds_objects(kind.elementType)
    if isinstance(kind, MapType):
        return _holds_objects(kind.valueType)
    return isinstance(kind, StructType) and any(_holds_objects(f.dataType) for f in kind)


def _under(path: Column, step: Column | str) -> Column:
    return F.concat(path, F.lit("."), step.cast("string") if isinstance(step, Column) else F.lit(step))


def _none() -> Column:
    return F.array().cast(LINK)


def _links(value: Column, kind: DataType, path: Column, owner: Column) -> Column | None:
    """Links of all objects in arrays within a value of a known type."""
    if not _holds_objects(kind):
        return None
    if isinstance(kind, StructType):
        parts = [x for f in kind if (x := _links(value[f.name], f.dataType, _under(path, f.name), owner)) is not None]
        return parts[0] if len(parts) == 1 else F.concat(*parts)
    if isinstance(kind, MapType):  # the keys stand in the path as the names of fields do
        entries = F.transform(F.map_entries(value), lambda e: _links(e["value"], kind.valueType, _under(path, e["key"]), owner))
        return F.coalesce(F.flatten(entries), _none())
    element = kind.elementType

    def one(x: Column, i: Column) -> Column:
        here = _under(path, i)
        inner = _links(x, element, here, here if isinstance(element, StructType) else owner)
        if not isinstance(element, StructType):
            return inner
        own = F.array(F.struct(here.alias("child_path"), owner.alias("parent_path")))
        return F.when(x.isNull(), _none()).otherwise(own if inner is None else F.concat(own, inner))

    return F.coalesce(F.flatten(F.transform(value, one)), _none())


def typed_links(df: DataFrame, column: str) -> Column:
    """Links (child_path, parent_path) of the objects in a column of a known nested type."""
    links = _links(F.col(column), df.schema[column].dataType, F.lit(column), F.lit(""))
    return _none() if links is None else links


def json_links(text: Column, name: str) -> Column:
    """Links of the objects in a JSON text of any layout and depth; none if it is not valid JSON."""
    return F.transform(json_objects(text, name, with_object=False), lambda o: F.struct(o["child_path"], o["parent_path"]))


def json_objects(text: Column, name: str, with_object: bool = True) -> Column:
    """child_path, parent_path and the object itself, as a variant, of the objects in a JSON text.

    A walk by depth: each round replaces the containers of one depth by those directly in them. The first
    FIRST_LEVELS rounds suffice for almost all texts; one that is deeper goes on for as many rounds as it
    has brackets, which no depth can exceed.
    """
    # casts to types without fields look at a value's kind only; a value goes from round to round as a variant, which is not copied
    is_object = lambda v: v.try_cast("struct<>").isNotNull()
    is_array = lambda v: v.try_cast("array<struct<>>").isNotNull()
    todo_type = "array<struct<path:string,owner:string,element:boolean,object:boolean,v:variant>>"
    done_type = "array<struct<child_path:string,parent_path:string" + (",object:variant>>" if with_object else ">>")

    def boxed(path: Column, owner: Column, element: Column, v: Column) -> Column:
        return F.struct(path.alias("path"), owner.alias("owner"), element.alias("element"), is_object(v).alias("object"), v.alias("v"))

    def inside(f: Column) -> Column:
        held = lambda v: is_object(v) | is_array(v)
        owner = F.when(f["element"], f["path"]).otherwise(f["owner"])
        values = F.transform(F.filter(F.map_entries(f["v"].try_cast("map<string,variant>")), lambda e: held(e["value"])), lambda e: boxed(_under(f["path"], e["key"]), owner, F.lit(False), e["value"]))
        items = F.transform(f["v"].try_cast("array<variant>"), lambda x, i: F.when(held(x), boxed(_under(f["path"], i), f["owner"], F.lit(True), x)))
        return F.when(f["object"], values).otherwise(F.filter(items, lambda c: c.isNotNull()))

    def found(f: Column) -> Column:
        parts = [f["path"].alias("child_path"), f["owner"].alias("parent_path")]
        return F.struct(*parts, *([f["v"].alias("object")] if with_object else []))

    def step(acc: Column, _: Column) -> Column:
        todo, done = acc["todo"], acc["done"]
        seen = F.transform(F.filter(todo, lambda f: f["element"] & f["object"]), found)
        return F.when(F.size(todo) == 0, acc).otherwise(F.struct(F.flatten(F.transform(todo, inside)).cast(todo_type).alias("todo"), F.concat(done, seen).cast(done_type).alias("done")))

    def rounds(levels: Column, todo: Column, done: Column) -> Column:
        return F.aggregate(levels, F.struct(todo.cast(todo_type).alias("todo"), done.cast(done_type).alias("done")), step)

    # the text is parsed once: elements of an array are bound to names
    start = F.transform(F.filter(F.array(F.try_parse_json(text)), lambda d: d.isNotNull()), lambda d: boxed(F.lit(name), F.lit(""), F.lit(False), d))
    first = rounds(F.sequence(F.lit(1), F.lit(FIRST_LEVELS)), start, F.array())
    brackets = F.length(F.regexp_replace(text, r"[^\[{]", ""))
    deeper = lambda acc: rounds(F.when(F.size(acc["todo"]) > 0, F.sequence(F.lit(1), brackets)).otherwise(F.array().cast("array<int>")), acc["todo"], acc["done"])["done"]
    # a one-element transform binds the first result to a name, so it is computed once
    return F.transform(F.array(first), deeper)[0]


def first_delivery(df: DataFrame, record_id: str, columns: list[str], arrived: str = "ingested_at") -> DataFrame:
    """One row for each record id: the columns of the delivery that arrived first (of equal times, the least by hash).

    Rows with a NULL id are records of their own, each kept.
    """
    packed = F.struct(*columns)
    own = F.when(F.col(record_id).isNull(), F.monotonically_increasing_id())
    rows = df.select(F.col(record_id).alias("_id"), own.alias("_own"), F.struct(arrived, F.xxhash64(F.to_json(packed))).alias("_at"), packed.alias("_row"))
    return rows.groupBy("_id", "_own").agg(F.min_by("_row", "_at").alias("_row")).select(F.col("_id").alias(record_id), "_row.*")


def object_links(df: DataFrame, record_id: str, json: tuple[str, ...] = (), typed: tuple[str, ...] = (), single: tuple[str, ...] = ()) -> DataFrame:
    """record_id, child_path, parent_path of every nested object of every record.

    json: columns of JSON text; typed: columns of arrays, structs and maps; single: struct columns that are
    themselves one object, without parent. NULL values, NULL elements and texts that are not valid JSON have no rows;
    NULL elements keep their position. Of a key that an object repeats the last value counts. Two objects have the same path
    only if a key holds a dot; they are one row then. Records that occur several
    times must be made one before (see first_delivery). Records with a NULL id are kept.
    """
    if json:  # else an object that repeats a key would not be read as JSON
        df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    links = []
    for c in json:
        found = json_links(F.col(c), c)
        links.append(F.when(F.col(c).rlike(DOTTED_KEY), F.array_distinct(found)).otherwise(found) if len(json) == 1 and not typed and not single else F.array_distinct(found))
    links += [F.array_distinct(typed_links(df, c)) if _has_maps(df.schema[c].dataType) else typed_links(df, c) for c in typed]
    links += [F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(c).alias("child_path"), F.lit("").alias("parent_path")))).otherwise(_none()) for c in single]
    return df.select(F.col(record_id).alias("record_id"), F.inline(F.concat(*links) if len(links) > 1 else links[0]))


def _has_maps(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_maps(kind.elementType)
    return isinstance(kind, MapType) or isinstance(kind, StructType) and any(_has_maps(f.dataType) for f in kind)


def _flat(value: Column, kind: StructType, prefix: str = "") -> dict[str, Column]:
    """Columns of an object: scalars and arrays of scalars, fields of objects in it under joined names, maps as JSON text.

    Arrays of objects have tables of their own.
    """
    out: dict[str, Column] = {}
    for f in kind:
        if isinstance(f.dataType, StructType):
            out |= _flat(value[f.name], f.dataType, f"{prefix}{f.name}_")
        elif isinstance(f.dataType, MapType):
            out[f"{prefix}{f.name}"] = F.to_json(value[f.name])
        elif not _holds_objects(f.dataType):
            out[f"{prefix}{f.name}"] = value[f.name]
    return out


def nested_tables(df: DataFrame, record_id: str, column: str) -> dict[str, DataFrame]:
    """One flat table for each array of objects within a typed column, named by its path (``values`` stands for the keys of a map).

    Each has record_id, path, parent_path, position (from 0), and the object's own fields (columns that clash
    with these names get the prefix ``own_``). Rules for NULLs as in object_links.
    """
    tables: dict[str, DataFrame] = {}
    reserved = ("record_id", "path", "parent_path", "position")

    def visit(kind: DataType, name: str, rows: Callable[[Callable], Column]) -> None:
        # rows(f): array of f(value, path, owner) over all values at this place
        if isinstance(kind, StructType):
            for f in kind:
                if _holds_objects(f.dataType):
                    visit(f.dataType, f"{name}_{f.name}", lambda g, f=f, rows=rows: rows(lambda v, p, o: g(v[f.name], _under(p, f.name), o)))
            return
        if isinstance(kind, MapType):

            def values(g: Callable) -> Column:
                def over(v: Column, p: Column, o: Column) -> Column:
                    return F.coalesce(F.flatten(F.transform(F.map_entries(v), lambda e: g(e["value"], _under(p, e["key"]), o))), F.array())

                return rows(over)

            visit(kind.valueType, f"{name}_values", values)
            return
        element = kind.elementType
        is_object = isinstance(element, StructType)

        def each(g: Callable) -> Column:
            def over(v: Column, p: Column, o: Column) -> Column:
                return F.coalesce(F.flatten(F.transform(v, lambda x, i: F.when(x.isNotNull(), g(x, _under(p, i), _under(p, i) if is_object else o, i, o)).otherwise(F.array()))), F.array())

            return rows(over)

        if is_object:

            def own(x: Column, here: Column, _: Column, i: Column, o: Column) -> Column:
                mine = [c.alias("own_" + n if n in reserved else n) for n, c in _flat(x, element).items()]
                return F.array(F.struct(here.alias("path"), o.alias("parent_path"), i.cast("bigint").alias("position"), *mine))

            tables[name] = df.select(F.col(record_id).alias("record_id"), F.inline(each(own)))
        visit(element, name, lambda g, each=each: each(lambda x, here, owner, i, o: g(x, here, owner)))

    visit(df.schema[column].dataType, column, lambda g: g(F.col(column), F.lit(column), F.lit("")))
    return tables


def json_table(df: DataFrame, record_id: str, column: str, fields: dict[str, str]) -> DataFrame:
    """Objects in arrays of a JSON column as one flat table: record_id, path, parent_path, position, the given fields
    (name to type; NULL where the value has another type) and the object as JSON."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = df.select(F.col(record_id).alias("record_id"), F.inline(json_objects(F.col(column), column)))
    values = [F.try_variant_get("object", f"$.{k}", t).alias(k) for k, t in fields.items()]
    return rows.select("record_id", F.col("child_path").alias("path"), "parent_path", F.regexp_extract("child_path", r"([0-9]+)$", 1).cast("bigint").alias("position"), *values, F.to_json("object").alias("object"))
