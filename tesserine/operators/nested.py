"""Records with arrays, structs and maps: flattening, normalising, paths, prompts and the structured profile.

What to do with a column follows from its type in the schema, so all of it is
one projection and nothing leaves the JVM.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..sources.tables import table
from .text_jobs import ascii_sql, key_sql


def flat(c: Column, kind: S.DataType) -> Column:
    """Any value as text: items and values joined by spaces, nulls left out; null is empty. Characters stay as they are."""
    if isinstance(kind, S.ArrayType):
        return F.coalesce(F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: flat(x, kind.elementType)), " "), F.lit(""))
    if isinstance(kind, S.MapType):
        return flat(F.map_values(c), S.ArrayType(kind.valueType))
    if isinstance(kind, S.StructType):
        return F.concat_ws(" ", *(F.when(c[f.name].isNotNull(), flat(c[f.name], f.dataType)) for f in kind))
    if isinstance(kind, S.BooleanType):
        return F.when(c, "True").when(~c, "False").otherwise("")
    return F.coalesce(c.cast("string"), F.lit(""))


def flattened(df: DataFrame, *columns: str) -> dict[str, Column]:
    """The columns as ASCII text."""
    return {n: T.to_ascii(flat(F.col(n), df.schema[n].dataType)) for n in columns}


def _folded(c: Column, kind: S.DataType) -> Column:
    """A value with all texts in it folded to ASCII. Of keys of a map that become the same, the last counts."""
    if not _holds_text(kind):
        return c
    if isinstance(kind, S.ArrayType):
        return F.transform(c, lambda x: _folded(x, kind.elementType))
    if isinstance(kind, S.MapType):
        keys, values = F.transform(F.map_keys(c), lambda k: _folded(k, kind.keyType)), F.transform(F.map_values(c), lambda v: _folded(v, kind.valueType))
        entries = F.arrays_zip(keys.alias("key"), values.alias("value"))
        last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(last))
    if isinstance(kind, S.StructType):
        return F.when(c.isNotNull(), F.struct(*(_folded(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return T.to_ascii(c)


def _holds_text(kind: S.DataType) -> bool:
    if isinstance(kind, S.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, S.MapType):
        return _holds_text(kind.keyType) or _holds_text(kind.valueType)
    if isinstance(kind, S.StructType):
        return any(_holds_text(f.dataType) for f in kind)
    return isinstance(kind, S.StringType)


def normalised_records(df: DataFrame) -> DataFrame:
    """The table with all texts in all columns, and their names, folded to ASCII; other values as they are."""
    return df.select(*(_folded(F.col(f"`{f.name}`"), f.dataType).alias(T.decomposed(f.name)) for f in df.schema))


def text_value(c: Column, kind: S.DataType) -> Column:
    """The text of a text field: trimmed; of a list, its items that aren't empty; of a record, its texts; null where there is none."""
    if isinstance(kind, S.StringType):
        return F.trim(c)
    if isinstance(kind, S.ArrayType):
        item = lambda x: flat(x, kind.elementType)
        texts = F.filter(F.transform(c, item), lambda x: ~x.isin("", "0", "0.0", "False"))
    elif isinstance(kind, S.MapType):
        texts = F.filter(F.transform(F.map_values(c), lambda x: F.trim(x)), lambda x: x != "") if isinstance(kind.valueType, S.StringType) else F.array().cast("array<string>")
    elif isinstance(kind, S.StructType):
        own = [F.trim(c[f.name]) for f in kind if isinstance(f.dataType, S.StringType)]
        texts = F.filter(F.array(*own), lambda x: x.isNotNull() & (x != "")) if own else F.array().cast("array<string>")
    else:
        text = flat(c, kind)
        return F.when(~text.isin("", "0", "0.0", "False"), text)
    return F.when(F.size(texts) > 0, F.array_join(texts, " "))


def key_component(c: Column, kind: S.DataType, eligible: Column) -> Column:
    """The cache-key component of a field that is eligible and has text."""
    text = text_value(c, kind)
    return F.when(eligible & (text != ""), T.key_part(text))


# --- paths and prompts ----------------------------------------------------------


def path(expression: str) -> Column:
    """A column of a path such as People[?Type=='Actor'].Name, People[0].Name or Studios.Name.

    A condition or an array before a field gives the field of all items, a
    number that of one.
    """
    steps = re.findall(r"(\w+)|\[(\d+)\]|\[\?(\w+)\s*==\s*'([^']*)'\]", expression)
    out: Column | None = None
    for name, number, field, value in steps:
        if name:
            out = F.col(name) if out is None else out[name]
        elif number:
            out = F.get(out, F.lit(int(number)))
        else:
            out = F.filter(out, _equals(field, value))
    return out


def _equals(field: str, value: str):
    return lambda p: p[field] == value


def prompt(template: str, columns: dict[str, S.DataType]) -> Column:
    """A prompt: {Field} is a column, {@id} an earlier result as text, {@id.key} its field, {@id.0} its item; empty where there is none."""

    def part(reference: str) -> Column:
        name, *rest = reference.removeprefix("@").split(".")
        c, kind = F.col(name), columns[name]
        for step in rest:
            if step.isdigit():
                c, kind = F.get(c, F.lit(int(step))), kind.elementType
            elif isinstance(kind, S.MapType):
                c, kind = c[step], kind.valueType
            else:
                c, kind = c[step], kind[step].dataType
        return joined_items(c, kind)

    parts = re.split(r"\{(@?\w+(?:\.\w+)*)\}", template)
    return F.concat(*(part(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def joined_items(c: Column, kind: S.DataType) -> Column:
    """A value in a prompt: lists with commas."""
    if isinstance(kind, S.ArrayType):
        return F.coalesce(F.array_join(F.transform(c, lambda x: flat(x, kind.elementType)), ", "), F.lit(""))
    return flat(c, kind)


def value_prompt(template: str, keywords: Column, context: Column | None = None) -> Column:
    """A template with {value}: the keywords with commas, and the context if there is one."""
    value = F.array_join(keywords, ", ")
    if context is not None:
        value = F.concat(value, F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(" (Context: "), context, F.lit(")"))).otherwise(""))
    return F.concat(*(c for i, t in enumerate(template.split("{value}")) for c in ([value] if i else []) + [F.lit(t)]))


# --- structured profile ---------------------------------------------------------

#: What names of identifiers contain.
ID_MARKS = ("id", "url", "uri", "tmdb", "imdb", "isbn", "doi")


def person_like(fields: list[str]) -> bool:
    names = [f.lower() for f in fields]
    return any("name" in n for n in names) and any(n in ("role", "type") for n in names)


def identifier_share(keys: Column) -> Column:
    """Whether more than half of the keys look like those of identifiers."""
    marked = F.filter(keys, lambda k: reduce(lambda a, b: a | b, (F.lower(k).contains(m) for m in ID_MARKS)))
    return F.size(marked) > 0.5 * F.size(keys)


def structured(c: Column, kind: S.DataType) -> Column | None:
    """(field_type, weight, expandable) by the rule for lists and records; null for a type that it doesn't take."""
    row = lambda t, w, e=False: F.struct(F.lit(t).alias("field_type"), F.lit(w).alias("weight"), F.lit(e).alias("expandable"))
    if isinstance(kind, S.ArrayType):
        item = kind.elementType
        if isinstance(item, S.StructType):
            full = row("PEOPLE", 0.6) if person_like(item.names) else row("METADATA", 0.3)
        elif isinstance(item, S.StringType):
            full = F.when(F.length(F.array_join(F.filter(c, lambda x: x != ""), " ")) > 5, row("TEXT_CONTENT", 0.6, True)).otherwise(row("METADATA", 0.3))
        else:
            full = row("METADATA", 0.3)
        return F.when(F.size(c) > 0, full).otherwise(row("STRUCTURAL", 0.3))
    if isinstance(kind, S.StructType):
        return F.when(identifier_share(F.array(*map(F.lit, kind.names))), row("IDENTIFIERS", 0.0)).otherwise(row("STRUCTURAL", 0.3))
    if isinstance(kind, S.MapType):
        return F.when(identifier_share(F.map_keys(c)), row("IDENTIFIERS", 0.0)).otherwise(row("STRUCTURAL", 0.3))
    return None


def nested_profile(df: DataFrame, id_col: str, skip: tuple[str, ...] = ("id", "name", "type")) -> DataFrame:
    """(entity, field, field_type, weight, expandable, text) of all filled fields, whatever their types.

    The cascade of the flat profile with the structured rule between text and
    numbers: the text rule sees a value flattened.
    """
    from .records import is_identifier, is_numeric, is_text, text_weight

    each = []
    for f in df.schema:
        if f.name == id_col or f.name.lower() in skip:
            continue
        c, text = F.col(f"`{f.name}`"), flat(F.col(f"`{f.name}`"), f.dataType)
        nested = structured(c, f.dataType)
        row = lambda t, w, e=False: F.struct(F.lit(t).alias("field_type"), w.alias("weight") if isinstance(w, Column) else F.lit(w).alias("weight"), F.lit(e).alias("expandable"))
        numeric = F.lit(isinstance(f.dataType, S.NumericType | S.BooleanType)) | is_numeric(text)
        rest = nested if nested is not None else F.when(numeric, row("METADATA", 0.3)).when(is_identifier(text), row("IDENTIFIERS", 0.0)).otherwise(row("UNKNOWN", 0.3))
        plain = F.lit(not isinstance(f.dataType, S.NumericType | S.BooleanType))
        kind = F.when(plain & is_text(text), row("TEXT_CONTENT", text_weight(text), True)).otherwise(rest)
        filled = c.isNotNull() & ((F.size(c) > 0) if isinstance(f.dataType, S.ArrayType) else (text != "") if isinstance(f.dataType, S.StringType) else F.lit(True))
        each.append(F.when(filled, F.struct(F.lit(f.name).alias("field"), kind.alias("kind"), text.alias("text"))))
    rows = df.select(F.col(id_col).alias("entity"), F.explode(F.array_compact(F.array(*each))).alias("x"))
    return rows.select("entity", "x.field", "x.kind.*", "x.text")


# --- queries --------------------------------------------------------------------


def items(s, d) -> DataFrame:
    """Records with nested fields, one for each order: people, tags, identifiers and details from its columns."""
    o = table(s, d, "orders")
    person = lambda name, kind: F.struct(name.alias("Name"), kind.alias("Type"))
    people = F.array(person(F.concat(F.lit("Clérk "), (F.col("o_custkey") % 97).cast("string")), F.col("o_orderstatus")), person(F.concat(F.lit("Agent "), F.col("o_custkey").cast("string")), F.lit("F")), person(F.lower("o_orderpriority"), F.lit("O")))
    tags = F.filter(F.split(F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")), " "), lambda t: t != "")
    return o.select(
        F.col("o_orderkey").alias("Id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("Name"), people.alias("People"), tags.alias("Tags"),
        F.create_map(F.lit("tmdb_id"), F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 2 == 0, "url").otherwise("note"), F.lit("résumé 7")).alias("ProviderIds"),
        F.struct(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year")).alias("Details"), F.year("o_orderdate").alias("ProductionYear"),
        F.array(F.col("o_custkey"), F.col("o_custkey") % 7).alias("Scores"), F.concat(F.lit("An "), F.lower("o_orderpriority"), F.lit(" order, naïve and façade, of customer "), F.col("o_custkey").cast("string")).alias("Overview"),
    )


_I = """(SELECT o_orderkey AS id, ['Clérk ' || (o_custkey % 97), 'Agent ' || o_custkey, lower(o_orderpriority)] AS who, [o_orderstatus, 'F', 'O'] AS kinds, list_filter(string_split(lower(regexp_replace(o_orderpriority, '^[0-9]-', '')), ' '), lambda t: t <> '') AS tags,
 o_orderkey::VARCHAR AS tmdb, CASE WHEN o_custkey % 2 = 0 THEN 'url' ELSE 'note' END AS second, o_orderstatus AS status, year(o_orderdate) AS year, [o_custkey, o_custkey % 7] AS scores, 'An ' || lower(o_orderpriority) || ' order, naïve and façade, of customer ' || o_custkey AS overview FROM orders)"""
_PEOPLE = "array_to_string(list_transform(range(1, 4), lambda i: who[i] || ' ' || kinds[i]), ' ')"
_PICK = lambda kind: f"list_filter(list_transform(range(1, 4), lambda i: CASE WHEN kinds[i] = '{kind}' THEN who[i] END), lambda x: x IS NOT NULL)"
_TEXTY = lambda v: f"(length({v}) >= 10 AND length(regexp_replace({v}, '[^A-Za-z]', '', 'g')) > 0.5 * length(replace({v}, ' ', '')))"
_W = lambda v: f"CASE WHEN length({v}) > 200 THEN 1.0 WHEN length({v}) > 100 THEN 0.8 WHEN length({v}) > 30 THEN 0.6 ELSE 0.3 END"


def _fields_sql() -> str:
    rest = {"People": (_PEOPLE, "'PEOPLE'", "0.6", "false"), "Tags": ("array_to_string(tags, ' ')", "CASE WHEN length(array_to_string(tags, ' ')) > 5 THEN 'TEXT_CONTENT' ELSE 'METADATA' END", "CASE WHEN length(array_to_string(tags, ' ')) > 5 THEN 0.6 ELSE 0.3 END", "length(array_to_string(tags, ' ')) > 5"), "ProviderIds": ("tmdb || ' résumé 7'", "CASE WHEN second = 'url' THEN 'IDENTIFIERS' ELSE 'STRUCTURAL' END", "CASE WHEN second = 'url' THEN 0.0 ELSE 0.3 END", "false"), "Details": ("status || ' ' || year", "'STRUCTURAL'", "0.3", "false"), "Scores": ("array_to_string(scores, ' ')", "'METADATA'", "0.3", "false"), "Overview": ("overview", "'UNKNOWN'", "0.3", "false")}
    rows = [f"SELECT id AS entity, '{n}' AS field, CASE WHEN {_TEXTY(v)} THEN 'TEXT_CONTENT' ELSE {k} END AS field_type, (CASE WHEN {_TEXTY(v)} THEN {_W(v)} ELSE {w} END)::DOUBLE AS weight, {_TEXTY(v)} OR {e} AS expandable, {v} AS text FROM {_I}" for n, (v, k, w, e) in rest.items()]
    return " UNION ALL ".join([*rows, f"SELECT id, 'ProductionYear', 'METADATA', 0.3::DOUBLE, false, year::VARCHAR FROM {_I}"])


def _flat(s, d):
    i = items(s, d)
    return i.select("Id", *(c.alias(n.lower() + "_text") for n, c in flattened(i, "People", "Tags", "ProviderIds", "Details", "Scores", "Overview").items()))


def _normal(s, d):
    n = normalised_records(items(s, d))
    return n.select("Id", n.People[0].Name.alias("first"), F.array_join(F.map_values("ProviderIds"), "|").alias("ids"), "Overview", F.col("Details.year").cast("long").alias("year"))


def _text_values(s, d):
    i = items(s, d)
    kind = lambda n: i.schema[n].dataType
    return i.select("Id", text_value(F.col("Tags"), kind("Tags")).alias("tags"), text_value(F.col("ProviderIds"), kind("ProviderIds")).alias("ids"), text_value(F.col("Details"), kind("Details")).alias("details"), text_value(F.col("ProductionYear"), kind("ProductionYear")).alias("year"), *(key_component(F.col(n), kind(n), F.col("ProductionYear") > 1995).alias(f"{n.lower()}_key") for n in ("Tags", "Overview")))


def _prompts(s, d):
    i = items(s, d).withColumn("tagged", F.struct(F.col("Tags").alias("keywords"), F.col("Details.status").alias("kind")))
    types = {f.name: f.dataType for f in i.schema}
    one = prompt("Analyze {Name} of {@Details.year}: {@tagged.keywords}; first {@Tags.0}, fifth {@Tags.4}, {@ProviderIds.tmdb_id} ({@tagged.kind})", types)
    context = F.when(F.col("ProductionYear") > 1995, "recent orders")
    return i.select("Id", one.alias("prompt"), value_prompt("Related to {value}?", F.col("Tags"), context).alias("question"))


_A = lambda c: ascii_sql(c)
QUERIES = {
    "c4_flattened_records": _flat,
    "c4_normalised_records": _normal,
    "c4_text_values": _text_values,
    "c1_fast_keys": lambda s, d: items(s, d).select(F.explode(F.array(F.lit("release_date"), F.col("Overview"), F.concat(F.lit("Sci-Fi  "), F.element_at("Tags", 1)))).alias("raw")).select(T.fast_key_part(F.col("raw")).alias("key"), "raw").groupBy("key").agg(F.countDistinct("raw").alias("spellings"), F.min("raw").alias("chosen")),
    "b4_paths": lambda s, d: items(s, d).select("Id", F.array_join(path("People[?Type=='F'].Name"), ",").alias("finished"), path("People[0].Name").alias("lead"), F.array_join(path("People.Type"), ",").alias("kinds"), path("Details.status").alias("status"), F.get(path("People[?Type=='P'].Name"), F.lit(0)).alias("pending")),
    "b6_prompt_references": _prompts,
    "d2_nested_profile": lambda s, d: nested_profile(items(s, d), "Id"),
}
ORACLES = {
    "c4_flattened_records": f"SELECT id AS Id, {_A(_PEOPLE)} AS people_text, array_to_string(tags, ' ') AS tags_text, tmdb || ' resume 7' AS providerids_text, status || ' ' || year AS details_text, array_to_string(scores, ' ') AS scores_text, {_A('overview')} AS overview_text FROM {_I}",
    "c4_normalised_records": f"SELECT id AS Id, {_A('who[1]')} AS first, tmdb || '|resume 7' AS ids, {_A('overview')} AS Overview, year FROM {_I}",
    "c4_text_values": f"SELECT id AS Id, nullif(array_to_string(tags, ' '), '') AS tags, tmdb || ' résumé 7' AS ids, status AS details, year::VARCHAR AS year, CASE WHEN year > 1995 AND len(tags) > 0 THEN {key_sql(chr(97) + 'rray_to_string(tags, ' + chr(39) + ' ' + chr(39) + ')')} END AS tags_key, CASE WHEN year > 1995 THEN {key_sql('overview')} END AS overview_key FROM {_I}",
    "c1_fast_keys": f"SELECT key, count(DISTINCT raw) AS spellings, min(raw) AS chosen FROM (SELECT raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_A('lower(raw)')}, '[^a-z0-9\\s\\-]', '', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS key FROM (SELECT unnest(['release_date', overview, 'Sci-Fi  ' || tags[1]]) AS raw FROM {_I})) GROUP BY 1",
    "b4_paths": f"SELECT id AS Id, array_to_string({_PICK('F')}, ',') AS finished, who[1] AS lead, array_to_string(kinds, ',') AS kinds, status, ({_PICK('P')})[1] AS pending FROM {_I}",
    "b6_prompt_references": f"SELECT id AS Id, 'Analyze Order ' || id || ' of ' || year || ': ' || array_to_string(tags, ', ') || '; first ' || coalesce(tags[1], '') || ', fifth ' || coalesce(tags[5], '') || ', ' || tmdb || ' (' || status || ')' AS prompt, 'Related to ' || array_to_string(tags, ', ') || CASE WHEN year > 1995 THEN ' (Context: recent orders)' ELSE '' END || '?' AS question FROM {_I}",
    "d2_nested_profile": _fields_sql(),
}
