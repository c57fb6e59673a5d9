"""Records of any fields: JSON items as VARIANT, their fields unpivoted and profiled by the whole cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .nested import ID_MARKS
from .records import is_identifier, is_numeric, is_text, issues, summary, text_weight
from .text_jobs import ascii_sql

#: Names that are those of the record itself and not of its fields.
UNIVERSAL = ("id", "name", "type")
#: Tokens of a JSON text without white space: strings (a name has its colon), empty containers, other scalars.
_TOKENS = r'"(?:[^"\\]|\\.)*+":?|\[\]|\{\}|[^\[\]{},:"]+'


def parsed(lines: DataFrame, required: Sequence[str] = ("Id", "Name"), raw: str = "raw") -> DataFrame:
    """lines with item (VARIANT) and reason: null where the line is a JSON object that has the required names with values.

    Works on streams.  Other columns are kept.  Null lines are not JSON.
    """
    item = F.try_parse_json(F.col(raw))
    kind = F.schema_of_variant("item")
    filled = lambda n: F.coalesce(F.try_variant_get("item", f"$.{n}", "string"), F.lit("")) != ""
    lacking = F.array_join(F.array_compact(F.array(*(F.when(~filled(n), F.lit(n)) for n in required))), ", ") if required else F.lit("")
    reason = F.when(F.col("item").isNull(), "not JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object").when(lacking != "", F.concat(F.lit("without "), lacking))
    return lines.withColumn("item", item).withColumn("reason", reason)


def open_fields(items: DataFrame, id_col: str, item: str = "item") -> DataFrame:
    """entity, field, value (VARIANT), kind, json of every filled field of VARIANT objects, whatever their names; kind is its type's name.

    Null, empty text and empty list are not filled.  Values that are no objects
    have no fields.
    """
    spark = items.sparkSession
    objects = items.where(F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))).select(F.col(id_col).alias("entity"), F.col(item).alias("item"))
    each = objects.lateralJoin(spark.tvf.variant_explode(F.col("item").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    out = each.select("entity", F.col("key").alias("field"), "value", kind.alias("kind"), F.to_json("value").alias("json"))
    return out.where(~F.lower("field").isin(*UNIVERSAL) & (F.col("kind") != "VOID") & ~F.col("json").isin('""', "[]"))


def flat_json(json: Column) -> Column:
    """The values of a JSON text without white space, of any depth, joined by spaces: nulls left out, empty containers as empty texts, True and False.

    The values of an object come in the order of its keys if the text was made of a VARIANT, which keeps them sorted.
    """
    plain = F.filter(F.regexp_extract_all(json, F.lit(_TOKENS), F.lit(0)), lambda t: ~F.endswith(t, F.lit('":')) & (t != "null"))
    quoted = F.transform(plain, lambda t: F.when(t.isin("[]", "{}"), '""').when(t == "true", '"True"').when(t == "false", '"False"').otherwise(t))
    return F.array_join(F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>"), " ")


def _marked(keys: Column) -> Column:
    """How many keys look like those of identifiers."""
    return F.size(F.filter(keys, lambda k: F.lower(k).rlike("|".join(ID_MARKS))))


def open_profile(fields: DataFrame) -> DataFrame:
    """entity, field, field_type, weight, expandable, text of open_fields by the cascade text, structure, number, identifier."""
    row = lambda t, w, e=False: F.struct(F.lit(t).alias("field_type"), w.alias("weight") if isinstance(w, Column) else F.lit(w).alias("weight"), F.lit(e).alias("expandable"))
    text, kind = F.col("text"), F.col("kind")
    keys = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    first = F.to_json(F.try_variant_get("value", "$[0]", "variant"))
    names = F.transform(F.coalesce(F.json_object_keys(first), F.array().cast("array<string>")), F.lower)
    person = F.exists(names, lambda k: F.contains(k, F.lit("name"))) & F.arrays_overlap(names, F.array(F.lit("role"), F.lit("type")))
    # Items of a list of texts, empty ones left out.
    joined = F.array_join(F.filter(F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda v: F.trim(flat_json(F.to_json(v)))), lambda x: x != ""), " ")
    listed = F.when(person, row("PEOPLE", 0.6)).when(F.startswith(first, F.lit('"')) & (F.length(joined) > 5), row("TEXT_CONTENT", 0.6, True)).otherwise(row("METADATA", 0.3))
    structured = F.when(kind == "ARRAY", listed).when(kind == "OBJECT", F.when(_marked(keys) > 0.5 * F.size(keys), row("IDENTIFIERS", 0.0)).otherwise(row("STRUCTURAL", 0.3)))
    plain = F.when(~kind.isin("STRING") | is_numeric(text), row("METADATA", 0.3)).when(is_identifier(text), row("IDENTIFIERS", 0.0)).otherwise(row("UNKNOWN", 0.3))
    typed = F.when(is_text(F.col("ascii")), row("TEXT_CONTENT", text_weight(F.col("ascii")), True)).when(kind.isin("ARRAY", "OBJECT"), structured).otherwise(plain)
    seen = fields.withColumn("text", flat_json(F.col("json"))).withColumn("ascii", T.to_ascii(F.col("text")))
    return seen.select("entity", "field", typed.alias("x"), "text").select("entity", "field", "x.*", "text")


def field_catalog(fields: DataFrame) -> DataFrame:
    """field, records, kinds: every field that any record has, in how many, and the types of its values."""
    return fields.groupBy("field").agg(F.countDistinct("entity").alias("records"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


# --- queries --------------------------------------------------------------------


def lines(s, d) -> DataFrame:
    """A JSON line for each document, whose fields and their names depend on the row; some lines are cut, no objects, or lack a name."""
    c = F.col
    bare = lambda x: F.expr(f"substring({x}, 6, length({x}) - 6)")
    docs = table(s, d, "documents").withColumns({"body": F.to_json(F.struct(F.col("text").alias("v"))), "cut": F.to_json(F.struct(F.substring("text", 1, 40).alias("v")))})
    docs = docs.withColumns({"body": bare("body"), "cut": bare("cut")})
    i, when = c("doc_id"), lambda m, r, x: F.when(F.col("doc_id") % m == r, x)
    pieces = [
        F.concat(F.lit('"Id":'), i), F.when(i % 13 != 6, F.concat(F.lit('"Name":"Document '), i, F.lit('"'))), F.concat(F.lit('"body_'), c("lang"), F.lit('":'), c("body")), F.concat(F.lit('"'), c("source"), F.lit('":'), c("n_chars")),
        when(3, 0, F.concat(F.lit('"People":[{"FullName":"Author of '), c("source"), F.lit('","Role":"r","n":'), i, F.lit('},{"Name":"7","Role":"q"}]'))), when(4, 1, F.concat(F.lit('"Tags":["'), c("source"), F.lit('",'), F.lit('"'), c("lang"), F.lit('","","naïve"]'))),
        when(5, 2, F.concat(F.lit('"Links":{"tmdb_id":'), i, F.lit(',"url":"https://e.org/'), i, F.lit('"}'))), when(7, 3, F.concat(F.lit('"Deep":{"a":{"b":['), c("cut"), F.lit(",1,true,null]},"), F.lit('"c":[],"d":"\\"é\\""}'))),
        when(6, 5, F.lit('"Empty":"","None":null,"List":[],"Flag":false')), when(8, 2, F.concat(F.lit('"Etag":"'), F.md5("text"), F.lit('","Year":"1999","Rating":['), i, F.lit(",7]"))),
    ]
    body = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pieces)), ","), F.lit("}"))
    raw = F.when(i % 11 == 4, F.expr("substring(raw, 1, length(raw) - 1)")).when(i % 17 == 8, F.concat(F.lit("["), c("raw"), F.lit("]"))).otherwise(c("raw"))
    return docs.withColumn("raw", body).select("doc_id", raw.alias("raw"))


def _fields(s, d):
    return open_fields(parsed(lines(s, d)).where("reason is null"), "doc_id")


_L = """(SELECT doc_id, CASE WHEN doc_id % 11 = 4 THEN raw[:-2] WHEN doc_id % 17 = 8 THEN '[' || raw || ']' ELSE raw END AS raw FROM (SELECT doc_id, '{' || array_to_string(list_filter([
 '"Id":' || doc_id, CASE WHEN doc_id % 13 <> 6 THEN '"Name":"Document ' || doc_id || '"' END, '"body_' || lang || '":' || to_json(text), '"' || source || '":' || n_chars,
 CASE WHEN doc_id % 3 = 0 THEN '"People":[{"FullName":"Author of ' || source || '","Role":"r","n":' || doc_id || '},{"Name":"7","Role":"q"}]' END, CASE WHEN doc_id % 4 = 1 THEN '"Tags":["' || source || '","' || lang || '","","naïve"]' END,
 CASE WHEN doc_id % 5 = 2 THEN '"Links":{"tmdb_id":' || doc_id || ',"url":"https://e.org/' || doc_id || '"}' END, CASE WHEN doc_id % 7 = 3 THEN '"Deep":{"a":{"b":[' || to_json(text[1:40]) || ',1,true,null]},"c":[],"d":"\\"é\\""}' END,
 CASE WHEN doc_id % 6 = 5 THEN '"Empty":"","None":null,"List":[],"Flag":false' END, CASE WHEN doc_id % 8 = 2 THEN '"Etag":"' || md5(text) || '","Year":"1999","Rating":[' || doc_id || ',7]' END
], lambda x: x IS NOT NULL), ',') || '}' AS raw FROM documents))"""
_PARSED = f"(SELECT doc_id, raw, CASE WHEN NOT json_valid(raw) THEN 'not JSON' WHEN json_type(raw) <> 'OBJECT' THEN 'not an object' WHEN coalesce(json_extract_string(raw, '$.Name'), '') = '' THEN 'without Name' END AS reason FROM {_L})"
_KIND = "CASE type WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' ELSE type END"
_EACH = f"(SELECT doc_id AS entity, key AS field, value, {_KIND} AS kind FROM (SELECT * FROM {_PARSED} WHERE reason IS NULL) p, json_each(p.raw) WHERE lower(key) NOT IN ('id', 'name', 'type') AND type <> 'NULL' AND value::VARCHAR NOT IN ('\"\"', '[]'))"
# Leaves in the order of the text; an empty container is an empty text.
_LEAF = "CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' WHEN t.type = 'BOOLEAN' THEN CASE t.atom::VARCHAR WHEN 'true' THEN 'True' ELSE 'False' END WHEN t.type IN ('ARRAY', 'OBJECT') THEN '' ELSE t.atom::VARCHAR END"
_TEXTS = f"(SELECT e.*, coalesce((SELECT string_agg({_LEAF}, ' ' ORDER BY t.id) FROM json_tree(e.value) t WHERE t.type NOT IN ('NULL', 'ARRAY', 'OBJECT') OR t.value::VARCHAR IN ('[]', '{{}}')), '') AS text FROM {_EACH} e)"
_ASCII = f"(SELECT *, {ascii_sql('text')} AS a FROM {_TEXTS})"
_PEOPLE = "(kind = 'ARRAY' AND json_type(value, '$[0]') = 'OBJECT' AND len(list_filter(json_keys(value, '$[0]'), lambda k: contains(lower(k), 'name'))) > 0 AND len(list_filter(json_keys(value, '$[0]'), lambda k: lower(k) IN ('role', 'type'))) > 0)"
_TEXT_LIST = "(kind = 'ARRAY' AND json_type(value, '$[0]') = 'VARCHAR' AND length(array_to_string(list_filter(json_extract_string(value, '$[*]'), lambda x: x <> ''), ' ')) > 5)"
_MARKS = f"list_filter(json_keys(value), lambda k: regexp_matches(lower(k), '{'|'.join(ID_MARKS)}'))"
_TYPED = f"""(SELECT *, CASE WHEN length(a) >= 10 AND length(regexp_replace(a, '[^A-Za-z]', '', 'g')) > 0.5 * length(replace(a, ' ', '')) THEN 'TEXT_CONTENT' WHEN {_PEOPLE} THEN 'PEOPLE' WHEN {_TEXT_LIST} THEN 'TEXT_LIST' WHEN kind = 'ARRAY' THEN 'METADATA'
 WHEN kind = 'OBJECT' THEN CASE WHEN len({_MARKS}) > 0.5 * len(json_keys(value)) THEN 'IDENTIFIERS' ELSE 'STRUCTURAL' END WHEN kind <> 'STRING' OR regexp_matches(text, '^[0-9.,]+$') THEN 'METADATA' WHEN regexp_matches(text, '^(?:https?://|ftp://|www\\.|mailto:)') OR regexp_matches(text, '^[0-9a-fA-F]{{17,}}$') THEN 'IDENTIFIERS' ELSE 'UNKNOWN' END AS ft FROM {_ASCII})"""
_OPEN = f"SELECT entity, field, replace(ft, 'TEXT_LIST', 'TEXT_CONTENT') AS field_type, (CASE ft WHEN 'TEXT_CONTENT' THEN CASE WHEN length(a) > 200 THEN 1.0 WHEN length(a) > 100 THEN 0.8 WHEN length(a) > 30 THEN 0.6 ELSE 0.3 END WHEN 'IDENTIFIERS' THEN 0.0 WHEN 'PEOPLE' THEN 0.6 WHEN 'TEXT_LIST' THEN 0.6 ELSE 0.3 END)::DOUBLE AS weight, ft IN ('TEXT_CONTENT', 'TEXT_LIST') AS expandable, text FROM {_TYPED}"
_COUNTS = ", ".join(f"count(*) FILTER (field_type = '{t}') AS {t.lower()}" for t in ("TEXT_CONTENT", "PEOPLE", "METADATA", "IDENTIFIERS", "STRUCTURAL", "UNKNOWN"))
_SUMMED = f"SELECT entity, count(*) AS total, {_COUNTS}, count(*) FILTER (expandable) AS expandable, coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER (field_type = 'UNKNOWN'), '') AS unknown_fields FROM ({_OPEN}) GROUP BY 1"

QUERIES = {
    "a1_open_items": lambda s, d: parsed(lines(s, d)).select("doc_id", F.length("raw").cast("long").alias("size"), F.coalesce("reason", F.lit("accepted")).alias("reason")),
    "d1_open_catalog": lambda s, d: field_catalog(_fields(s, d)),
    "d1_open_profile": lambda s, d: open_profile(_fields(s, d)),
    "d4_open_summary": lambda s, d: summary(open_profile(_fields(s, d))),
    "b10_open_issues": lambda s, d: issues(summary(open_profile(_fields(s, d)))),
}
ORACLES = {
    "a1_open_items": f"SELECT doc_id, length(raw)::BIGINT AS size, coalesce(reason, 'accepted') AS reason FROM {_PARSED}",
    "d1_open_catalog": f"SELECT field, count(DISTINCT entity) AS records, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM {_EACH} GROUP BY 1",
    "d1_open_profile": _OPEN,
    "d4_open_summary": _SUMMED,
    "b10_open_issues": f"SELECT entity, array_to_string(list_filter([CASE WHEN text_content = 0 THEN 'no_text_fields' END, CASE WHEN expandable = 0 THEN 'no_expandable_fields' END, CASE WHEN unknown > 3 THEN 'many_unknown_fields' END], lambda x: x IS NOT NULL), ',') AS issues FROM ({_SUMMED})",
}
