"""Validation, projection, derived fields and semantic profiling of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import as_json, latest, scratch_path, stamped, table, upsert, with_options, write_routed
from .text_jobs import key_sql

# --- validation -----------------------------------------------------------------


#: Types of a constraint and what a text must be cast to.
CASTS = {"integer": "bigint", "float": "double", "boolean": "boolean"}


def constraint_errors(constraints: dict[str, dict], required: tuple[str, ...] = (), types: dict[str, str] | None = None) -> Column:
    """Array of "field:rule" for every constraint a row breaks.

    Rules: type (integer, float, boolean, string, list, dict), min, max,
    max_items, allowed (of a list: of all its items).  A text that can't be cast
    to its type breaks the rule `type`; limits hold for the value that was cast.
    A required name counts only where it has a constraint entry as well.  types
    names the columns that hold arrays or records, whose `type` is then known.
    """
    found, types = [], types or {}
    for field, rules in constraints.items():
        c = F.col(field)
        if field in required:
            found.append(F.when(c.isNull(), f"{field}:required"))
        kind = rules.get("type")
        if kind in CASTS:
            found.append(F.when(c.isNotNull() & F.expr(f"try_cast(`{field}` AS {CASTS[kind]})").isNull(), f"{field}:type"))
            c = F.expr(f"try_cast(`{field}` AS {CASTS[kind]})")
        elif kind in ("list", "dict") and types.get(field, kind) != kind:
            found.append(F.when(c.isNotNull(), f"{field}:type"))
            continue
        if "min" in rules:
            found.append(F.when(c < rules["min"], f"{field}:min"))
        if "max" in rules:
            found.append(F.when(c > rules["max"], f"{field}:max"))
        if "max_items" in rules:
            found.append(F.when(F.size(c) > rules["max_items"], f"{field}:max_items"))
        if "allowed" in rules:
            wrong = ~F.forall(c, _within(rules["allowed"])) if kind == "list" else ~c.isin(rules["allowed"])
            found.append(F.when(wrong, f"{field}:allowed"))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _within(values):
    return lambda x: x.isin(values)


def split_valid(rows: DataFrame, constraints: dict, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that break nothing, and the others with their errors."""
    marked = rows.withColumn("errors", constraint_errors(constraints, required))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


# --- derived fields -------------------------------------------------------------


def extract(array: str, equal: dict[str, str], value: str, multiple: bool = False) -> Column:
    """Field of the structs that equal all given values: of the first one, or of all; unset where empty."""
    hits = F.filter(array, lambda p: reduce(lambda a, b: a & b, (p[k] == v for k, v in equal.items()), F.lit(True)))
    if multiple:
        kept = F.filter(F.transform(hits, lambda p: p[value]), lambda x: x.isNotNull() & (x.cast("string") != ""))
        return F.when(F.size(kept) > 0, kept)
    first = F.get(hits, F.lit(0))[value]
    return F.when(first.cast("string") != "", first)


def placeholder(source: str | None, field: str, columns: list[str]) -> Column:
    """The source column; a text in its place where none is named; null where it is missing."""
    if source is None:  # a fixed value
        return F.lit(f"[Synthetic {field} - would be enriched by plugins]")
    return F.col(source) if source in columns else F.lit(None).cast("string")


def rendered(template: str) -> Column:
    """A prompt: {Field} is the value of the column, empty where null."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def universal(*names: Column, default: str) -> Column:
    """The first value that isn't null or empty, else a default."""
    return F.coalesce(*(F.nullif(n.cast("string"), F.lit("")) for n in names), F.lit(default))


def missing_fields(fields: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), fields)


def merge_enrichment(record: DataFrame, plugin: str, new: dict[str, Column], original: list[str], earlier: list[str], version: str = "1.0") -> DataFrame:
    """The record with a plugin's fields: over an original of the name, beside an earlier enrichment as <plugin>_<name>; all of them nested under plugin_enhancements.

    processing lists the plugins that have enriched the record, plugin_versions
    their versions; both go on from what the record holds.
    """
    own = F.struct(*(c.alias(k) for k, c in new.items())).alias(plugin)
    before = [F.col(f"plugin_enhancements.`{n}`").alias(n) for n in record.schema["plugin_enhancements"].dataType.names if n != plugin] if "plugin_enhancements" in record.columns else []
    done = F.col("processing") if "processing" in record.columns else F.array().cast("array<string>")
    versions = F.col("plugin_versions") if "plugin_versions" in record.columns else F.create_map().cast("map<string,string>")
    flat = {(f"{plugin}_{k}" if k in earlier and k not in original else k): c for k, c in new.items()}
    return record.withColumns({"plugin_enhancements": F.struct(*before, own), "processing": F.array_union(done, F.array(F.lit(plugin))), "plugin_versions": F.map_concat(F.map_filter(versions, lambda k, v: k != plugin), F.create_map(F.lit(plugin), F.lit(version))), **flat})


def new_fields(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, new_fields: the names that an enrichment filled and the record had not, in the order of the enriched table."""
    names = lambda df: F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in df.columns if c != key)))
    had = before.select(F.col(key), names(before).alias("had"))
    return after.select(F.col(key), names(after).alias("has")).join(had, key).select(key, F.array_except("has", "had").alias("new_fields"))


def verified(items: DataFrame, version: str = "2.0", kind: str = "_media_type") -> DataFrame:
    """Of each media type: items, those enriched, and the names of fields that any of them has filled."""
    filled = [F.when(F.count(F.col(f"`{c}`")) > 0, F.lit(c)) for c in items.columns if not c.startswith("_")]
    return items.groupBy(kind).agg(F.count("*").alias("total"), F.count_if(F.col("_enrichment_version") == version).alias("enriched"), F.array_join(F.array_compact(F.array(*filled)), ",").alias("fields"))


def ingested(items: DataFrame, constraints: dict, media_type: str, required: tuple[str, ...] = (), enrich=None, now=None) -> tuple[DataFrame, DataFrame]:
    """A batch of items: those that are valid, enriched unless there is no enrichment, and stamped; and the others with their errors."""
    valid, invalid = split_valid(items, constraints, required)
    return stamped(enrich(valid) if enrich else valid, media_type, "2.0" if enrich else "1.0", now), invalid


# --- semantic profile -----------------------------------------------------------


def long_form(rows: DataFrame, id_col: str, skip: tuple[str, ...] = ("id", "name", "type")) -> DataFrame:
    """(entity, field, value) of all filled fields, without id, name and type."""
    fields = [c for c in rows.columns if c != id_col and c.lower() not in skip]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields)))
    return rows.select(F.col(id_col).alias("entity"), pairs.alias("x")).select("entity", "x.field", "x.value").where("value is not null and value <> '' and value <> '[]'")


def is_text(v: Column) -> Column:
    letters, solid = F.length(F.regexp_replace(v, "[^A-Za-z]", "")), F.length(F.replace(v, F.lit(" "), F.lit("")))
    return (F.length(v) >= 10) & (letters > 0.5 * solid)


def is_numeric(v: Column) -> Column:
    return v.rlike(r"^\d{4}$") | v.rlike(r"^[\d.,]+$")


def is_identifier(v: Column) -> Column:
    # What identifiers look like.
    return v.rlike(r"^(?:https?://|ftp://|www\.|mailto:)") | v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$") | v.rlike("^[0-9a-fA-F]{17,}$")


def classified(v: Column, rules: list[tuple[int, Column, str]] | None = None) -> Column:
    """Field type of a value: the rule of the highest priority that holds."""
    rules = rules or [(100, is_text(v), "TEXT_CONTENT"), (80, is_numeric(v), "METADATA"), (70, is_identifier(v), "IDENTIFIERS")]
    ordered = sorted(rules, key=lambda r: -r[0])
    return F.coalesce(*(F.when(p, F.lit(t)) for _, p, t in ordered), F.lit("UNKNOWN"))


def text_weight(v: Column) -> Column:
    n = F.length(v)
    return F.when(n > 200, 1.0).when(n > 100, 0.8).when(n > 30, 0.6).otherwise(0.3)


def profile(rows: DataFrame, id_col: str) -> DataFrame:
    v = F.col("value")
    kind = classified(v)
    weight = F.when(kind == "TEXT_CONTENT", text_weight(v)).when(kind == "IDENTIFIERS", 0.0).otherwise(0.3)
    return long_form(rows, id_col).withColumns({"field_type": kind, "weight": weight, "expandable": kind == "TEXT_CONTENT"})


def summary(profiled: DataFrame) -> DataFrame:
    """Counts of fields by type for each entity."""
    types = ("TEXT_CONTENT", "PEOPLE", "METADATA", "IDENTIFIERS", "STRUCTURAL", "UNKNOWN")
    return profiled.groupBy("entity").agg(F.count("*").alias("total"), *(F.count_if(F.col("field_type") == t).alias(t.lower()) for t in types), F.count_if("expandable").alias("expandable"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("field_type") == "UNKNOWN", F.col("field")))), ",").alias("unknown_fields"))


def issues(summarised: DataFrame, records: DataFrame | None = None, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """entity, issues: no text, nothing to expand, many unknown fields, and with the records at hand a missing name or id."""
    found = [F.when(F.col("text_content") == 0, "no_text_fields"), F.when(F.col("expandable") == 0, "no_expandable_fields"), F.when(F.col("unknown") > 3, "many_unknown_fields")]
    if records is not None:
        bare = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "unknown", "Unknown")
        own = records.select(F.col(id_col).alias("own_id"), bare(name_col).alias("no_name"), bare(id_col).alias("no_id"))
        summarised = own.join(summarised, F.col("own_id").eqNullSafe(F.col("entity")), "left").withColumn("entity", F.col("own_id")).fillna(0, ["text_content", "expandable", "unknown"])
        found = [F.when(F.col("no_name"), "missing_name"), F.when(F.col("no_id"), "missing_id"), *found]
    return summarised.select("entity", F.array_join(F.array_compact(F.array(*found)), ",").alias("issues"))


def text_views(profiled: DataFrame) -> DataFrame:
    """entity, field (lower case), text, weighted, expandable: the text fields of each entity, their weights, and whether they are in the view of fields to expand."""
    return profiled.where("field_type = 'TEXT_CONTENT'").select("entity", F.lower("field").alias("field"), F.trim("value").alias("text"), F.col("weight").alias("weighted"), "expandable")


def sample_report(profiled: DataFrame) -> DataFrame:
    """Of each entity: length of its texts, sum of their weights, names of the fields to expand."""
    t = text_views(profiled)
    return t.groupBy("entity").agg(F.sum(F.length("text")).alias("length"), F.round(F.sum("weighted"), 6).alias("weight"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("expandable"), F.col("field")))), ",").alias("expandable"))


# --- queries --------------------------------------------------------------------

PART_RULES = {"p_size": {"min": 5, "max": 45}, "p_retailprice": {"max": 1800.0}, "p_brand": {"allowed": ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#23"]}}
_ERRORS = "array_to_string(list_filter([CASE WHEN p_size < 5 THEN 'p_size:min' END, CASE WHEN p_size > 45 THEN 'p_size:max' END, CASE WHEN p_retailprice > 1800 THEN 'p_retailprice:max' END, CASE WHEN p_brand NOT IN ('Brand#11','Brand#12','Brand#13','Brand#21','Brand#22','Brand#23') THEN 'p_brand:allowed' END], lambda x: x IS NOT NULL), ',')"


def people(spark, sf) -> DataFrame:
    """A record for each order: an array of structs from its columns."""
    one = lambda n, t, r: F.struct(n.alias("Name"), t.alias("Type"), r.alias("Role"))
    c = F.col
    return table(spark, sf, "orders").select("o_orderkey", F.array(one(F.when(c("o_custkey") % 5 > 0, c("o_custkey").cast("string")), c("o_orderpriority"), c("o_orderstatus")), one(c("o_orderstatus"), F.lit("1-URGENT"), F.lit("F")), one(F.year("o_orderdate").cast("string"), c("o_orderpriority"), F.lit("F"))).alias("People"))


_PERSON = "[{'n': CASE WHEN o_custkey % 5 > 0 THEN o_custkey::VARCHAR END, 't': o_orderpriority, 'r': o_orderstatus}, {'n': o_orderstatus, 't': '1-URGENT', 'r': 'F'}, {'n': year(o_orderdate)::VARCHAR, 't': o_orderpriority, 'r': 'F'}]"
_FIRST = f"SELECT o_orderkey, list_filter(p, lambda x: x.t = '1-URGENT')[1].n AS director, coalesce(array_to_string(list_filter(list_transform(list_filter(p, lambda x: x.t = '1-URGENT' AND x.r = 'F'), lambda x: x.n), lambda n: n IS NOT NULL), ','), '') AS actors FROM (SELECT o_orderkey, {_PERSON} AS p FROM orders)"


def _page_profile(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.col("html").alias("head"), F.length("html").alias("size"), F.md5("html").alias("etag"), F.lit(None).cast("string").alias("none"))
    return profile(p, "page_id")


_PROFILE = """SELECT entity, field, value, kind AS field_type, CASE kind WHEN 'TEXT_CONTENT' THEN CASE WHEN length(value) > 200 THEN 1.0 WHEN length(value) > 100 THEN 0.8 WHEN length(value) > 30 THEN 0.6 ELSE 0.3 END WHEN 'IDENTIFIERS' THEN 0.0 ELSE 0.3 END::DOUBLE AS weight, kind = 'TEXT_CONTENT' AS expandable
FROM (SELECT *, CASE WHEN length(value) >= 10 AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) > 0.5 * length(replace(value, ' ', '')) THEN 'TEXT_CONTENT' WHEN regexp_matches(value, '^[0-9.,]+$') THEN 'METADATA' WHEN regexp_matches(value, '^(?:https?://|ftp://|www\\.|mailto:)') OR regexp_matches(value, '^[0-9a-fA-F]{17,}$') THEN 'IDENTIFIERS' ELSE 'UNKNOWN' END AS kind
FROM (SELECT page_id AS entity, unnest(['url', 'head', 'size', 'etag']) AS field, unnest([url, html, length(html)::VARCHAR, md5(html)]) AS value FROM pages) WHERE value <> '')"""
_SUMMARY = f"SELECT entity, count(*) AS total, count(*) FILTER (field_type = 'TEXT_CONTENT') AS text_content, count(*) FILTER (field_type = 'PEOPLE') AS people, count(*) FILTER (field_type = 'METADATA') AS metadata, count(*) FILTER (field_type = 'IDENTIFIERS') AS identifiers, count(*) FILTER (field_type = 'STRUCTURAL') AS structural, count(*) FILTER (field_type = 'UNKNOWN') AS unknown, count(*) FILTER (expandable) AS expandable, coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER (field_type = 'UNKNOWN'), '') AS unknown_fields FROM ({_PROFILE}) GROUP BY 1"
_TYPED = {"p_size": {"type": "integer", "min": 5}, "p_retailprice": {"type": "float", "max": 1800.0}, "p_brand": {"type": "boolean"}, "words": {"type": "list", "max_items": 1, "allowed": ["small", "red", "ring", "widget"]}, "p_name": {"type": "dict"}}


def _typed(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"), "p_brand", F.split("p_name", " ").alias("words"), "p_name")
    return p.select("p_partkey", F.array_join(constraint_errors(_TYPED, ("p_size",), {"words": "list", "p_name": "string"}), ",").alias("errors"))


def _batch(s, d):
    """Both halves of a batch: accepted parts by media type, the others by their errors."""
    p = table(s, d, "part").withColumn("kind", F.lower("p_type"))
    accepted, rejected = ingested(p, PART_RULES, "part", enrich=lambda v: v.withColumn("key", T.key_part(F.col("p_name"))), now="2024-01-01")
    return accepted.select("p_partkey", F.col("_enrichment_version").alias("version"), "key", F.lit("").alias("errors")).unionByName(rejected.select("p_partkey", F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("key"), F.array_join("errors", ",").alias("errors")))


def _stored(s, d) -> DataFrame:
    """Items of two media types as they are stored: orders that are finished have been enriched."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("Id"), F.col("o_orderpriority").alias("Tag"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("Score"), F.when(F.col("o_orderstatus") == "F", "2.0").otherwise("1.0").alias("v"))
    p = table(s, d, "part").select(F.col("p_partkey").alias("Id"), F.lit(None).cast("string").alias("Tag"), F.col("p_retailprice").alias("Score"), F.when(F.col("p_size") > 25, "2.0").otherwise("1.0").alias("v"))
    return stamped(o, "order").withColumn("_enrichment_version", F.col("v")).drop("v").unionByName(stamped(p, "part").withColumn("_enrichment_version", F.col("v")).drop("v"))


def _routed(s, d):
    """A folder for each media type, written and read again."""
    path = scratch_path(s, "routed")
    write_routed(_stored(s, d), path)
    return s.read.parquet(path).groupBy("_media_type").agg(F.count("*").alias("n"), F.min("Id").alias("first"))


def _new_fields(s, d):
    before = table(s, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_type")).alias("kind"))
    after = before.withColumns({"kind": F.coalesce("kind", F.lit("plain")), "key": T.key_part(F.col("p_name")), "none": F.lit(None).cast("string")})
    return new_fields(before, after, "p_partkey").select("p_partkey", F.array_join("new_fields", ",").alias("new_fields"))


def _merged(s, d):
    n = table(s, d, "nation").withColumn("keywords", F.lit("old"))
    one = merge_enrichment(n, "graph", {"keywords": F.lower("n_name"), "n_regionkey": F.col("n_regionkey") + 1}, ["n_regionkey"], ["keywords"])
    return merge_enrichment(one, "llm", {"mood": F.upper("n_name")}, ["n_regionkey"], ["keywords"], "2.1")


def _upsert(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"))
    return upsert(o.where("status = 'F'").drop("status").groupBy("id").agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value")), o.where("status <> 'F'").drop("status"), "id", "version")


QUERIES = {
    "a2_catalog_pull": lambda s, d: latest(table(s, d, "orders"), ["o_orderkey", "o_totalprice"], "o_orderkey", 50, o_orderstatus="F"),
    "a3_upsert": _upsert,
    "a5_ingest_summary": lambda s, d: table(s, d, "part").withColumn("e", constraint_errors(PART_RULES)).agg(F.count("*").alias("processed"), F.count_if(F.size("e") == 0).alias("accepted"), F.count_if(F.size("e") > 0).alias("rejected")),
    "a7_json_output": lambda s, d: as_json(table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("p_brand"))),
    "a7_output_options": lambda s, d: as_json(with_options(table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("p_brand"), F.lit("m").alias("_metadata"), F.lit(3).alias("_time_ms"), F.lit(0.5).alias("brand_confidence")), metadata=True, confidences=False, timings=False), False),
    "a8_verify": lambda s, d: verified(_stored(s, d)),
    "a4_batch_ingest": _batch,
    "a6_routed_output": _routed,
    "a9_new_fields": _new_fields,
    "b1_typed_constraints": _typed,
    "b2_validation": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(constraint_errors(PART_RULES, ("p_size",)), ",").alias("errors")),
    "b3_computed_fields": lambda s, d: people(s, d).select("o_orderkey", extract("People", {"Type": "1-URGENT"}, "Name").alias("director"), F.coalesce(F.array_join(extract("People", {"Type": "1-URGENT", "Role": "F"}, "Name", True), ","), F.lit("")).alias("actors")),
    "b5_source_fields": lambda s, d: (lambda t: t.select("s_suppkey", placeholder("s_name", "Name", t.columns).alias("name"), placeholder(None, "Director", t.columns).alias("director"), placeholder("nope", "X", t.columns).alias("x")))(table(s, d, "supplier")),
    "b6_prompts": lambda s, d: table(s, d, "part").select("p_partkey", rendered("Describe {p_name} by {p_brand} (size {p_size}).").alias("prompt")),
    "b7_preview": lambda s, d: table(s, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview")),
    "b8_universal_keys": lambda s, d: table(s, d, "customer").select("c_custkey", universal(F.when(F.col("c_custkey") % 3 == 0, ""), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")), default="Unknown").alias("name")),
    "b9_required_fields": lambda s, d: table(s, d, "events").select("event_id", F.array_join(missing_fields(F.json_object_keys("props"), ["k", "concept"]), ",").alias("missing")),
    "b11_merge_enrichment": lambda s, d: _merged(s, d).select("n_nationkey", "n_regionkey", "keywords", "graph_keywords", F.col("plugin_enhancements.graph.keywords").alias("nested"), F.col("plugin_enhancements.llm.mood").alias("mood"), F.array_join("processing", ",").alias("processing"), F.concat(F.col("plugin_versions.graph"), F.lit("/"), F.col("plugin_versions.llm")).alias("versions")),
    "d2_field_profile": _page_profile,
    "d3_text_views": lambda s, d: text_views(_page_profile(s, d)).groupBy("field").agg(F.count("*").alias("n"), F.count_if("expandable").alias("expandable"), F.round(F.sum("weighted"), 6).alias("weight"), F.sum(F.length("text")).alias("length")),
    "d5_sample_report": lambda s, d: sample_report(_page_profile(s, d)),
    "d4_field_summary": lambda s, d: summary(_page_profile(s, d)),
    "b10_completeness": lambda s, d: issues(summary(_page_profile(s, d)), table(s, d, "pages").withColumn("name", F.when(F.col("url").contains("https"), F.col("url"))), "page_id"),
}
ORACLES = {
    "a2_catalog_pull": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 50",
    "a3_upsert": "WITH o AS (SELECT o_custkey AS id, o_orderkey AS version, o_totalprice AS value, o_orderstatus AS status FROM orders), t AS (SELECT id, max(version) AS version, max_by(value, version) AS value FROM o WHERE status = 'F' GROUP BY 1), c AS (SELECT id, max(version) AS version, max_by(value, version) AS value FROM o WHERE status <> 'F' GROUP BY 1) SELECT * FROM t WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT * FROM c",
    "a5_ingest_summary": f"SELECT count(*) AS processed, count(*) FILTER (e = '') AS accepted, count(*) FILTER (e <> '') AS rejected FROM (SELECT {_ERRORS} AS e FROM part)",
    "a7_json_output": "SELECT CASE WHEN p_size > 25 THEN '{\"p_partkey\":' || p_partkey || ',\"p_brand\":\"' || p_brand || '\"}' ELSE '{\"p_partkey\":' || p_partkey || '}' END AS json FROM part",
    "a7_output_options": "SELECT '{\"p_partkey\":' || p_partkey || ',\"p_brand\":' || CASE WHEN p_size > 25 THEN '\"' || p_brand || '\"' ELSE 'null' END || ',\"_metadata\":\"m\"}' AS json FROM part",
    "a8_verify": "SELECT 'order' AS _media_type, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS enriched, 'Id,Tag,Score' AS fields FROM orders UNION ALL SELECT 'part', count(*), count(*) FILTER (p_size > 25), 'Id,Score' FROM part",
    "a4_batch_ingest": f"SELECT p_partkey, CASE WHEN e = '' THEN '2.0' END AS version, CASE WHEN e = '' THEN {key_sql('p_name')} END AS key, e AS errors FROM (SELECT *, {_ERRORS} AS e FROM part)",
    "a6_routed_output": "SELECT 'order' AS _media_type, count(*) AS n, min(o_orderkey) AS first FROM orders UNION ALL SELECT 'part', count(*), min(p_partkey) FROM part",
    "a9_new_fields": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'key' ELSE 'kind,key' END AS new_fields FROM part",
    "b1_typed_constraints": "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'p_size:type' END, CASE WHEN p_size <= 40 AND p_size < 5 THEN 'p_size:min' END, CASE WHEN p_retailprice > 1800 THEN 'p_retailprice:max' END, 'p_brand:type', CASE WHEN len(string_split(p_name, ' ')) > 1 THEN 'words:max_items' END, CASE WHEN len(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('small', 'red', 'ring', 'widget'))) > 0 THEN 'words:allowed' END, 'p_name:type'], lambda x: x IS NOT NULL), ',') AS errors FROM part",
    "b2_validation": f"SELECT p_partkey, {_ERRORS} AS errors FROM part",
    "b3_computed_fields": _FIRST,
    "b5_source_fields": "SELECT s_suppkey, s_name AS name, '[Synthetic Director - would be enriched by plugins]' AS director, NULL::VARCHAR AS x FROM supplier",
    "b6_prompts": "SELECT p_partkey, 'Describe ' || p_name || ' by ' || p_brand || ' (size ' || p_size || ').' AS prompt FROM part",
    "b7_preview": "SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview FROM documents",
    "b8_universal_keys": "SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE 'Unknown' END AS name FROM customer",
    "b9_required_fields": "SELECT event_id, array_to_string(list_filter(['k', 'concept'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing FROM events",
    "b11_merge_enrichment": "SELECT n_nationkey, n_regionkey + 1 AS n_regionkey, 'old' AS keywords, lower(n_name) AS graph_keywords, lower(n_name) AS nested, upper(n_name) AS mood, 'graph,llm' AS processing, '1.0/2.1' AS versions FROM nation",
    "d2_field_profile": _PROFILE,
    "d3_text_views": f"SELECT lower(field) AS field, count(*) AS n, count(*) FILTER (expandable) AS expandable, round(sum(weight), 6) AS weight, sum(length(trim(value)))::BIGINT AS length FROM ({_PROFILE}) WHERE field_type = 'TEXT_CONTENT' GROUP BY 1",
    "d5_sample_report": f"SELECT entity, sum(length(trim(value)))::BIGINT AS length, round(sum(weight), 6) AS weight, coalesce(string_agg(DISTINCT lower(field), ',' ORDER BY lower(field)) FILTER (expandable), '') AS expandable FROM ({_PROFILE}) WHERE field_type = 'TEXT_CONTENT' GROUP BY 1",
    "d4_field_summary": _SUMMARY,
    "b10_completeness": f"SELECT page_id AS entity, array_to_string(list_filter([CASE WHEN NOT contains(url, 'https') THEN 'missing_name' END, CASE WHEN coalesce(text_content, 0) = 0 THEN 'no_text_fields' END, CASE WHEN coalesce(expandable, 0) = 0 THEN 'no_expandable_fields' END, CASE WHEN unknown > 3 THEN 'many_unknown_fields' END], lambda x: x IS NOT NULL), ',') AS issues FROM pages LEFT JOIN ({_SUMMARY}) ON page_id = entity",
}
