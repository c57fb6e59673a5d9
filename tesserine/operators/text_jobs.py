"""Table-scale text jobs: key standardisation, keyword tables, audits, answer and edge parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.tables import table

QUOTED = [w.replace("'", "''") for w in T.STOPWORDS]
STOP_SQL = "(" + ",".join(f"'{w}'" for w in QUOTED) + ")"


def ascii_sql(c: str) -> str:
    return f"regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')"


def analysis_sql(c: str) -> str:
    return f"trim(regexp_replace({ascii_sql(c)}, '\\s+', ' ', 'g'))"


def key_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({ascii_sql(c)}), '[^a-z0-9\\s\\-_]', '', 'g'), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


def concepts_sql(keys: str, text: str, source: str = "documents", most: int | None = 10) -> str:
    """Query for (keys, keyword, pos): key words in order of first appearance, the first `most` or all. keys must tell documents apart."""
    words = f"list_filter(string_split_regex(lower({analysis_sql(text)}), '[,.!?;:\\s\\-()]+'), lambda w: length(w) >= 3 AND w NOT IN {STOP_SQL} AND NOT regexp_matches(w, '^[0-9]+$'))"
    each = f"SELECT {keys}, unnest(w) AS keyword, unnest(range(0, len(w))) AS i FROM (SELECT *, {words} AS w FROM {source})"
    cut = f" QUALIFY pos < {most}" if most else ""
    return f"SELECT {keys}, keyword, row_number() OVER (PARTITION BY {keys} ORDER BY min(i)) - 1 AS pos FROM ({each}) GROUP BY {keys}, keyword{cut}"


def standard_keys(names: DataFrame, column: str) -> DataFrame:
    """For each standard key, the number of raw spellings and the chosen one."""
    return names.select(T.key_part(F.col(column)).alias("key"), F.col(column).alias("raw")).groupBy("key").agg(F.countDistinct("raw").alias("spellings"), F.min("raw").alias("chosen"), F.count("*").alias("n"))


def keyword_table(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(document, pos, keyword) of all key words of whole texts."""
    return docs.select(id_col, *keep, F.posexplode(T.key_words(F.col(text_col))).alias("pos", "keyword"))


def document_frequency(docs: DataFrame, text_col: str, *by: str) -> DataFrame:
    """Documents of a group that hold a keyword anywhere; the words of a document are told apart in its own row, so only sums are shuffled."""
    return docs.select(*by, F.explode(T.key_words(F.col(text_col))).alias("keyword")).groupBy(*by, "keyword").agg(F.count("*").alias("n_docs"))


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def c1(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.explode(F.array("p_name", "p_type", "p_brand", F.upper("p_name"), F.translate("p_name", " ", "-"))).alias("v"))
    return standard_keys(names, "v")


def c2(spark, sf):
    counts = document_frequency(table(spark, sf, "documents"), "text", "source")
    return top_per_group(counts, ["source"], [F.col("n_docs").desc(), "keyword"], 20).select("source", "keyword", "n_docs", F.col("rank").cast("long").alias("rank"))


def c2_lang(spark, sf):
    return document_frequency(table(spark, sf, "documents"), "text", "lang")


def c3(spark, sf):
    odd = F.when(T.is_ascii(F.col("text")), 0).otherwise(1)
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(odd).cast("long").alias("n_odd"), F.round(F.avg(odd), 6).alias("share"))


def c4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.analysis_text(F.col("text"))).alias("normal"), T.is_ascii(F.col("text")).alias("was_ascii"))


def c5(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.listed_concepts(F.col("text"))).alias("pos", "concept")).withColumn("pos", F.col("pos").cast("long"))


def _answers(spark, sf) -> DataFrame:
    """Texts of conversations as answers; every other one of an assistant quotes its sentences."""
    text = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0), F.concat(F.lit('Concepts: "'), F.replace("text", F.lit(". "), F.lit('", "')), F.lit('"'))).otherwise(F.concat(F.lit("- * "), F.replace("text", F.lit(". "), F.lit("\n 2. s/"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))


def c5_temporal(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", F.posexplode(T.temporal_answer(F.col("text"))).alias("pos", "concept")).withColumn("pos", F.col("pos").cast("long"))


def c5_light(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", F.posexplode(T.light_answer(F.col("text"))).alias("pos", "concept")).withColumn("pos", F.col("pos").cast("long"))


def edges(spark, sf) -> DataFrame:
    """Edges part name -> part type, brand -> supplier nation and so on, weighted by how often both occur in a line."""
    uri = lambda c: F.concat(F.lit("/c/en/"), F.translate(F.lower(c), " ", "_"))
    lines = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    joined = lines.join(table(spark, sf, "part"), lines.l_partkey == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pairs = F.explode(F.array(F.struct(uri(F.col("p_name")).alias("s"), F.lit("RelatedTo").alias("r"), uri(F.col("p_type")).alias("e")), F.struct(uri(F.col("p_type")).alias("s"), F.lit("IsA").alias("r"), uri(F.col("p_brand")).alias("e")), F.struct(uri(F.col("n_name")).alias("s"), F.lit("RelatedTo").alias("r"), uri(F.col("p_name")).alias("e"))))
    return joined.select(pairs.alias("x"), "q").groupBy("x.s", "x.r", "x.e").agg(F.sum("q").alias("q")).select(F.col("s").alias("start_uri"), F.col("r").alias("rel"), F.col("e").alias("end_uri"), F.round(F.col("q") / 100, 4).alias("weight"))


def clean_edges(raw: DataFrame) -> DataFrame:
    """English edges of positive weight as terms."""
    return raw.select(T.uri_term(F.col("start_uri")).alias("start_term"), "rel", T.uri_term(F.col("end_uri")).alias("end_term"), "weight").where("start_term is not null and end_term is not null and weight > 0")


def c6(spark, sf):
    return clean_edges(edges(spark, sf))


def _uri(c: str) -> str:
    return f"'/c/en/' || replace(lower({c}), ' ', '_')"


EDGES_SQL = f"""
SELECT s AS start_uri, r AS rel, e AS end_uri, round(sum(q) / 100, 4) AS weight FROM (
  SELECT unnest([{{'s': {_uri('p_name')}, 'r': 'RelatedTo', 'e': {_uri('p_type')}}}, {{'s': {_uri('p_type')}, 'r': 'IsA', 'e': {_uri('p_brand')}}}, {{'s': {_uri('n_name')}, 'r': 'RelatedTo', 'e': {_uri('p_name')}}}], recursive := true), q
  FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
) GROUP BY 1, 2, 3"""
CLEAN_SQL = f"SELECT replace(start_uri[7:], '_', ' ') AS start_term, rel, replace(end_uri[7:], '_', ' ') AS end_term, weight FROM ({EDGES_SQL}) WHERE weight > 0"

_LISTED = """list_filter(list_transform(CASE WHEN contains(b, ',') THEN string_split(b, ',') ELSE string_split(b, chr(10)) END,
 lambda p: lower(trim(regexp_replace(regexp_replace(regexp_replace(p, '^\\s*(?:[0-9]+[.)]|[-*])\\s*', ''), '["'']', '', 'g'), '\\s+', ' ', 'g')))), lambda p: length(p) > 1)[1:10]"""

_ANSWERS = "(SELECT conv_id, turn, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 'Concepts: \"' || replace(text, '. ', '\", \"') || '\"' ELSE '- * ' || replace(text, '. ', chr(10) || ' 2. s/') END AS text FROM conversations)"
_HEADS = "trim(text)"
for _h in T.ANSWER_HEADS:
    _HEADS = f"trim(regexp_replace({_HEADS}, '^{_h}', '', 'i'))"
_CLEAN = "p"
for _p, _to, _o in (("^\\s+|\\s+$", "", "g"), ('^["\'\']+|["\'\']+$', "", "g"), ("^[a-zA-Z]/", "", ""), ("^[0-9]+\\.?\\s*", "", ""), ("^[-•*]\\s*", "", ""), ("\\s+", " ", "g")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_to}', '{_o}')"
_TEMPORAL = f"list_filter(list_transform(CASE WHEN contains(b, ',') THEN CASE WHEN len(q) > 0 THEN q ELSE string_split(b, ',') END ELSE string_split(b, chr(10)) END, lambda p: trim(lower({_CLEAN}))), lambda p: length(p) > 1)[1:10]"
_AROUND = "p"
for _p in ("\\s", "-", "\\*", "\\s"):
    _AROUND = f"regexp_replace({_AROUND}, '^{_p}+|{_p}+$', '', 'g')"
_LIGHT = f"list_filter(list_transform(string_split(text, chr(10)), lambda p: {_AROUND}), lambda p: length(p) > 1)[1:10]"


def _listed(rows: str) -> str:
    return f"SELECT conv_id, turn, i - 1 AS pos, l[i] AS concept FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ({rows}))"


QUERIES = {"c1_standard_keys": c1, "c2_keyword_ranking": c2, "c2_keywords_by_language": c2_lang, "c3_charset_audit": c3, "c4_normalised_table": c4, "c5_answer_parsing": c5, "c5_temporal_answers": c5_temporal, "c5_light_answers": c5_light, "c6_edge_ingestion": c6}
ORACLES = {
    "c1_standard_keys": f"SELECT {key_sql('v')} AS key, count(DISTINCT v) AS spellings, min(v) AS chosen, count(*) AS n FROM (SELECT unnest([p_name, p_type, p_brand, upper(p_name), replace(p_name, ' ', '-')]) AS v FROM part) GROUP BY 1",
    "c2_keyword_ranking": f"SELECT source, keyword, n_docs, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_docs DESC, keyword) AS rank FROM (SELECT source, keyword, count(*) AS n_docs FROM ({concepts_sql('doc_id, source', 'text', most=None)}) GROUP BY 1, 2)) WHERE rank <= 20",
    "c2_keywords_by_language": f"SELECT lang, keyword, count(*) AS n_docs FROM ({concepts_sql('doc_id, lang', 'text', most=None)}) GROUP BY 1, 2",
    "c3_charset_audit": "SELECT lang, source, count(*) AS n, sum(o)::BIGINT AS n_odd, round(avg(o), 6) AS share FROM (SELECT *, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END AS o FROM documents) GROUP BY 1, 2",
    "c4_normalised_table": f"SELECT doc_id, md5({analysis_sql('text')}) AS normal, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS was_ascii FROM documents",
    "c5_answer_parsing": _listed(f"SELECT conv_id, turn, {_LISTED} AS l FROM (SELECT *, regexp_replace(trim(text), '^(?:concepts|keywords|answer|related terms):\\s*', '', 'i') AS b FROM conversations)"),
    "c5_temporal_answers": _listed(f"SELECT conv_id, turn, {_TEMPORAL} AS l FROM (SELECT *, regexp_extract_all(b, '\"([^\"]+)\"', 1) AS q FROM (SELECT *, {_HEADS} AS b FROM {_ANSWERS}))"),
    "c5_light_answers": _listed(f"SELECT conv_id, turn, {_LIGHT} AS l FROM {_ANSWERS}"),
    "c6_edge_ingestion": CLEAN_SQL,
}
