"""Concept expansion as joins: graph edges, vector neighbours, fusion and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .text_jobs import CLEAN_SQL, c6 as derived_edges, concepts_sql, top_per_group
from .vectors import apply_operations, neighbours, term_neighbours

#: Weight of a provider when results are fused.
FUSION = {"llm": 1.0, "graph": 0.8, "vector": 0.7, "temporal": 0.9}
#: Different keywords whose results are sent at most.
KEYWORDS = 1 << 15


def graph_expand(concepts: DataFrame, edges: DataFrame, k: int = 10, relations: tuple[str, ...] = ("RelatedTo",), least: float = 1.0, languages: tuple[str, ...] = ()) -> DataFrame:
    """concept, expanded, confidence, rank: neighbours on either side by weight, the concept itself left out.

    Each term counts once with its best edge; ties go by term.  Of a concept's
    edges, the 2 k heaviest count on either side, then by the other end.
    """
    own = lambda c: F.translate(F.lower(c), " -", "__")
    use = edges.where(F.col("rel").isin(*relations) & (F.col("weight") >= least))
    if languages and "language" in edges.columns:
        use = use.where(F.col("language").isin(*languages))
    ends = use.select(F.col("start_term").alias("node"), F.col("end_term").alias("term"), "weight").unionByName(use.select(F.col("end_term").alias("node"), F.col("start_term").alias("term"), "weight"))
    # The limit of edges is applied for each node before the join, so a node with very many edges brings few rows.
    ends = top_per_group(ends.groupBy("node", "term").agg(F.max("weight").alias("weight")), ["node"], [F.col("weight").desc(), "term"], 2 * k).drop("rank")
    found = concepts.select("concept").distinct().join(ends, F.lower("concept") == F.col("node")).select("concept", F.lower(F.trim("term")).alias("expanded"), F.least(F.col("weight") / 10, F.lit(1.0)).alias("confidence"))
    found = found.where((F.length("expanded") >= 2) & (own(F.col("expanded")) != own(F.col("concept")))).groupBy("concept", "expanded").agg(F.max("confidence").alias("confidence"))
    return top_per_group(found, ["concept"], [F.col("confidence").desc(), "expanded"], k)


def graph_expand_with_fallback(concepts: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Concepts of several words without a result are tried again by their first word."""
    direct = graph_expand(concepts, edges, k)
    again = concepts.select("concept").distinct().where(F.col("concept").contains(" ")).join(direct.select("concept").distinct(), "concept", "left_anti").withColumn("first", F.substring_index("concept", " ", 1))
    second = graph_expand(again.select(F.col("first").alias("concept")), edges, k).withColumnRenamed("concept", "first")
    return direct.unionByName(again.join(second, "first").select(*direct.columns))


def unit(v) -> F.Column:
    """A vector of doubles of length one, null where it has none."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm))


def dot(a, b) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of given pairs (a, b)."""
    v = vectors.select("vec_id", unit(F.col("embedding")).alias("u"))
    both = pairs.join(v.select(F.col("vec_id").alias("a"), F.col("u").alias("ua")), "a").join(v.select(F.col("vec_id").alias("b"), F.col("u").alias("ub")), "b")
    return both.select("a", "b", F.round(dot(F.col("ua"), F.col("ub")), 6).alias("similarity"))


def query_keywords(text: F.Column, most: int = 5) -> F.Column:
    return F.array_join(T.key_concepts(text, most), ", ")


def nearest(similar: DataFrame) -> DataFrame:
    """query, term, similarity: the single most similar term of each query."""
    best = similar.groupBy("query").agg(F.max(F.struct("similarity", (-F.col("term")).alias("t"))).alias("x"))
    return best.select("query", (-F.col("x.t")).alias("term"), F.col("x.similarity").alias("similarity"))


def _answered(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Requests with the results of their keyword.

    Few results a keyword are sent to the requests where these have at most
    KEYWORDS different ones; beyond that both are shuffled.  Requests are never
    sent: a common keyword would bring all of its requests to one task.
    """
    few = requests.select(key).distinct().limit(KEYWORDS + 1).count() <= KEYWORDS
    return requests.join(F.broadcast(results) if few else results.hint("merge"), key)


def multi_keyword(requests: DataFrame, results: DataFrame, most: int = 10) -> DataFrame:
    """request, rank, concept: the concepts of a request's keywords (request, pos, keyword) one keyword after another, each once, the first `most`.

    results holds (concept, rank, expanded) of single keywords.
    """
    each = _answered(requests, results.select(F.col("concept").alias("keyword"), F.col("rank").alias("nth"), F.lower(F.trim("expanded")).alias("clean")), "keyword").where("clean <> ''")
    once = each.groupBy("request", "clean").agg(F.min(F.struct("pos", "nth")).alias("at"))
    return top_per_group(once, ["request"], ["at"], most).select("request", "rank", F.col("clean").alias("concept"))


def per_tag(tags: DataFrame, results: DataFrame, max_per_tag: int = 3, least: float = 0.0, most: int = 30) -> DataFrame:
    """rec, rank, concept: of each tag of a record (rec, pos, tag) the first max_per_tag expansions that are sure enough, together each once, the first `most`."""
    sure = results.where(F.col("confidence") >= least)
    near = top_per_group(sure.select(F.col("concept").alias("tag"), "expanded", "rank").withColumnRenamed("rank", "nth"), ["tag"], ["nth"], max_per_tag)
    each = _answered(tags, near.drop("rank"), "tag")
    once = each.groupBy("rec", F.col("expanded").alias("concept")).agg(F.min(F.struct("pos", "nth")).alias("at"))
    return top_per_group(once, ["rec"], ["at", "concept"], most).select("rec", "rank", "concept")


def embellished(queries: DataFrame, text_col: str, *steps) -> DataFrame:
    """Query texts passed through a chain of functions of a DataFrame and a column's name; each gives the table with that column replaced."""
    for step in steps:
        queries = step(queries, text_col)
    return queries


def expanded_by(requests: DataFrame, providers: dict) -> DataFrame:
    """concept, term, provider, score of all requests by all providers.

    A provider is a pair (supports, expand): a Column of whether it takes a
    concept, and a function of the requests it takes that returns (concept,
    term, score).
    """
    out = None
    for name, (supports, expand) in providers.items():
        got = expand(requests.where(supports)).select("concept", "term", "score").withColumn("provider", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def method(concept: F.Column, genres: tuple[str, ...] = ("action", "comedy", "drama", "horror", "thriller")) -> F.Column:
    return F.when(concept.contains(" ") | concept.isin(*genres), "llm").otherwise("graph")


#: Genres with many related concepts.
RICH = ("action", "comedy", "drama", "horror", "thriller", "romance")


def most_concepts(concept: F.Column, kind: F.Column) -> F.Column:
    """Concepts worth asking for: of a model 10, 12 for several words, 15 for a genre; of a parser of entities 8; of graph and vectors 20, or 15 for several words."""
    several = concept.contains(" ")
    model = F.when(F.lower(concept).isin(*RICH), 15).when(several, 12).otherwise(10)
    return F.when(kind == "llm", model).when(kind == "entities", 8).otherwise(F.when(F.size(F.split(F.trim(concept), r"\s+")) == 1, 20).when(several, 15).otherwise(10))


def answer_confidence(position: F.Column, answer: F.Column, concept: F.Column, slow: F.Column | None = None) -> F.Column:
    """0.8 (less a tenth where slow), falling with position, raised with length and kinship; within 0.3 and 0.95."""
    base = F.lit(0.8) if slow is None else F.when(slow, 0.72).otherwise(0.8)
    kin = F.when(F.lower(answer).contains(F.lower(concept)) | F.lower(concept).contains(F.lower(answer)), 1.1).otherwise(1.0)
    length = F.least(F.greatest(F.length(answer) / 20, F.lit(0.8)), F.lit(1.2))
    return F.round(F.least(F.greatest(base * F.greatest(1 - position * 0.05, F.lit(0.5)) * length * kin, F.lit(0.3)), F.lit(0.95)), 3)


def fuse(results: DataFrame, most: int = 15) -> DataFrame:
    """concept, term, score, rank: each term's best score times its provider's weight."""
    weight = F.coalesce(*(F.when(F.col("provider") == k, v) for k, v in FUSION.items()), F.lit(0.5))
    scored = results.groupBy("concept", "term").agg(F.round(F.max(F.coalesce("score", F.lit(0.5)) * weight), 6).alias("score"))
    return top_per_group(scored, ["concept"], [F.col("score").desc(), "term"], most)


def hybrid(parsed: DataFrame, generated: DataFrame, k: int) -> DataFrame:
    """Half of k terms of a parser (concept, pos, term, score) first, then generated ones until there are k, each once; a missing score is 0.7."""
    first = parsed.where(F.col("pos") < k // 2).withColumn("source_rank", F.lit(0))
    number = first.groupBy("concept").agg(F.count("*").alias("n"))
    rest = generated.join(number, "concept", "left").where(F.col("pos") < k // 2 + k - F.coalesce("n", F.lit(0))).drop("n").withColumn("source_rank", F.lit(1))
    return first_from(first.unionByName(rest), k)


def first_from(sources: DataFrame, k: int) -> DataFrame:
    """Concepts of the first sources first, each once, the first k; a missing score is 0.7."""
    once = sources.groupBy("concept", "term").agg(F.min(F.struct("source_rank", "pos", F.coalesce("score", F.lit(0.7)).alias("score"))).alias("x"))
    return top_per_group(once, ["concept"], ["x"], k).select("concept", "term", F.col("x.score").alias("score"), "rank")


def overall(results: DataFrame) -> DataFrame:
    """Mean confidence of each concept's items, and whether all are within 0 and 1."""
    return results.groupBy("concept").agg(F.round(F.avg("confidence"), 6).alias("overall"), F.min(F.col("confidence").between(0, 1)).alias("valid"))


def requests(categories: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every category (a small table) in every context, its first two terms each."""
    return categories.select("category", F.posexplode(F.slice("terms", 1, 2)).alias("pos", "term")).crossJoin(contexts)


def _concepts(s, d):
    p = table(s, d, "part")
    return p.select(F.explode(F.array("p_name", "p_type", F.concat(F.lower("p_type"), F.lit(" thing")))).alias("concept")).distinct()


def _graph(s, d):
    return graph_expand(_concepts(s, d), derived_edges(s, d))


def _long(df):
    return df.withColumn("rank", F.col("rank").cast("long")).withColumn("confidence", F.round("confidence", 6))


def _results(s, d):
    g = _graph(s, d).select("concept", F.col("expanded").alias("term"), F.lit("graph").alias("provider"), F.col("confidence").alias("score"))
    p = table(s, d, "part").select(F.lower("p_type").alias("concept"), F.lower("p_brand").alias("term"), F.lit("llm").alias("provider"), F.when(F.col("p_size") > 25, F.col("p_size") / 50).alias("score"))
    return g.unionByName(p)


_OWN = lambda c: f"translate(lower({c}), ' -', '__')"


def graph_sql(concepts: str, k: int = 10, rels: str = "('RelatedTo')") -> str:
    edges = f"SELECT start_term AS node, end_term AS term, weight FROM ({CLEAN_SQL}) WHERE rel IN {rels} AND weight >= 1 UNION ALL SELECT end_term, start_term, weight FROM ({CLEAN_SQL}) WHERE rel IN {rels} AND weight >= 1"
    ends = f"SELECT * FROM (SELECT node, term, max(weight) AS weight FROM ({edges}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, term) <= {2 * k}"
    found = f"SELECT concept, lower(trim(term)) AS expanded, max(least(weight / 10, 1.0)) AS confidence FROM (SELECT DISTINCT concept FROM ({concepts})) JOIN ({ends}) ON lower(concept) = node WHERE length(lower(trim(term))) >= 2 AND {_OWN('term')} <> {_OWN('concept')} GROUP BY 1, 2"
    return f"SELECT concept, expanded, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY concept ORDER BY confidence DESC, expanded) AS rank FROM ({found}) QUALIFY rank <= {k}"


_CONCEPTS = "SELECT DISTINCT unnest([p_name, p_type, lower(p_type) || ' thing']) AS concept FROM part"
_GRAPH = graph_sql(_CONCEPTS)
_AGAIN = f"SELECT concept, split_part(concept, ' ', 1) AS first FROM ({_CONCEPTS}) WHERE contains(concept, ' ') AND concept NOT IN (SELECT concept FROM ({_GRAPH}))"
_COS = "round(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(a.embedding, lambda x: x::DOUBLE))) / sqrt(list_dot_product(list_transform(b.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))), 6)"
_VECTORS = f"SELECT a.vec_id AS query, b.vec_id AS term, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id"
_REQUESTS = "SELECT p_partkey AS request, unnest([0, 1]) AS pos, unnest([lower(p_name), lower(p_type)]) AS keyword FROM part"
_RESULTS = f"SELECT concept, expanded AS term, 'graph' AS provider, confidence AS score FROM ({_GRAPH}) UNION ALL SELECT lower(p_type), lower(p_brand), 'llm', CASE WHEN p_size > 25 THEN p_size / 50 END FROM part"

def _terms(s, d):
    """Terms of vectors: names of parts, with brands and joined words among them."""
    p = table(s, d, "part")
    name = F.when(F.col("p_size") < 8, F.col("p_brand")).when(F.col("p_size") < 16, F.translate("p_name", " ", "_")).when(F.col("p_size") < 20, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.concat("p_name", F.lit(" "), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij")))
    return p.select(F.col("p_partkey").alias("vec_id"), name.alias("term"))


def _pairs(s, d):
    return _vec(s, d).select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))


def _requests(s, d):
    """Each part's name and type as the keywords of a request."""
    return table(s, d, "part").select(F.col("p_partkey").alias("request"), F.posexplode(F.array(F.lower("p_name"), F.lower("p_type"))).alias("pos", "keyword"))


def _hybrid(s, d):
    g = _graph(s, d).select("concept", (F.col("rank") - 1).alias("pos"), F.col("expanded").alias("term"), F.when(F.col("rank") % 2 == 0, F.col("confidence")).alias("score"))
    p = table(s, d, "part").select(F.col("p_type").alias("concept"), F.lower("p_brand").alias("term")).distinct()
    parsed = top_per_group(p, ["concept"], ["term"], 8).select("concept", (F.col("rank") - 1).alias("pos"), "term", F.lit(None).cast("double").alias("score"))
    return hybrid(parsed, g, 10)


def _operations(s, d):
    """Changes of vectors: the events of a vector's number, of which errors delete it and others replace it."""
    e = table(s, d, "events").select((F.col("event_id") % 300 * 3).alias("vec_id"), F.col("event_id").alias("version"), F.array(F.col("value").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit(-1).alias("label"), "event_type")
    v = _vec(s, d).withColumn("version", F.lit(-1).cast("long")).withColumn("event_type", F.lit(""))
    return apply_operations(v, e, F.when(F.col("event_type") == "error", "delete").otherwise("add"))


def _providers(s, d):
    concepts = _concepts(s, d)
    graph = lambda r: graph_expand(r, derived_edges(s, d), 5).select("concept", F.col("expanded").alias("term"), F.col("confidence").alias("score"))
    plain = lambda r: r.select("concept", F.lower("concept").alias("term"), F.lit(0.5).alias("score"))
    return expanded_by(concepts, {"graph": (~F.col("concept").contains("thing"), graph), "vector": (F.col("concept").contains(" "), plain)})


_vec = lambda s, d: table(s, d, "embeddings")
_q = lambda s, d: _vec(s, d).where("vec_id % 20 = 0")
QUERIES = {
    "g1_graph_expansion": lambda s, d: _long(_graph(s, d)),
    "g1a_graph_fallback": lambda s, d: _long(graph_expand_with_fallback(_concepts(s, d), derived_edges(s, d))),
    "g2_vector_neighbours": lambda s, d: neighbours(_q(s, d), _vec(s, d)).select("query", "term", "similarity"),
    "g3_similarity_threshold": lambda s, d: neighbours(_q(s, d), _vec(s, d), 5, least=0.3).select("query", "term", "similarity"),
    "g1b_relations": lambda s, d: _long(graph_expand(_concepts(s, d), derived_edges(s, d), relations=("IsA", "PartOf"))),
    "g2_term_neighbours": lambda s, d: term_neighbours(_q(s, d), _vec(s, d), _terms(s, d), 5).withColumn("rank", F.col("rank").cast("long")),
    "g4_pair_similarity": lambda s, d: pair_similarity(_pairs(s, d), _vec(s, d)),
    "g4_nearest_terms": lambda s, d: nearest(neighbours(_q(s, d), _vec(s, d), 3)),
    "g6_multi_keyword": lambda s, d: multi_keyword(_requests(s, d), graph_expand(_requests(s, d).select(F.col("keyword").alias("concept")), derived_edges(s, d))).withColumn("rank", F.col("rank").cast("long")),
    "g9_parameters": lambda s, d: _concepts(s, d).unionByName(s.createDataFrame([(g,) for g in RICH], "concept string")).select("concept", F.explode(F.array(*map(F.lit, ("llm", "entities", "graph", "vector")))).alias("kind")).select("concept", "kind", most_concepts(F.col("concept"), F.col("kind")).cast("long").alias("most")),
    "g13_hybrid": lambda s, d: _hybrid(s, d).withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 6)),
    "h10_per_tag": lambda s, d: per_tag(_requests(s, d).select(F.col("request").alias("rec"), "pos", F.col("keyword").alias("tag")), graph_expand(_requests(s, d).select(F.col("keyword").alias("concept")), derived_edges(s, d)), 3, 0.5).withColumn("rank", F.col("rank").cast("long")),
    "m5_providers": lambda s, d: _providers(s, d).withColumn("score", F.round("score", 6)),
    "m7_vector_operations": lambda s, d: _operations(s, d).select("vec_id", "version", F.size("embedding").cast("long").alias("width"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first")),
    "g5_batch_success": lambda s, d: _concepts(s, d).join(_graph(s, d).select("concept").distinct().withColumn("ok", F.lit(True)), "concept", "left").agg(F.count("*").alias("requested"), F.count_if("ok").alias("succeeded")),
    "g7_query_keywords": lambda s, d: table(s, d, "documents").select("doc_id", query_keywords(F.col("text")).alias("keywords")),
    "g8_method": lambda s, d: _concepts(s, d).select("concept", method(F.col("concept")).alias("method"), most_concepts(F.col("concept"), method(F.col("concept"))).cast("long").alias("most")),
    "g10_answer_confidence": lambda s, d: _graph(s, d).select("concept", "expanded", answer_confidence(F.col("rank") - 1, F.col("expanded"), F.col("concept")).alias("score")),
    "g14_fusion": lambda s, d: fuse(_results(s, d)).withColumn("rank", F.col("rank").cast("long")),
    "g15_overall": lambda s, d: overall(_graph(s, d)),
    "g16_requests": lambda s, d: requests(table(s, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.array_sort(F.collect_set("p_brand")).alias("terms")), table(s, d, "region").select(F.col("r_name").alias("context"))).select("category", F.col("pos").cast("long").alias("pos"), "term", "context"),
}
ORACLES = {
    "g1_graph_expansion": _GRAPH,
    "g1a_graph_fallback": f"{_GRAPH} UNION ALL SELECT a.concept, expanded, confidence, rank FROM ({_AGAIN}) a JOIN ({graph_sql(f'SELECT first AS concept FROM ({_AGAIN})')}) b ON a.first = b.concept",
    "g2_vector_neighbours": f"SELECT * FROM ({_VECTORS}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, term) <= 10",
    "g3_similarity_threshold": f"SELECT * FROM ({_VECTORS}) WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, term) <= 5",
    "g1b_relations": graph_sql(_CONCEPTS, 10, "('IsA', 'PartOf')"),
    "g2_term_neighbours": f"WITH t AS (SELECT p_partkey AS id, lower(trim(CASE WHEN p_size < 8 THEN p_brand WHEN p_size < 16 THEN replace(p_name, ' ', '_') WHEN p_size < 20 THEN ' ' || upper(p_name) ELSE p_name || ' ' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') END)) AS clean FROM part), n AS (SELECT query, clean, similarity, r, q FROM (SELECT v.*, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, term) AS r FROM ({_VECTORS}) v QUALIFY r <= 10) JOIN t ON term = t.id LEFT JOIN (SELECT id AS q, clean AS own FROM t) ON query = q WHERE (own IS NULL OR clean <> own) AND NOT regexp_matches(clean, '[_0-9]') AND length(clean) >= 2) SELECT query, clean AS term, arg_min(similarity, r) AS similarity, row_number() OVER (PARTITION BY query ORDER BY min(r)) AS rank FROM n GROUP BY query, clean QUALIFY rank <= 5",
    "g4_nearest_terms": f"SELECT * FROM ({_VECTORS}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, term) = 1",
    "g6_multi_keyword": f"SELECT request, concept, row_number() OVER (PARTITION BY request ORDER BY min({{'p': pos, 'n': nth}})) AS rank FROM (SELECT request, pos, rank AS nth, expanded AS concept FROM ({_REQUESTS}) JOIN ({graph_sql('SELECT keyword AS concept FROM (' + _REQUESTS + ')')}) ON keyword = concept) GROUP BY request, concept QUALIFY rank <= 10",
    "g9_parameters": f"SELECT concept, kind, CASE kind WHEN 'llm' THEN CASE WHEN lower(concept) IN {RICH} THEN 15 WHEN contains(concept, ' ') THEN 12 ELSE 10 END WHEN 'entities' THEN 8 ELSE CASE WHEN len(string_split(concept, ' ')) = 1 THEN 20 ELSE 15 END END::BIGINT AS most FROM (SELECT concept FROM ({_CONCEPTS}) UNION ALL SELECT unnest({list(RICH)})), (SELECT unnest(['llm', 'entities', 'graph', 'vector']) AS kind)",
    "g13_hybrid": f"WITH p AS (SELECT * FROM (SELECT concept, term, row_number() OVER (PARTITION BY concept ORDER BY term) - 1 AS pos FROM (SELECT DISTINCT p_type AS concept, lower(p_brand) AS term FROM part)) WHERE pos < 5), n AS (SELECT concept, count(*) AS n FROM p GROUP BY 1), g AS (SELECT concept, rank - 1 AS pos, expanded AS term, CASE WHEN rank % 2 = 0 THEN confidence END AS score FROM ({_GRAPH})), u AS (SELECT concept, term, 0 AS s, pos, 0.7::DOUBLE AS score FROM p UNION ALL SELECT concept, term, 1, pos, coalesce(score, 0.7)::DOUBLE FROM g LEFT JOIN n USING (concept) WHERE pos < 15 - coalesce(n, 0)) SELECT concept, term, round((min({{'s': s, 'p': pos, 'score': score}})).score, 6) AS score, row_number() OVER (PARTITION BY concept ORDER BY min({{'s': s, 'p': pos, 'score': score}})) AS rank FROM u GROUP BY 1, 2 QUALIFY rank <= 10",
    "h10_per_tag": f"WITH e AS (SELECT concept AS tag, expanded, rank AS nth FROM ({graph_sql('SELECT keyword AS concept FROM (' + _REQUESTS + ')')}) WHERE confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY concept ORDER BY rank) <= 3) SELECT request AS rec, expanded AS concept, row_number() OVER (PARTITION BY request ORDER BY min({{'p': pos, 'n': nth}}), expanded) AS rank FROM ({_REQUESTS}) JOIN e ON keyword = tag GROUP BY 1, 2 QUALIFY rank <= 30",
    "m5_providers": f"SELECT concept, expanded AS term, confidence AS score, 'graph' AS provider FROM ({graph_sql(chr(40) + 'SELECT * FROM (' + _CONCEPTS + ') WHERE NOT contains(concept, ' + chr(39) + 'thing' + chr(39) + '))', 5)}) UNION ALL SELECT concept, lower(concept), 0.5, 'vector' FROM ({_CONCEPTS}) WHERE contains(concept, ' ')",
    "m7_vector_operations": "WITH c AS (SELECT event_id % 300 * 3 AS vec_id, event_id AS version, value, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 300 ORDER BY event_id DESC) = 1) SELECT vec_id, -1::BIGINT AS version, len(embedding) AS width, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM c) UNION ALL SELECT vec_id, version, 2, round(value::FLOAT::DOUBLE, 4) FROM c WHERE event_type <> 'error'",
    "g4_pair_similarity": f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "g5_batch_success": f"SELECT count(*) AS requested, count(*) FILTER (concept IN (SELECT concept FROM ({_GRAPH}))) AS succeeded FROM ({_CONCEPTS})",
    "g7_query_keywords": f"SELECT doc_id, coalesce(k, '') AS keywords FROM documents LEFT JOIN (SELECT doc_id, string_agg(keyword, ', ' ORDER BY pos) AS k FROM ({concepts_sql('doc_id', 'text', most=5)}) GROUP BY 1) USING (doc_id)",
    "g8_method": f"SELECT concept, m AS method, CASE WHEN m = 'llm' THEN CASE WHEN n = 1 THEN 10 ELSE 12 END ELSE CASE WHEN n = 1 THEN 20 ELSE 15 END END::BIGINT AS most FROM (SELECT concept, len(string_split(concept, ' ')) AS n, CASE WHEN contains(concept, ' ') OR concept IN ('action','comedy','drama','horror','thriller') THEN 'llm' ELSE 'graph' END AS m FROM ({_CONCEPTS}))",
    "g10_answer_confidence": f"SELECT concept, expanded, round(least(greatest(0.8::DOUBLE * greatest(1 - (rank - 1) * 0.05::DOUBLE, 0.5::DOUBLE) * least(greatest(length(expanded) / 20, 0.8::DOUBLE), 1.2::DOUBLE) * CASE WHEN contains(lower(expanded), lower(concept)) OR contains(lower(concept), lower(expanded)) THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 0.3::DOUBLE), 0.95::DOUBLE), 3) AS score FROM ({_GRAPH})",
    "g14_fusion": f"SELECT concept, term, score, row_number() OVER (PARTITION BY concept ORDER BY score DESC, term) AS rank FROM (SELECT concept, term, round(max(coalesce(score, 0.5) * CASE provider WHEN 'llm' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END), 6) AS score FROM ({_RESULTS}) GROUP BY 1, 2) QUALIFY rank <= 15",
    "g15_overall": f"SELECT concept, round(avg(confidence), 6) AS overall, min(confidence BETWEEN 0 AND 1) AS valid FROM ({_GRAPH}) GROUP BY 1",
    "g16_requests": "SELECT category, pos, term, r_name AS context FROM (SELECT category, unnest(range(0, least(2, len(l)))) AS pos, unnest(l[1:2]) AS term FROM (SELECT p_type AS category, list_sort(list(DISTINCT p_brand)) AS l FROM part GROUP BY 1)), region",
}
