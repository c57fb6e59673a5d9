"""Field-weighted search and the rest of the expansion rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from .vectors import multi_word

#: Words kin to a word of time, and words of time.
SYNONYMS = {
    "recent": ("new", "current", "contemporary", "modern", "latest", "fresh"),
    "classic": ("old", "vintage", "retro", "traditional", "golden", "timeless"),
    "90s": ("nineties", "decade", "era", "period", "grunge", "alternative"),
    "vintage": ("old", "classic", "retro", "antique", "aged", "traditional"),
    "modern": ("new", "current", "contemporary", "recent", "latest", "today"),
}
TIME_WORDS = ("year", "decade", "era", "period", "time", "age", "season")


def relevance(generated: Column, term: Column) -> Column:
    """Of a generated concept for a term of time: 1.5 where either holds the other, 1.3 for a kin word, 1.2 for a word of time, else 1."""
    c, t = F.lower(generated), F.lower(term)
    holds = lambda x, words: reduce(lambda a, b: a | b, (x.contains(w) for w in words))
    kin = reduce(lambda a, b: a | b, (t.contains(k) & holds(c, words) for k, words in SYNONYMS.items()))
    return F.when(c.contains(t) | t.contains(c), 1.5).when(kin, 1.3).when(holds(c, TIME_WORDS), 1.2).otherwise(1.0)


def temporal_confidence(position: Column, generated: Column, term: Column) -> Column:
    """0.85, falling with position, by number of words and relevance; within 0.4 and 0.95."""
    words = F.size(F.split(generated, r"\s+"))
    score = F.lit(0.85) * F.greatest(1 - position * 0.05, F.lit(0.6)) * F.least(F.greatest(words / 3, F.lit(0.8)), F.lit(1.2)) * relevance(generated, term)
    return F.round(F.least(F.greatest(score, F.lit(0.4)), F.lit(0.95)), 6)


def known(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Concepts at least one of whose words the vocabulary holds."""
    return queries.join(vocabulary, "word", "left_semi").select("concept").distinct()


def _words(s, d):
    v = table(s, d, "embeddings").where("vec_id % 20 = 0").select("vec_id")
    return v.select(F.col("vec_id").alias("concept"), F.explode(F.array(F.col("vec_id"), F.col("vec_id") + 1, F.col("vec_id") + 100_000_000)).alias("word"))


def _terms(s, d):
    p = table(s, d, "part")
    term = F.when(F.col("p_type") == "ECONOMY", "Recent").when(F.col("p_type") == "PROMO", "the 90s").when(F.col("p_size") > 25, "classic films").when(F.col("p_size") > 10, "modern").otherwise("vintage")
    made = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("new "), F.col("p_name"))).when(F.col("p_size") % 5 == 1, "retro style").when(F.col("p_size") % 5 == 2, "Golden Era of film").when(F.col("p_size") % 5 == 3, F.concat("p_name", F.lit(" of the season"))).otherwise(F.lower("p_name"))
    return p.select("p_partkey", (F.col("p_partkey") % 12).alias("pos"), term.alias("term"), made.alias("generated"))


_ANY = lambda x, words: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"
_REL = "CASE WHEN contains(lower(generated), lower(term)) OR contains(lower(term), lower(generated)) THEN 1.5 WHEN " + " OR ".join(f"(contains(lower(term), '{k}') AND {_ANY('generated', w)})" for k, w in SYNONYMS.items()) + f" THEN 1.3 WHEN {_ANY('generated', TIME_WORDS)} THEN 1.2 ELSE 1.0 END::DOUBLE"
_TERMS = "(SELECT p_partkey, p_partkey % 12 AS pos, CASE WHEN p_type = 'ECONOMY' THEN 'Recent' WHEN p_type = 'PROMO' THEN 'the 90s' WHEN p_size > 25 THEN 'classic films' WHEN p_size > 10 THEN 'modern' ELSE 'vintage' END AS term, CASE p_size % 5 WHEN 0 THEN 'new ' || p_name WHEN 1 THEN 'retro style' WHEN 2 THEN 'Golden Era of film' WHEN 3 THEN p_name || ' of the season' ELSE lower(p_name) END AS generated FROM part)"
_UNIT = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS u FROM (SELECT *, sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) AS n FROM embeddings))"
_WORDS = "(SELECT vec_id AS concept, unnest([vec_id, vec_id + 1, vec_id + 100000000]) AS word FROM embeddings WHERE vec_id % 20 = 0)"


QUERIES = {
    "g2a_multi_word_neighbours": lambda s, d: multi_word(_words(s, d), table(s, d, "embeddings")).select("concept", "term", "similarity"),
    "g2b_vocabulary_coverage": lambda s, d: known(_words(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("word"))),
    "g11_temporal_confidence": lambda s, d: _terms(s, d).select("p_partkey", relevance(F.col("generated"), F.col("term")).alias("relevance"), temporal_confidence(F.col("pos"), F.col("generated"), F.col("term")).alias("confidence")),
}
ORACLES = {
    "g2a_multi_word_neighbours": f"SELECT concept, term, max(round(list_dot_product(a.u, b.u), 6)) AS similarity FROM (SELECT concept, word, u FROM {_WORDS} w JOIN {_UNIT} e ON w.word = e.vec_id) a, (SELECT vec_id AS term, u FROM {_UNIT}) b WHERE term <> word GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY concept ORDER BY similarity DESC, term) <= 5",
    "g2b_vocabulary_coverage": f"SELECT DISTINCT concept FROM {_WORDS} WHERE word IN (SELECT vec_id FROM embeddings)",
    "g11_temporal_confidence": f"SELECT p_partkey, r AS relevance, round(least(greatest(0.85::DOUBLE * greatest(1 - pos * 0.05::DOUBLE, 0.6::DOUBLE) * least(greatest(len(string_split(generated, ' ')) / 3, 0.8::DOUBLE), 1.2::DOUBLE) * r, 0.4::DOUBLE), 0.95::DOUBLE), 6) AS confidence FROM (SELECT *, {_REL} AS r FROM {_TERMS})",
}
