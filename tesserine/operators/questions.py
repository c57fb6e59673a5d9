"""Query-log analysis: questions, intents, parameters and expanded query texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch_path, table

#: Beginnings of questions (a prefix test), and rules of intent in order (a substring test).
STARTERS = ("what", "who", "where", "when", "why", "how", "can", "could", "would", "should", "is", "are", "suggest", "recommend", "find", "show", "tell", "give me", "list", "name")
INTENTS = (
    ("recommendation", ("suggest", "recommend", "give me", "list")),
    ("search", ("find", "search", "show", "with", "featuring")),
    ("information", ("tell me about", "what is", "who is", "explain")),
    ("comparison", ("compare", "versus", "vs", "difference")),
    ("factual", ("when", "year", "date", "how many", "how much")),
    ("analytical", ("why", "how come", "reason")),
)
#: Genres and modifiers of recommendations, words that searches leave out, words without meaning of their own.
GENRES = ("action", "comedy", "drama", "horror", "sci-fi", "science fiction", "romance", "thriller", "documentary", "animation", "fantasy")
MODIFIERS = ("recent", "classic", "popular", "underrated", "new", "old")
SEARCH_WORDS = ("find", "search", "show", "movies", "films", "with", "featuring", "about")
STOP = ("what", "who", "where", "when", "why", "how", "is", "are", "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "about")


def is_question(text: Column) -> Column:
    return text.contains("?") | F.lower(text).rlike("^(?:" + "|".join(STARTERS) + ")")


def intent(text: Column) -> Column:
    """The first rule any of whose words is part of the text; search where none is."""
    t = F.lower(text)
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (t.contains(w) for w in words)), F.lit(name)) for name, words in INTENTS), F.lit("search"))


def recommendation(text: Column) -> Column:
    """How many films are asked for, the first genre in the order of the list, all modifiers."""
    t = F.lower(text)
    n = F.regexp_extract(t, r"\b(\d+)\s+(?:movie|film)", 1)  # a fixed value
    held = lambda words: F.filter(F.array(*map(F.lit, words)), lambda g: t.contains(g))
    return F.struct(F.when(n != "", n.cast("int")).alias("count"), F.get(held(GENRES), F.lit(0)).alias("genre"), held(MODIFIERS).alias("modifiers"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 2)


def search_terms(text: Column) -> Column:
    t = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(" ")), SEARCH_WORDS, F.lower(text))
    return F.filter(_words(t), lambda w: ~w.isin("the", "and", "for"))


def information(text: Column) -> Column:
    """Subject and topic: of "about T in S", "what is T" or "S information"; null where there is none."""
    t = F.lower(text)
    get = lambda p, i: F.nullif(F.trim(F.regexp_extract(t, p, i)), F.lit(""))
    # The patterns of the three forms.
    both, plain, named = r"about\s+(.+?)\s+in\s+(.+)", r"what\s+is\s+(.+)", r"(.+?)\s+(?:information|details|info)"
    topic = F.nullif(F.regexp_replace(F.regexp_extract(t, plain, 1), r"^\?+|\?+$", ""), F.lit(""))
    subject = F.when(t.rlike(both), get(both, 2)).when(t.rlike(plain), None).otherwise(get(named, 1))
    return F.struct(subject.alias("subject"), F.when(t.rlike(both), get(both, 1)).when(t.rlike(plain), topic).when(t.rlike(named), "information").alias("topic"))


def keywords(text: Column) -> Column:
    return F.filter(_words(F.lower(text)), lambda w: ~w.isin(*STOP))


#: Expansions that a term brings by intent, with and without enough resources to expand all, and terms that are expanded.
EXPANSIONS = {"recommendation": (5, 3), "search": (2, 0), "information": (2, 2), "other": (1, 0)}
EXPANDED_TERMS = {"search": 5, "other": 3}


def expanded(queries: DataFrame, expansions: DataFrame, expand: bool = True) -> DataFrame:
    """Expanded texts of the questions among queries (query_id, text); others stay as they are.

    expansions holds (term, rank, expansion).  Recommendations become the
    expansions of their genre (the genre where it has none), "top N" and their
    modifiers; searches their first five terms with two expansions each, every
    word once; information questions subject, topic and two expansions of it;
    others three keywords with one expansion each.  With expand=False
    recommendations become their genre with three expansions (or stay as they
    are), searches all their terms, others three keywords.
    """
    most, way = max(n for n, _ in EXPANSIONS.values()), 0 if expand else 1
    about, asked = F.col("about"), F.col("asked")
    known = expansions.where(F.col("rank") <= most).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "expansion"))), lambda x: x["expansion"]).alias("more"))  # a row a term, of few expansions
    kind = F.when(F.col("intent").isin("recommendation", "search", "information"), F.col("intent")).otherwise("other")
    q = queries.withColumns({"question": is_question(F.col("text")), "intent": intent(F.col("text")), "asked": recommendation(F.col("text")), "about": information(F.col("text"))}).withColumn("kind", kind)
    one = lambda c: F.array_compact(F.array(c))
    found = search_terms(F.col("text"))
    terms = F.when(F.col("kind") == "recommendation", one(asked["genre"])).when(F.col("kind") == "search", F.slice(found, 1, EXPANDED_TERMS["search"]) if expand else found).when(F.col("kind") == "information", one(about["topic"])).otherwise(F.slice(keywords(F.col("text")), 1, EXPANDED_TERMS["other"]))
    # The features are derived once: as columns of one plan, every use of them would derive them again.
    path = scratch_path(queries.sparkSession, "question-features")
    q.withColumn("terms", terms).write.parquet(path)
    q = queries.sparkSession.read.parquet(path)
    # Only terms that are expanded travel, at most five of a question.
    each = q.where(F.col("question") & F.col("kind").isin(*(k for k, n in EXPANSIONS.items() if n[way]))).select("query_id", "kind", F.posexplode("terms").alias("pos", "term"))
    cut = reduce(lambda c, k: c.when(F.col("kind") == k, F.slice("more", 1, EXPANSIONS[k][way])), EXPANSIONS, F.when(F.lit(False), F.col("more")))
    lists = each.join(known, "term").select("query_id", F.struct("pos", cut.alias("more")).alias("x")).groupBy("query_id").agg(F.map_from_entries(F.collect_list("x")).alias("lists"))
    q = q.join(lists, "query_id", "left")
    none = F.array().cast("array<string>")
    got = lambda i: F.coalesce(F.element_at("lists", i), none)
    spread = F.flatten(F.transform("terms", lambda t, i: F.concat(F.array(t), got(i))))
    genre = F.when(F.size(got(F.lit(0))) > 0, got(F.lit(0))).otherwise(one(asked["genre"]))
    top = one(F.concat(F.lit("top "), asked["count"].cast("string")))
    joined = lambda a: F.array_join(a, " ")
    if expand:
        suggestion = joined(F.concat(genre, top, asked["modifiers"]))
    else:
        suggestion = F.when(F.size(got(F.lit(0))) > 0, joined(spread))
    parts = F.concat(one(about["subject"]), one(about["topic"]), F.when(about["topic"].isNotNull(), got(F.lit(0))).otherwise(none))
    text = F.when(F.col("kind") == "recommendation", suggestion).when(F.col("kind") == "search", F.when(F.size("terms") > 0, joined(F.array_distinct(spread)))).when(F.col("kind") == "information", F.when(F.size(parts) > 0, joined(parts))).otherwise(F.when(F.size("terms") > 0, joined(spread)))
    return q.select("query_id", "intent", "question", F.coalesce(F.when(F.col("question"), text), F.col("text")).alias("expanded"))


def log(s, d) -> DataFrame:
    """Texts of users; the synthetic log has few questions, so a prefix by turn makes every kind of them."""
    t = table(s, d, "conversations").where("role = 'user'")
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.pmod("turn", F.lit(len(LEADS))) + 1).cast("int"))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(lead, F.regexp_replace("text", r"\s+", " ")).alias("text"))


LEADS = ("suggest 5 movies recent sci-fi ", "", "find movies with ", "tell me about x in ", "compare ", "why is ", "what is ", "Plain details ", "explain ", "name the reason ", "recommend 3 films old drama ", "give me ")


def _expansions(s, d):
    """For each word of the log, the words that follow it most often."""
    words = F.split(F.lower("text"), r"\s+")
    pairs = log(s, d).select(F.explode(F.arrays_zip(F.slice(words, 1, F.size(words) - 1).alias("term"), F.slice(words, 2, F.size(words)).alias("expansion"))).alias("x")).select("x.term", "x.expansion")
    from .text_jobs import top_per_group

    return top_per_group(pairs.groupBy("term", "expansion").agg(F.count("*").alias("n")), ["term"], [F.col("n").desc(), "expansion"], 5).select("term", "rank", "expansion")


LOG = f"(SELECT conv_id * 1000 + turn AS query_id, ({list(LEADS)})[(turn % {len(LEADS)} + 1)::INT] || regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations WHERE role = 'user')"
_ANY = lambda words: " OR ".join(f"contains(t, '{w}')" for w in words)
_INTENT = "CASE " + " ".join(f"WHEN {_ANY(w)} THEN '{n}'" for n, w in INTENTS) + " ELSE 'search' END"
_QUESTION = "(contains(text, '?') OR regexp_matches(t, '^(?:" + "|".join(STARTERS) + ")'))"
_T = f"(SELECT *, lower(text) AS t FROM {LOG})"
_REPLACED = reduce(lambda c, w: f"replace({c}, '{w}', ' ')", SEARCH_WORDS, "t")
_TERMS = f"list_filter(string_split_regex({_REPLACED}, '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for'))"
_WORDS = f"list_filter(string_split_regex(t, '\\s+'), lambda w: length(w) > 2 AND w NOT IN {STOP})"
_x = lambda p, i: f"nullif(trim(regexp_extract(t, '{p}', {i})), '')"
_BOTH, _PLAIN, _NAMED = "about\\s+(.+?)\\s+in\\s+(.+)", "what\\s+is\\s+(.+)", "(.+?)\\s+(?:information|details|info)"
_SUBJECT = f"CASE WHEN regexp_matches(t, '{_BOTH}') THEN {_x(_BOTH, 2)} WHEN regexp_matches(t, '{_PLAIN}') THEN NULL ELSE {_x(_NAMED, 1)} END"
_TOPIC = f"CASE WHEN regexp_matches(t, '{_BOTH}') THEN {_x(_BOTH, 1)} WHEN regexp_matches(t, '{_PLAIN}') THEN nullif(trim(regexp_extract(t, '{_PLAIN}', 1), '?'), '') WHEN regexp_matches(t, '{_NAMED}') THEN 'information' END"
_COUNT = "nullif(regexp_extract(t, '\\b(\\d+)\\s+(?:movie|film)', 1), '')"
_GENRE = f"list_filter({list(GENRES)}, lambda g: contains(t, g))[1]"
_MODIFIERS = f"list_filter({list(MODIFIERS)}, lambda m: contains(t, m))"
_EXP = f"(SELECT term, list(expansion ORDER BY n DESC, expansion)[1:5] AS more FROM (SELECT term, expansion, count(*) AS n FROM (SELECT unnest(w[1:-2]) AS term, unnest(w[2:]) AS expansion FROM (SELECT string_split_regex(t, '\\s+') AS w FROM {_T})) GROUP BY 1, 2) GROUP BY 1)"


def _expanded_sql(expand: bool) -> str:
    n = {k: v[0 if expand else 1] for k, v in EXPANSIONS.items()}
    q = f"SELECT *, CASE WHEN intent IN ('recommendation', 'search', 'information') THEN intent ELSE 'other' END AS kind FROM (SELECT *, {_INTENT} AS intent, {_QUESTION} AS question, {_COUNT} AS cnt, {_GENRE} AS genre, {_MODIFIERS} AS mods, {_SUBJECT} AS subject, {_TOPIC} AS topic FROM {_T})"
    q = f"SELECT *, CASE kind WHEN 'recommendation' THEN list_filter([genre], lambda x: x IS NOT NULL) WHEN 'search' THEN {_TERMS}{'[1:5]' if expand else ''} WHEN 'information' THEN list_filter([topic], lambda x: x IS NOT NULL) ELSE {_WORDS}[1:3] END AS terms FROM ({q})"
    each = f"SELECT query_id, kind, unnest(range(1, len(terms) + 1)) AS pos, unnest(terms) AS term FROM ({q})"
    each = f"SELECT query_id, pos, term, coalesce(more[1:CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in n.items()) + f" END], []) AS more FROM ({each}) LEFT JOIN {_EXP} USING (term)"
    lists = f"SELECT query_id, flatten(list([term] || more ORDER BY pos)) AS spread, first(more ORDER BY pos) AS more FROM ({each}) GROUP BY 1"
    suggestion = "array_to_string(CASE WHEN len(coalesce(more, [])) > 0 THEN more ELSE list_filter([genre], lambda x: x IS NOT NULL) END || list_filter(['top ' || cnt], lambda x: x IS NOT NULL) || mods, ' ')" if expand else "CASE WHEN len(more) > 0 THEN array_to_string(spread, ' ') END"
    once = "array_to_string(list_transform(list_filter(list_zip(spread, range(1, len(spread) + 1)), lambda z: list_position(spread, z[1]) = z[2]), lambda z: z[1]), ' ')"
    parts = "(list_filter([subject, topic], lambda x: x IS NOT NULL) || coalesce(more, []))"
    text = f"CASE kind WHEN 'recommendation' THEN {suggestion} WHEN 'search' THEN {once} WHEN 'information' THEN nullif(array_to_string({parts}, ' '), '') ELSE array_to_string(spread, ' ') END"
    return f"SELECT query_id, intent, question, coalesce(CASE WHEN question THEN {text} END, text) AS expanded FROM ({q}) LEFT JOIN ({lists}) USING (query_id)"


QUERIES = {
    "k2_intents": lambda s, d: log(s, d).groupBy(intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"), F.count_if(is_question(F.col("text"))).alias("questions")),
    "k3_recommendations": lambda s, d: log(s, d).select("query_id", recommendation(F.col("text")).alias("r")).select("query_id", F.col("r.count").cast("long").alias("n"), "r.genre", F.array_join("r.modifiers", " ").alias("modifiers")),
    "k4_search_terms": lambda s, d: log(s, d).select("query_id", F.array_join(search_terms(F.col("text")), " ").alias("terms")),
    "k5_information": lambda s, d: log(s, d).select("query_id", information(F.col("text")).alias("i")).select("query_id", "i.subject", "i.topic"),
    "k6_keywords": lambda s, d: log(s, d).select("query_id", F.array_join(keywords(F.col("text")), " ").alias("words")),
    "k7_expanded_queries": lambda s, d: expanded(log(s, d), _expansions(s, d)),
    "k8_unexpanded_queries": lambda s, d: expanded(log(s, d), _expansions(s, d), expand=False),
}
ORACLES = {
    "k2_intents": f"SELECT {_INTENT} AS intent, count(*) AS n, count(*) FILTER ({_QUESTION}) AS questions FROM {_T} GROUP BY 1",
    "k3_recommendations": f"SELECT query_id, {_COUNT}::BIGINT AS n, {_GENRE} AS genre, array_to_string({_MODIFIERS}, ' ') AS modifiers FROM {_T}",
    "k4_search_terms": f"SELECT query_id, array_to_string({_TERMS}, ' ') AS terms FROM {_T}",
    "k5_information": f"SELECT query_id, {_SUBJECT} AS subject, {_TOPIC} AS topic FROM {_T}",
    "k6_keywords": f"SELECT query_id, array_to_string({_WORDS}, ' ') AS words FROM {_T}",
    "k7_expanded_queries": _expanded_sql(True),
    "k8_unexpanded_queries": _expanded_sql(False),
}
