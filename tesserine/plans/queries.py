"""Registered queries over compiled plans and prompt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.records import PART_RULES, _ERRORS
from ..operators.text_jobs import key_sql
from ..sources.tables import table
from ..operators.detect import _film, content_analysis
from ..operators.expand import embellished
from ..operators.questions import LOG, log, search_terms
from .enrich import Group, Plan, Step, analysed

PLAN = Plan(constraints=PART_RULES, enrichments=[Step("key", ("p_name",), T.key_part), Step("brand_key", ("p_brand",), T.key_part)], prompts={"prompt": "Name {p_name} as {key} of {brand_key}"}, overrides={"p_type": "key"})
_words = lambda c: F.split(F.lower(c), " ")
#: Two keyword sources that only their merge sees, and prompts chained by reference.
CHAIN = Plan(
    enrichments=[
        Group([Step("name_words", ("p_name",), _words), Step("type_words", ("p_type",), _words)], [Step("merged", ("name_words", "type_words"), lambda a, b: F.array_distinct(F.concat(a, b)))]),
        Step("size", ("p_size", "merged"), lambda n, m: F.struct(n.alias("value"), F.size(m).alias("keywords"))),
    ],
    prompts={"first": "About {@merged}: {@merged.0} of size {@size.value}", "second": "{@first}? {@size.keywords} words, not {@merged.9}"},
)

#: Questions asked of a field by the first of these words that its name contains, and of any other.
QUESTIONS = {
    "overview": ("What is the main theme or topic?", "What genre does this belong to?", "What are the key elements or features?"),
    "description": ("What is this about?", "What are the main characteristics?", "What makes this unique or notable?"),
    "plot": ("What is the main storyline?", "Who are the main characters?", "What is the central conflict or theme?"),
    "summary": ("What are the key points?", "What is the main message?", "What should someone know about this?"),
    "content": ("What type of content is this?", "What is the main subject matter?", "What audience is this for?"),
    "": ("What is this about?", "What are the main themes or topics?", "What category does this belong to?"),
}
#: Questions by type of information; any other type has those of the first.
INFORMATION = {
    "general": ("What is the main topic or subject?", "What are the key facts or details?", "What is the significance or importance?"),
    "narrative": ("What is the main storyline or plot?", "Who are the main characters or people involved?", "When and where does this take place?", "What is the outcome or resolution?"),
    "technical": ("What is the main technology or method described?", "What are the key specifications or requirements?", "What are the benefits or applications?"),
    "biographical": ("Who is the main person?", "What are their key achievements or contributions?", "When and where did key events occur?"),
}
#: Prompts for keywords of a field, found by its name in the same way.
PROMPTS = {
    "name": "Given this title/name: '{value}', provide related concepts, themes, and associated terms that would help find similar content.",
    "title": "Given this title: '{value}', provide related concepts, themes, and associated terms that would help find similar content.",
    "overview": "Given this description: '{value}', extract and expand key concepts, themes, genres, and related terms.",
    "description": "Given this description: '{value}', extract and expand key concepts, themes, and related terms.",
    "genres": "Given these genres: '{value}', provide related genres, subgenres, and thematic categories.",
    "tags": "Given these tags: '{value}', provide related tags, categories, and associated terms.",
    "summary": "Given this summary: '{value}', extract and expand key concepts and themes.",
    "": "Given this content: '{value}', provide related concepts, themes, and terms that would help categorize and find similar content.",
}


def by_name(field, rules: dict):
    """The value of the first rule whose word is part of a field's name; the last rule's word, empty, is part of any."""
    return F.coalesce(*(F.when(F.lower(field).contains(k), v) for k, v in rules.items()))


def asked(texts):
    """(field, value, question): the questions of a field's name, each once for a value."""
    lists = by_name(F.col("field"), {k: F.array(*map(F.lit, qs)) for k, qs in QUESTIONS.items()})
    return texts.select("field", "value").distinct().select("field", "value", F.explode(lists).alias("question"))


def information_requests(texts, kind):
    """(value, kind, question): the questions of the type of information wanted."""
    lists = {k: F.array(*map(F.lit, qs)) for k, qs in INFORMATION.items()}
    wanted = F.coalesce(*(F.when(kind == k, v) for k, v in lists.items()), lists["general"])
    return texts.select("value", kind.alias("kind"), F.explode(wanted).alias("question"))


def prompted(texts):
    """(field, prompt): the default prompt of a field's name with its value."""
    parts = {k: F.concat(F.lit(before), F.col("value"), F.lit(after)) for k, (before, after) in ((k, p.split("{value}")) for k, p in PROMPTS.items())}
    return texts.select("field", by_name(F.col("field"), parts).alias("prompt"))


def _texts(s, d):
    """Texts of fields with names of several kinds."""
    f = lambda name, c: F.struct(F.lit(name).alias("field"), c.alias("value"))
    return table(s, d, "part").select(F.explode(F.array(f("p_name", F.col("p_name")), f("Short_Description", F.concat_ws(" ", "p_brand", "p_name")), f("PlotSummary", F.lower("p_type")), f("p_type", F.col("p_type")))).alias("x")).select("x.*")


_FIELDS = "(SELECT unnest(['p_name', 'Short_Description', 'PlotSummary', 'p_type']) AS field, unnest([p_name, p_brand || ' ' || p_name, lower(p_type), p_type]) AS value FROM part)"
_Q = lambda text: "'" + text.replace("'", "''") + "'"
_BY = lambda rules, of: "CASE " + " ".join(f"WHEN contains(lower(field), '{k}') THEN {of(v)}" for k, v in rules.items()) + " END"
_LISTED = lambda qs: "[" + ", ".join(map(_Q, qs)) + "]"
_PROMPT = lambda p: " || ".join((_Q(p.split("{value}")[0]), "value", _Q(p.split("{value}")[1])))
_KIND = "CASE WHEN p_size > 40 THEN 'narrative' WHEN p_size > 30 THEN 'technical' WHEN p_size > 20 THEN 'biographical' WHEN p_size > 10 THEN 'other' ELSE 'general' END"
_KINDS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_LISTED(v)}" for k, v in INFORMATION.items()) + f" ELSE {_LISTED(INFORMATION['general'])} END"


def _embellished(s, d):
    """Texts of the log lower-cased, without question marks, then cut to their search terms."""
    replace = lambda make: lambda df, c: df.withColumn(c, make(F.col(c)))
    steps = (replace(lambda t: F.trim(F.replace(F.lower(t), F.lit("?"), F.lit("")))), replace(lambda t: F.array_join(search_terms(t), " ")))
    return embellished(log(s, d), "text", *steps)


def _analysed(s, d):
    f = _film(s, d).withColumn("kind", F.when(F.col("o_orderkey") % 3 == 0, "movie").when(F.col("title") == "1-URGENT", "tv_show").when(F.col("title").isNotNull(), "book").otherwise("game"))
    fields = {n: F.col(n) for n in ("name", "title", "people")}
    own = {t: {"heading": (a := content_analysis(t, fields))["title"], "makers": F.array_join(a["people"]["creators"], ",")} for t in ("movie", "tv_show", "book")}
    return analysed(f, "kind", own).select("o_orderkey", "kind", "heading", "makers")


_FILM = "(SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'movie' WHEN title = '1-URGENT' THEN 'tv_show' WHEN title IS NOT NULL THEN 'book' ELSE 'game' END AS kind FROM (SELECT *, CASE WHEN o_totalprice > 100000 THEN 'Order ' || o_orderkey END AS name, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS title FROM orders))"
_MAKERS = "CASE WHEN kind IN ('movie', 'tv_show') THEN array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'clerk ' || o_custkey END, CASE WHEN o_orderstatus <> 'P' THEN lower(o_orderpriority) END], lambda x: x IS NOT NULL), ',') WHEN kind = 'book' THEN '' END"
_SEARCHED = "trim(replace(t, '?', ''))"
for _w in ("find", "search", "show", "movies", "films", "with", "featuring", "about"):
    _SEARCHED = f"replace({_SEARCHED}, '{_w}', ' ')"
_MERGED = "(SELECT p_partkey, p_size, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]) AS m FROM (SELECT *, string_split(lower(p_name), ' ') || string_split(lower(p_type), ' ') AS l FROM part))"
_FIRST = "'About ' || array_to_string(m, ', ') || ': ' || m[1] || ' of size ' || p_size"

QUERIES = {
    "m2_embellished": lambda s, d: _embellished(s, d).select("query_id", "text"),
    "m6_media_analysis": _analysed,
    "m8_chained_plan": lambda s, d: CHAIN.apply(table(s, d, "part")).select("p_partkey", "first", "second"),
    "m8_compiled_plan": lambda s, d: PLAN.apply(table(s, d, "part")).select("p_partkey", F.array_join("errors", ",").alias("errors"), "prompt", "p_type"),
    "g17_question_requests": lambda s, d: asked(_texts(s, d)),
    "g17_information_requests": lambda s, d: information_requests(table(s, d, "part").withColumn("value", F.col("p_name")), F.expr(_KIND)),
    "g17_default_prompts": lambda s, d: prompted(_texts(s, d)),
}
ORACLES = {
    "m2_embellished": f"SELECT query_id, array_to_string(list_filter(string_split_regex({_SEARCHED}, '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for')), ' ') AS text FROM (SELECT *, lower(text) AS t FROM {LOG})",
    "m6_media_analysis": f"SELECT o_orderkey, kind, CASE kind WHEN 'book' THEN coalesce(title, name, 'Unknown Title') WHEN 'movie' THEN coalesce(name, title, 'Unknown Title') WHEN 'tv_show' THEN coalesce(name, title, 'Unknown Title') END AS heading, {_MAKERS} AS makers FROM {_FILM}",
    "m8_chained_plan": f"SELECT p_partkey, {_FIRST} AS first, {_FIRST} || '? ' || len(m) || ' words, not ' AS second FROM {_MERGED}",
    "m8_compiled_plan": f"SELECT p_partkey, {_ERRORS} AS errors, 'Name ' || p_name || ' as ' || {key_sql('p_name')} || ' of ' || {key_sql('p_brand')} AS prompt, {key_sql('p_name')} AS p_type FROM part",
    "g17_question_requests": f"SELECT field, value, unnest({_BY(QUESTIONS, _LISTED)}) AS question FROM (SELECT DISTINCT field, value FROM {_FIELDS})",
    "g17_information_requests": f"SELECT value, kind, unnest({_KINDS}) AS question FROM (SELECT p_name AS value, {_KIND} AS kind FROM part)",
    "g17_default_prompts": f"SELECT field, {_BY(PROMPTS, _PROMPT)} AS prompt FROM {_FIELDS}",
}
