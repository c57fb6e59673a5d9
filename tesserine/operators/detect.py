"""Media-type detection, concept extraction by rules, content analysis and temporal expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import rule_table, table
from .text_jobs import concepts_sql, top_per_group

#: Field-name patterns of media types with their weights, in order of the types.
PATTERNS = (
    ("movie", "premiere.*date", 1.0), ("movie", "production.*year", 1.0), ("movie", "runtime.*ticks", 1.0), ("movie", "original.*title", 1.0),
    ("tv_show", "series.*name", 1.0), ("tv_show", "season.*number", 1.0), ("tv_show", "episode.*number", 1.0), ("tv_show", "episode.*name", 1.0),
    ("book", "author", 1.0), ("book", "publisher", 1.0), ("book", "isbn", 1.0), ("book", "page.*count", 1.0),
    ("music", "artist", 1.0), ("music", "album", 1.0), ("music", "track.*number", 1.0), ("music", "duration", 1.0),
)
TYPES = ("movie", "tv_show", "book", "music")
#: What counts for a type where no pattern holds, in the order that decides ties.
FALLBACK = (("tv_show", "series|season|episode"), ("book", "author|publisher|isbn|page"), ("music", "artist|album|track|duration"), ("movie", "premiere|production|runtime|original.*title"))
#: Roles of fields by name, with weights.
ROLES = (
    ("text", "name", 1.0), ("text", "title", 1.0), ("text", "overview", 1.5), ("text", "description", 1.5), ("text", "summary", 1.2), ("text", "plot", 1.2), ("text", "content", 1.0), ("text", "synopsis", 1.0),
    ("date", "date", 2.0), ("date", "year", 1.5), ("date", "time", 1.0), ("date", "created", 0.8), ("date", "modified", 0.5),
)
#: Fields of a title, and roles of creators and performers, by type.
TITLES = {"movie": ("name", "title", "original_title"), "book": ("title", "name"), "music": ("title", "album", "track_name"), "tv_show": ("name", "series_name", "title")}
CREATORS = {"movie": ("director", "producer"), "book": ("author", "editor"), "music": ("composer", "producer", "songwriter"), "tv_show": ("creator", "director", "producer")}
PERFORMERS = {"movie": ("actor", "actress"), "book": ("narrator",), "music": ("artist", "performer", "vocalist"), "tv_show": ("actor", "actress")}


def detect_by_patterns(keys: DataFrame, patterns: DataFrame, order: tuple[str, ...] = TYPES) -> DataFrame:
    """rec, media_type, score: the type whose patterns (matched at the start of any key) weigh most; ties by order of types.

    Where no pattern holds, the fallback decides with score 0.  Distinct keys
    are matched, not records.
    """
    names = keys.select("key").distinct()
    rules = patterns.withColumn("pattern_id", F.monotonically_increasing_id())
    matched = names.join(rules, F.expr("rlike(lower(key), concat('^(?:', pattern, ')'))")).select("key", "media_type", "pattern_id", "weight")
    hit = keys.join(matched, "key").select("rec", "media_type", "pattern_id", "weight").distinct()
    scores = hit.groupBy("rec", "media_type").agg(F.round(F.sum("weight"), 6).alias("score"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("media_type"))
    best = top_per_group(scores.withColumn("place", place), ["rec"], [F.col("score").desc(), "place"], 1)
    other = detect_by_fallback(keys).withColumnRenamed("media_type", "other")
    return other.join(best.select("rec", "media_type", "score"), "rec", "left").select("rec", F.coalesce("media_type", "other").alias("media_type"), F.coalesce("score", F.lit(0.0)).alias("score"))


def detect_by_fallback(keys: DataFrame) -> DataFrame:
    """rec, media_type: the type most of whose expressions are found in the record's keys; movie where none is."""
    counts = keys.groupBy("rec").agg(*(F.count_if(F.lower("key").rlike(p)).alias(t) for t, p in FALLBACK))
    most = F.greatest(*(F.col(t) for t, _ in FALLBACK))
    return counts.select("rec", reduce(lambda c, t: c.when(F.col(t) == most, t), (t for t, _ in FALLBACK), F.when(most == 0, "movie")).alias("media_type"))


def field_roles(keys: DataFrame) -> DataFrame:
    """key, role, weight: the text-like and date-like roles of distinct field names, each with its largest weight."""
    rules = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(p).alias("pattern"), F.lit(w).alias("weight")) for r, p, w in ROLES))
    hits = keys.select("key").distinct().select("key", F.explode(rules).alias("r")).where(F.expr("rlike(lower(key), r.pattern)"))
    return hits.groupBy("key", F.col("r.role").alias("role")).agg(F.max("r.weight").alias("weight"))


def detect_by_presence(keys: Column) -> Column:
    has = lambda *n: F.arrays_overlap(keys, F.array(*map(F.lit, n)))
    return F.when(has("production_year", "movie_id"), "movie").when(has("album", "artist"), "music").when(has("isbn", "author"), "book").when(has("series_name", "episode"), "tv_show").otherwise("movie")


def standard_type(t: Column) -> Column:
    return F.when(F.lower(t).isin(*TYPES), F.lower(t)).otherwise("movie")


def simple_keywords(*texts: Column, most: int = 10) -> Column:
    return F.slice(F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), r"\s+"), lambda w: F.length(w) > 3), 1, most)


def direct_values(c: Column, kind: str, most: int = 10) -> Column:
    """Concepts as they stand: of a text itself, of a list its first items, of a list of records their names; numbers have none."""
    if kind == "text":
        out = F.array(F.trim(F.lower(c)))
    elif kind == "list":
        out = F.transform(F.slice(c, 1, most), lambda x: F.trim(F.lower(x)))
    elif kind == "records":
        out = F.transform(F.slice(c, 1, most), lambda x: F.trim(F.lower(x["Name"])))
    else:
        return F.array().cast("array<string>")
    return F.filter(out, lambda x: x != "")


def rule_concepts(rows: DataFrame, id_col: str, rules: list[tuple[str, Column]], most: int = 15) -> DataFrame:
    """(id, rank, concept): each rule's concepts in the order of rules and positions, each once, the first `most`."""

    def placed(n: int, concepts: Column) -> Column:
        return F.transform(concepts, lambda c, i: F.struct(F.lit(n).alias("rule"), i.alias("pos"), c.alias("concept")))

    each = F.explode(F.flatten(F.array(*(placed(n, a) for n, (_, a) in enumerate(rules)))))
    once = rows.select(id_col, each.alias("x")).groupBy(id_col, "x.concept").agg(F.min(F.struct("x.rule", "x.pos")).alias("at"))
    return top_per_group(once, [id_col], ["at"], most).select(id_col, "rank", "concept")


def content_analysis(media_type: str, fields: dict[str, Column], default: str = "Unknown Title") -> dict[str, Column]:
    """What a type's analysis takes from a record's fields: title, genres (confidence 1), people by role, ratings."""
    title = F.coalesce(*(fields[n] for n in TITLES[media_type] if n in fields), F.lit(default))
    out = {"title": title}
    if "genres" in fields:
        out["genres"] = genres(fields["genres"])
    if "people" in fields:
        out["people"] = people_split(fields["people"], CREATORS[media_type], PERFORMERS[media_type])
    return out


def genres(names: Column) -> Column:
    """Genres of a record, which are sure."""
    return F.transform(names, lambda g: F.struct(g.alias("name"), F.lit(1.0).alias("confidence")))


def people_split(people: Column, creators: tuple[str, ...], performers: tuple[str, ...]) -> Column:
    names = lambda kinds: F.transform(F.filter(people, lambda p: F.lower(p["Type"]).isin(*kinds)), lambda p: F.trim(F.lower(p["Name"].cast("string"))))
    return F.struct(names(creators).alias("creators"), names(performers).alias("performers"))


def technical(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: v.isNotNull())


# --- temporal rules -------------------------------------------------------------

#: Rules of expressions: type, pattern, and the value where it isn't the text.
EXPRESSIONS = (
    ("DATE", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", None), ("DATE", r"\b[0-9]{4}s?\b", None), ("DATE", r"\b(?:last|next|this) (?:week|month|year)\b", None),
    ("DURATION", r"\b[0-9]+ (?:days|hours|minutes)\b", None), ("TIME", r"\b[0-9]{2}:[0-9]{2}\b", None), ("SET", r"\b(?:daily|weekly|monthly|yearly)\b", None), ("ORDINAL", r"\b[0-9]+(?:st|nd|rd|th)\b", None),
    ("DATE", r"\b(?:now|currently|today)\b", "PRESENT_REF"), ("DATE", r"\b(?:formerly|once|previously)\b", "PAST_REF"), ("DATE", r"\b(?:soon|upcoming)\b", "FUTURE_REF"),
)
#: What each rule's matches hold one of, which is looked for first, as patterns take far longer; those of numbers need a digit besides.
HELD = (("-",), (), (" week", " month", " year"), (" days", " hours", " minutes"), (":",), ("daily", "weekly", "monthly", "yearly"), ("st", "nd", "rd", "th"), ("now", "currently", "today"), ("formerly", "once", "previously"), ("soon", "upcoming"))
#: Concepts of dates by what they contain, of references in time, periods and values without meaning.
FREQUENCY = (("weekly", ("week", "weekly")), ("monthly", ("month", "monthly")), ("yearly", ("year", "yearly", "annual")), ("daily", ("day", "daily")), ("recent", ("recent", "new", "latest")), ("classic", ("old", "classic", "vintage")))
REFERENCES = (("PRESENT_REF", ("current", "present", "now")), ("PAST_REF", ("past", "historical", "previous")), ("FUTURE_REF", ("future", "upcoming", "forthcoming")))
PERIODS = ("historical", "seasonal", "lifecycle", "narrative")
VOID = ("XXXX-XX", "XX")


def temporal_flag(text: Column) -> tuple[Column, Column]:
    """Whether a year or decade stands in the text, and the confidence of that."""
    hit = text.rlike(r"\b[0-9]{4}s?\b")
    return hit, F.when(hit, 0.6).otherwise(0.4)


def expressions(text: Column) -> Column:
    """Expressions of time in a text as array of (type, value, text), rule by rule."""

    def one(kind: str, pattern: str, value: str | None, held: tuple[str, ...]) -> Column:
        # Only the rule of years finds decades, whose value goes without the s.
        own = (lambda x: F.lit(value)) if value else (lambda x: F.substring(x, 1, 4)) if "{4}s?" in pattern else lambda x: x
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.struct(F.lit(kind).alias("type"), own(x).alias("value"), x.alias("text")))
        return F.when(reduce(lambda a, b: a | b, (text.contains(h) for h in held)), found).otherwise(none) if held else found

    none = F.array().cast("array<struct<type: string, value: string, text: string>>")
    rules = [(one(*r, h), "[0-9]" in r[1]) for r, h in zip(EXPRESSIONS, HELD)]
    return F.when(text.isNotNull(), F.concat(*(F.when(text.rlike("[0-9]"), c).otherwise(none) if number else c for c, number in rules)))


def entity_concepts(e: Column) -> Column:
    """Concepts of an entity: its text, for dates how often or how old, and its type."""
    text = F.lower(e["text"])
    related = [F.when((e["type"] == "DATE") & reduce(lambda a, b: a | b, (text.contains(w) for w in words)), F.lit(c)) for c, words in FREQUENCY]
    return F.array_distinct(F.array_compact(F.array(text, *related, F.concat(F.lit("temporal-"), F.lower(e["type"])))))


def tag_concepts(e: Column, modifier: Column | None = None) -> Column:
    """Concepts of a tagged expression: its text, type, value where it has a meaning, and modifier."""
    value = F.when((e["value"] != "") & ~e["value"].isin(*VOID), F.concat(F.lit("heideltime-value-"), e["value"]))
    more = [F.concat(F.lit("heideltime-modifier-"), F.lower(F.nullif(modifier, F.lit(""))))] if modifier is not None else []
    return F.array_compact(F.array(F.nullif(e["text"], F.lit("")), F.concat(F.lit("temporal-"), F.lower(F.nullif(e["type"], F.lit("")))), value, *more))


def timex_tags(text: Column) -> Column:
    """Expressions (type, value, text) of a text with TIMEX3 tags."""
    pattern = r'<TIMEX3[^>]*type="([^"]*)"[^>]*value="([^"]*)"[^>]*>([^<]*)</TIMEX3>'
    parts = [F.regexp_extract_all(text, F.lit(pattern), i).alias(n) for i, n in ((1, "type"), (2, "value"), (3, "text"))]
    return F.arrays_zip(*parts)


def annotation_concepts(e: Column, original: Column) -> Column:
    """Concepts of an annotation: type, year and decade, past, present or future, and its text, which stands in the original, where it isn't the whole of that."""
    year = F.regexp_extract(e["value"], r"([0-9]{4})", 1)
    words = reduce(lambda c, r: c.when(e["value"].contains(r[0]), F.array(*map(F.lit, r[1]))), REFERENCES, F.when(F.lit(False), F.array().cast("array<string>")))
    dated = F.flatten(F.transform(F.filter(F.array(year), lambda y: y != ""), lambda y: F.array(F.concat(F.lit("year-"), y), F.concat(F.substring(y, 1, 3), F.lit("0s")))))
    # A part is the whole if it is as long: texts are not compared, as each of a long text's expressions would lower-case it again.
    text = F.when(F.octet_length(e["text"]) != F.octet_length(original), F.lower(e["text"]))
    return F.array_compact(F.concat(F.array(F.concat(F.lit("temporal-"), F.lower(e["type"]))), dated, F.coalesce(words, F.array().cast("array<string>")), F.array(text)))


def is_range(e: Column) -> Column:
    return e["type"].isin("DURATION", "SET", "TIME") | F.lower(e["value"]).contains("range")


def is_period(kind: Column, description: Column) -> Column:
    return kind.isin("period", "era", "timeframe") | reduce(lambda a, b: a | b, (F.lower(description).contains(p) for p in PERIODS))


def category_counts(concepts: DataFrame) -> DataFrame:
    """Of concepts (category, implicit): how many there are of each kind."""
    of = lambda c: F.count_if(F.col("category") == c)
    return concepts.agg(F.count("*").alias("total"), of("period").alias("periods"), of("sequence").alias("sequences"), of("relationship").alias("relationships"), F.count_if("implicit").alias("implicit"))


def falling(start: float, step: float, least: float, position: Column) -> Column:
    return F.round(F.greatest(F.lit(start) - position * step, F.lit(least)), 6)


def normalised(expression: Column, reference: Column) -> Column:
    """Date of an expression, by a reference date where it is relative; null where it has none."""
    e = F.lower(F.trim(expression))
    n = F.regexp_extract(e, "([0-9]+)", 1).cast("int")
    unit = F.regexp_extract(e, r"(day|week|month|year)s?(?: ago)?$", 1)
    by = lambda k: F.when(unit == "day", F.date_add(reference, k)).when(unit == "week", F.date_add(reference, k * 7)).when(unit == "month", F.add_months(reference, k)).when(unit == "year", F.add_months(reference, k * 12))
    sign = F.when(e.rlike("^last |^yesterday$"), -1).when(e.rlike("^next |^tomorrow$"), 1).otherwise(0)
    return (
        F.when(e.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(e))
        .when(e.rlike("^(?:last|next|this) (?:day|week|month|year)$"), by(sign))
        .when(e.rlike("^(?:today|yesterday|tomorrow)$"), F.date_add(reference, sign))
        .when(e.rlike("^[0-9]+ (?:day|week|month|year)s? ago$"), by(-n))
        .when(e.rlike("^in [0-9]+ (?:day|week|month|year)s?$"), by(n))
        .when(e.rlike("^[0-9]{4}s?$"), F.make_date(n, F.lit(1), F.lit(1)))
    )


def with_document_time(rows: DataFrame, expression: str, created: str, kind: Column) -> DataFrame:
    """rows with document_type, document_creation_time and date: relative expressions of narratives have no date, as nothing anchors them."""
    anchor = F.when(kind != "narrative", F.col(created).cast("date"))
    return rows.withColumns({"document_type": kind, "document_creation_time": anchor, "date": normalised(F.col(expression), anchor)})


# --- queries --------------------------------------------------------------------


def records(s, d) -> DataFrame:
    """rec, keys: the field names that records of four feeds have filled."""
    t = lambda n: table(s, d, n)
    keys = lambda *k: F.array_compact(F.array(*(F.lit(x) if isinstance(x, str) else x for x in k)))
    o = t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("rec"), keys("Id", "Name", "Premiere_Date", F.when(F.col("o_orderstatus") == "F", "ProductionYear"), F.when(F.col("o_orderstatus") == "P", "album")).alias("keys"))
    p = t("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), keys("Title", F.when(F.col("p_size") > 20, "Author"), F.when(F.col("p_size") < 30, "ISBN_13"), F.when(F.col("p_size") > 45, "total_pages")))
    c = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), keys("c_name", F.when(F.col("c_acctbal") > 0, "SeriesName"), F.when(F.col("c_mktsegment") == "BUILDING", "the_season"), F.when(F.col("c_mktsegment") == "MACHINERY", "first_track"), "Date_Created"))
    u = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), keys("s_name", F.when(F.col("s_acctbal") > 0, "Artist"), F.when(F.col("s_acctbal") > 5000, "duration"), F.when(F.col("s_acctbal") < 100, "EpisodeName")))
    return o.union(p).union(c).union(u)


def _keys(s, d):
    return records(s, d).select("rec", F.explode("keys").alias("key"))


def texts(s, d) -> DataFrame:
    """id, text: sentences about orders that hold their dates, and all documents."""
    o = table(s, d, "orders")
    when = F.date_format("o_orderdate", "yyyy-MM-dd")
    tone = F.when(F.col("o_orderstatus") == "F", "formerly of last year").when(F.col("o_orderstatus") == "O", "now and monthly").otherwise("upcoming next month")
    line = F.concat(F.lit("Ordered "), when, F.lit(" at 10:"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.lit(", the "), (F.col("o_custkey") % 9 + 4).cast("string"), F.lit("th, due in "), (F.col("o_custkey") % 90).cast("string"), F.lit(" days, style of the "), F.year("o_orderdate").cast("string"), F.lit("s, "), tone)
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), line.alias("text")).union(table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text"))


def found(s, d) -> DataFrame:
    return texts(s, d).select("id", "text", F.posexplode(expressions(F.col("text"))).alias("pos", "e"))


def _tagged_texts(s, d):
    """Each order's expressions as a text with tags."""
    tag = lambda e: F.concat(F.lit('<TIMEX3 tid="t" type="'), e["type"], F.lit('" value="'), e["value"], F.lit('">'), e["text"], F.lit("</TIMEX3> "))
    return texts(s, d).select("id", F.array_join(F.transform(expressions(F.col("text")), tag), "and ").alias("text"))


def concepts(s, d) -> DataFrame:
    """Concepts as a model would report them, one for each order, from its columns."""
    o = table(s, d, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "period").when(F.col("o_orderpriority") == "2-HIGH", "era").when(F.col("o_orderpriority") == "3-MEDIUM", "event").otherwise("date")
    category = F.when(F.col("o_orderstatus") == "F", "period").when(F.col("o_orderstatus") == "O", "sequence").otherwise("relationship")
    description = F.concat(F.when(F.col("o_totalprice") > 300000, "Historical ").when(F.col("o_totalprice") < 50000, "seasonal ").otherwise("plain "), F.lower("o_orderpriority"))
    return o.select("o_orderkey", kind.alias("type"), category.alias("category"), description.alias("description"), (F.col("o_totalprice") > 200000).alias("implicit"))


def text_concepts(rows: DataFrame, concepts_of, start: float, step: float, least: float) -> DataFrame:
    """id, rank, concept, confidence: the concepts of all expressions of a text, each once in order of appearance, with falling confidence.

    concepts_of takes an expression, its position and the text.  All of a text's
    expressions stand in its own row, so nothing is shuffled.
    """
    each = F.flatten(F.transform(expressions(F.col("text")), lambda e, i: concepts_of(e, i, F.col("text"))))
    return rows.select("id", F.posexplode(F.array_distinct(each)).alias("rank", "concept")).select("id", F.col("rank").cast("long").alias("rank"), "concept", falling(start, step, least, F.col("rank")).alias("confidence"))


def _film(s, d) -> DataFrame:
    o = table(s, d, "orders")
    person = lambda n, t: F.struct(n.alias("Name"), t.alias("Type"))
    people = F.array(person(F.concat(F.lit(" Clerk "), F.col("o_custkey").cast("string")), F.when(F.col("o_orderstatus") == "F", "Director").otherwise("Actor")), person(F.lower("o_orderpriority"), F.when(F.col("o_orderstatus") == "P", "Writer").otherwise("producer")), person(F.col("o_orderstatus"), F.lit("Actress")))
    return o.select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("name"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("title"), F.array("o_orderpriority", "o_orderstatus").alias("genres"), people.alias("people"))


_RULES = lambda: [("name", T.key_concepts(F.col("p_name"))), ("type", direct_values(F.array("p_type", "p_name"), "list")), ("brand", direct_values(F.col("p_brand"), "text")), ("size", direct_values(F.col("p_size"), "number"))]
_RECORDS = """(SELECT rec, unnest(list_filter(keys, lambda x: x IS NOT NULL)) AS key FROM (
 SELECT 'o' || o_orderkey AS rec, ['Id', 'Name', 'Premiere_Date', CASE WHEN o_orderstatus = 'F' THEN 'ProductionYear' END, CASE WHEN o_orderstatus = 'P' THEN 'album' END] AS keys FROM orders
 UNION ALL SELECT 'p' || p_partkey, ['Title', CASE WHEN p_size > 20 THEN 'Author' END, CASE WHEN p_size < 30 THEN 'ISBN_13' END, CASE WHEN p_size > 45 THEN 'total_pages' END] FROM part
 UNION ALL SELECT 'c' || c_custkey, ['c_name', CASE WHEN c_acctbal > 0 THEN 'SeriesName' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'the_season' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'first_track' END, 'Date_Created'] FROM customer
 UNION ALL SELECT 's' || s_suppkey, ['s_name', CASE WHEN s_acctbal > 0 THEN 'Artist' END, CASE WHEN s_acctbal > 5000 THEN 'duration' END, CASE WHEN s_acctbal < 100 THEN 'EpisodeName' END] FROM supplier))"""
_PAT = "(SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{p}', {w}::DOUBLE, {i})" for i, (t, p, w) in enumerate(PATTERNS)) + ") v(media_type, pattern, weight, id))"
_ROLES = "(SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{p}', {w}::DOUBLE)" for r, p, w in ROLES) + ") v(role, pattern, weight))"
_FALLBACK = "SELECT rec, CASE WHEN greatest(" + ", ".join(t for t, _ in FALLBACK) + ") = 0 THEN 'movie' " + " ".join(f"WHEN {t} = greatest({', '.join(x for x, _ in FALLBACK)}) THEN '{t}'" for t, _ in FALLBACK) + f" END AS other FROM (SELECT rec, {', '.join(f'count(*) FILTER (regexp_matches(lower(key), {chr(39)}{p}{chr(39)})) AS {t}' for t, p in FALLBACK)} FROM {_RECORDS} GROUP BY 1)"
_TEXTS = """(SELECT 'o' || o_orderkey AS id, 'Ordered ' || strftime(o_orderdate, '%Y-%m-%d') || ' at 10:' || lpad((o_custkey % 60)::VARCHAR, 2, '0') || ', the ' || (o_custkey % 9 + 4) || 'th, due in ' || (o_custkey % 90) || ' days, style of the ' || year(o_orderdate) || 's, ' || CASE o_orderstatus WHEN 'F' THEN 'formerly of last year' WHEN 'O' THEN 'now and monthly' ELSE 'upcoming next month' END AS text FROM orders
 UNION ALL SELECT 'd' || doc_id, text FROM documents)"""


def _rule_sql(kind: str, pattern: str, value: str | None) -> str:
    own = f"'{value}'" if value else "regexp_replace(x, '^([0-9]{4})s$', '\\1')"
    return f"list_transform(regexp_extract_all(text, '{pattern}'), lambda x: {{'type': '{kind}', 'value': {own}, 'text': x}})"


_LIST = " || ".join(_rule_sql(*r) for r in EXPRESSIONS)
_FOUND = f"(SELECT id, text, unnest(range(0, len(l))) AS pos, unnest(l) AS e FROM (SELECT id, text, {_LIST} AS l FROM {_TEXTS}))"
_NOT_NULL = lambda items: f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
_ENTITY = _NOT_NULL(["lower(e.text)", *(f"CASE WHEN e.type = 'DATE' AND ({' OR '.join(f'contains(lower(e.text), {chr(39)}{w}{chr(39)})' for w in words)}) THEN '{c}' END" for c, words in FREQUENCY), "'temporal-' || lower(e.type)"])
_TAG = _NOT_NULL(["nullif(e.text, '')", "'temporal-' || lower(nullif(e.type, ''))", f"CASE WHEN e.value <> '' AND e.value NOT IN {VOID} THEN 'heideltime-value-' || e.value END", "CASE WHEN pos = 0 THEN 'heideltime-modifier-start' END"])
_YEAR = "regexp_extract(e.value, '([0-9]{4})', 1)"
_ANNOTATION = f"(['temporal-' || lower(e.type)] || CASE WHEN {_YEAR} <> '' THEN ['year-' || {_YEAR}, {_YEAR}[1:3] || '0s'] ELSE [] END || CASE " + " ".join(f"WHEN contains(e.value, '{r}') THEN {list(words)}" for r, words in REFERENCES) + " ELSE [] END || CASE WHEN lower(e.text) <> lower(text) THEN [lower(e.text)] ELSE [] END)"
_CONCEPTS = "(SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'period' WHEN '2-HIGH' THEN 'era' WHEN '3-MEDIUM' THEN 'event' ELSE 'date' END AS type, CASE o_orderstatus WHEN 'F' THEN 'period' WHEN 'O' THEN 'sequence' ELSE 'relationship' END AS category, CASE WHEN o_totalprice > 300000 THEN 'Historical ' WHEN o_totalprice < 50000 THEN 'seasonal ' ELSE 'plain ' END || lower(o_orderpriority) AS description, o_totalprice > 200000 AS implicit FROM orders)"


def _exploded_sql(concept: str, start: float, step: float, least: float) -> str:
    each = f"SELECT id, pos, unnest(range(0, len(l))) AS nth, unnest(l) AS concept FROM (SELECT id, pos, {concept} AS l FROM {_FOUND})"
    return f"SELECT id, rank, concept, round(greatest({start}::DOUBLE - rank * {step}::DOUBLE, {least}::DOUBLE), 6) AS confidence FROM (SELECT id, concept, row_number() OVER (PARTITION BY id ORDER BY min({{'p': pos, 'n': nth}})) - 1 AS rank FROM ({each}) GROUP BY 1, 2)"


_WHO = "[' Clerk ' || o_custkey, lower(o_orderpriority), o_orderstatus]"
_WHAT = "[CASE WHEN o_orderstatus = 'F' THEN 'Director' ELSE 'Actor' END, CASE WHEN o_orderstatus = 'P' THEN 'Writer' ELSE 'producer' END, 'Actress']"
_ROLE = lambda kinds: f"coalesce(array_to_string(list_filter(list_transform(range(1, 4), lambda i: CASE WHEN lower({_WHAT}[i]) IN {kinds} THEN trim(lower({_WHO}[i])) END), lambda x: x IS NOT NULL), ','), '')"
#: Expressions of I10 by the priority of an order, and their reference, the order's date.
_EXPRESSION = lambda: F.when(F.col("o_orderpriority") == "1-URGENT", "last year").when(F.col("o_orderpriority") == "2-HIGH", F.concat((F.col("o_custkey") % 90).cast("string"), F.lit(" days ago"))).when(F.col("o_orderpriority") == "3-MEDIUM", "next month").when(F.col("o_orderpriority") == "5-LOW", "In 3 weeks").otherwise(F.when(F.col("o_orderstatus") == "F", "2010s").when(F.col("o_orderstatus") == "O", "someday").otherwise("yesterday"))
_DAY = "CASE o_orderpriority WHEN '1-URGENT' THEN o_orderdate::DATE - INTERVAL 12 MONTH WHEN '2-HIGH' THEN o_orderdate::DATE - to_days((o_custkey % 90)::INT) WHEN '3-MEDIUM' THEN o_orderdate::DATE + INTERVAL 1 MONTH WHEN '5-LOW' THEN o_orderdate::DATE + INTERVAL 21 DAY ELSE CASE o_orderstatus WHEN 'F' THEN DATE '2010-01-01' WHEN 'P' THEN o_orderdate::DATE - INTERVAL 1 DAY END END"
_DAY_TYPE = lambda: F.when(F.col("o_orderstatus") == "F", "narrative").when(F.col("o_orderstatus") == "O", "news").otherwise("scientific")


def _film_rows(s, d):
    f = _film(s, d)
    a = content_analysis("movie", {n: F.col(n) for n in ("name", "title", "genres", "people")})
    out = f.select("o_orderkey", *(c.alias(n) for n, c in a.items()))
    joined = lambda c: F.array_join(c, ",")
    return out.select("o_orderkey", "title", joined(F.transform("genres", lambda g: F.concat(g["name"], F.lit(":"), g["confidence"].cast("string")))).alias("genres"), joined("people.creators").alias("creators"), joined("people.performers").alias("performers"))


QUERIES = {
    "e1_pattern_detection": lambda s, d: detect_by_patterns(_keys(s, d), rule_table(s, PATTERNS, "media_type", "pattern", "weight")),
    "e2_fallback_detection": lambda s, d: detect_by_fallback(_keys(s, d)),
    "e3_presence_detection": lambda s, d: records(s, d).select("rec", detect_by_presence(F.transform("keys", lambda k: F.lower(k))).alias("media_type")),
    "e4_standard_types": lambda s, d: table(s, d, "part").groupBy(standard_type(F.when(F.col("p_size") > 25, "Book").when(F.col("p_size") > 10, "TV_Show").otherwise(F.col("p_type"))).alias("media_type")).agg(F.count("*").alias("n")),
    "e5_field_roles": lambda s, d: field_roles(_keys(s, d)),
    "f1_rule_concepts": lambda s, d: rule_concepts(table(s, d, "part"), "p_partkey", _RULES()).withColumn("rank", F.col("rank").cast("long")),
    "f2_direct_values": lambda s, d: _film(s, d).select("o_orderkey", F.array_join(direct_values(F.col("people"), "records", 2), ",").alias("names"), F.array_join(direct_values(F.col("title"), "text"), ",").alias("title")),
    "f4_content_analysis": _film_rows,
    "f5_people_split": lambda s, d: _film(s, d).select("o_orderkey", people_split(F.col("people"), CREATORS["tv_show"], PERFORMERS["tv_show"]).alias("x")).select("o_orderkey", F.array_join("x.creators", ",").alias("creators"), F.array_join("x.performers", ",").alias("performers")),
    "f6_genres": lambda s, d: _film(s, d).select("o_orderkey", F.explode(genres(F.col("genres"))).alias("g")).groupBy("g.name", "g.confidence").agg(F.count("*").alias("n")),
    "f7_simple_keywords": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(simple_keywords(F.col("text"), F.col("lang")), " ").alias("words")),
    "f8_technical": lambda s, d: table(s, d, "part").select("p_partkey", technical(F.create_map(F.lit("size"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), F.lit("brand"), F.col("p_brand"))).alias("m")).select("p_partkey", F.array_join(F.map_keys("m"), ",").alias("keys")),
    "i1_temporal_flags": lambda s, d: texts(s, d).select("id", *(c.alias(n) for c, n in zip(temporal_flag(F.col("text")), ("temporal", "confidence")))),
    "i2_expressions": lambda s, d: found(s, d).select("id", F.col("pos").cast("long").alias("pos"), "e.type", "e.value", "e.text"),
    "i2_entity_concepts": lambda s, d: text_concepts(texts(s, d), lambda e, i, t: entity_concepts(e), 0.9, 0.1, 0.3),
    "i3_tag_concepts": lambda s, d: text_concepts(texts(s, d), lambda e, i, t: tag_concepts(e, F.when(i == 0, "START")), 0.95, 0.05, 0.7),
    "i4_timex_tags": lambda s, d: _tagged_texts(s, d).select("id", F.posexplode(timex_tags(F.col("text"))).alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), "x.type", "x.value", "x.text"),
    "i5_temporal_concepts": lambda s, d: text_concepts(texts(s, d), lambda e, i, t: annotation_concepts(e, t), 0.95, 0.03, 0.8),
    "i6_dates_only": lambda s, d: found(s, d).where("e.type = 'DATE'").select("id", "e.value"),
    "i7_time_ranges": lambda s, d: found(s, d).agg(F.count_if(is_range(F.col("e"))).alias("ranges"), *(F.count_if(F.col("e.type") == t).alias(t.lower()) for t in ("DURATION", "SET", "TIME")), F.count("*").alias("total")),
    "i8_periods": lambda s, d: concepts(s, d).where(is_period(F.col("type"), F.col("description"))).select("o_orderkey", "type", "description"),
    "i9_categories": lambda s, d: category_counts(concepts(s, d)),
    "i10_normalised_dates": lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_format(normalised(_EXPRESSION(), F.to_date("o_orderdate")), "yyyy-MM-dd").alias("date")),
    "i11_document_time": lambda s, d: with_document_time(table(s, d, "orders").withColumn("x", _EXPRESSION()), "x", "o_orderdate", _DAY_TYPE()).select("o_orderkey", "document_type", F.date_format("document_creation_time", "yyyy-MM-dd").alias("created"), F.date_format("date", "yyyy-MM-dd").alias("date")),
}
ORACLES = {
    "e1_pattern_detection": f"WITH k AS {_RECORDS}, h AS (SELECT DISTINCT rec, media_type, id, weight FROM k JOIN {_PAT} ON regexp_matches(lower(key), '^(?:' || pattern || ')')), s AS (SELECT rec, media_type, round(sum(weight), 6) AS score FROM h GROUP BY 1, 2), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY rec ORDER BY score DESC, list_position({list(TYPES)}, media_type)) = 1) SELECT rec, coalesce(media_type, other) AS media_type, coalesce(score, 0.0) AS score FROM ({_FALLBACK}) LEFT JOIN b USING (rec)",
    "e2_fallback_detection": f"SELECT rec, other AS media_type FROM ({_FALLBACK})",
    "e3_presence_detection": f"SELECT rec, CASE WHEN list_has_any(k, ['production_year', 'movie_id']) THEN 'movie' WHEN list_has_any(k, ['album', 'artist']) THEN 'music' WHEN list_has_any(k, ['isbn', 'author']) THEN 'book' WHEN list_has_any(k, ['series_name', 'episode']) THEN 'tv_show' ELSE 'movie' END AS media_type FROM (SELECT rec, list(lower(key)) AS k FROM {_RECORDS} GROUP BY 1)",
    "e4_standard_types": "SELECT CASE WHEN p_size > 25 THEN 'book' WHEN p_size > 10 THEN 'tv_show' ELSE 'movie' END AS media_type, count(*) AS n FROM part GROUP BY 1",
    "e5_field_roles": f"SELECT key, role, max(weight) AS weight FROM (SELECT DISTINCT key FROM {_RECORDS}) JOIN {_ROLES} ON regexp_matches(lower(key), pattern) GROUP BY 1, 2",
    "f1_rule_concepts": f"SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY min({{'r': r, 'p': pos}})) AS rank, concept FROM (SELECT p_partkey, 0 AS r, pos, keyword AS concept FROM ({concepts_sql('p_partkey', 'p_name', 'part')}) UNION ALL SELECT p_partkey, 1, unnest([0, 1]), unnest([lower(p_type), lower(p_name)]) FROM part UNION ALL SELECT p_partkey, 2, 0, lower(p_brand) FROM part) GROUP BY p_partkey, concept QUALIFY rank <= 15",
    "f2_direct_values": f"SELECT o_orderkey, 'clerk ' || o_custkey || ',' || lower(o_orderpriority) AS names, CASE WHEN o_orderstatus <> 'O' THEN lower(o_orderpriority) ELSE '' END AS title FROM orders",
    "f4_content_analysis": f"SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 100000 THEN 'Order ' || o_orderkey END, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END, 'Unknown Title') AS title, o_orderpriority || ':1.0,' || o_orderstatus || ':1.0' AS genres, {_ROLE(CREATORS['movie'])} AS creators, {_ROLE(PERFORMERS['movie'])} AS performers FROM orders",
    "f5_people_split": f"SELECT o_orderkey, {_ROLE(CREATORS['tv_show'])} AS creators, {_ROLE(PERFORMERS['tv_show'])} AS performers FROM orders",
    "f6_genres": "SELECT name, 1.0::DOUBLE AS confidence, count(*) AS n FROM (SELECT unnest([o_orderpriority, o_orderstatus]) AS name FROM orders) GROUP BY 1",
    "f7_simple_keywords": "SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text || ' ' || lang), '\\s+'), lambda w: length(w) > 3)[1:10], ' ') AS words FROM documents",
    "f8_technical": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'size,brand' ELSE 'brand' END AS keys FROM part",
    "i1_temporal_flags": f"SELECT id, h AS temporal, CASE WHEN h THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM (SELECT id, regexp_matches(text, '\\b[0-9]{{4}}s?\\b') AS h FROM {_TEXTS})",
    "i2_expressions": f"SELECT id, pos, e.type AS type, e.value AS value, e.text AS text FROM {_FOUND}",
    "i2_entity_concepts": _exploded_sql(_ENTITY, 0.9, 0.1, 0.3),
    "i3_tag_concepts": _exploded_sql(_TAG, 0.95, 0.05, 0.7),
    "i4_timex_tags": f"SELECT id, pos, e.type AS type, e.value AS value, e.text AS text FROM {_FOUND}",
    "i5_temporal_concepts": _exploded_sql(_ANNOTATION, 0.95, 0.03, 0.8),
    "i6_dates_only": f"SELECT id, e.value AS value FROM {_FOUND} WHERE e.type = 'DATE'",
    "i7_time_ranges": f"SELECT count(*) FILTER (e.type IN ('DURATION', 'SET', 'TIME') OR contains(lower(e.value), 'range')) AS ranges, count(*) FILTER (e.type = 'DURATION') AS duration, count(*) FILTER (e.type = 'SET') AS set, count(*) FILTER (e.type = 'TIME') AS time, count(*) AS total FROM {_FOUND}",
    "i8_periods": f"SELECT o_orderkey, type, description FROM {_CONCEPTS} WHERE type IN ('period', 'era', 'timeframe') OR regexp_matches(lower(description), '{'|'.join(PERIODS)}')",
    "i9_categories": f"SELECT count(*) AS total, count(*) FILTER (category = 'period') AS periods, count(*) FILTER (category = 'sequence') AS sequences, count(*) FILTER (category = 'relationship') AS relationships, count(*) FILTER (implicit) AS implicit FROM {_CONCEPTS}",
    "i10_normalised_dates": f"SELECT o_orderkey, strftime({_DAY}, '%Y-%m-%d') AS date FROM orders",
    "i11_document_time": f"SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'narrative' WHEN 'O' THEN 'news' ELSE 'scientific' END AS document_type, CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS created, CASE WHEN o_orderstatus <> 'F' OR o_orderpriority = '4-NOT SPECIFIED' THEN strftime({_DAY}, '%Y-%m-%d') END AS date FROM orders",
}
