"""Lexicon tags of whole texts by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import rule_table, table

#: Words and phrases of films by kind and group.
FILM = {
    "genre": {
        "action": ("action", "fighting", "combat", "martial arts", "chase", "explosion"),
        "adventure": ("adventure", "quest", "journey", "expedition", "exploration"),
        "animation": ("animated", "animation", "cartoon", "anime", "cgi"),
        "biography": ("biography", "biopic", "bio", "life story", "true story"),
        "comedy": ("comedy", "funny", "hilarious", "humor", "comedic", "laugh"),
        "crime": ("crime", "criminal", "heist", "robbery", "detective", "noir"),
        "documentary": ("documentary", "doc", "real", "factual", "non-fiction"),
        "drama": ("drama", "dramatic", "emotional", "serious", "character study"),
        "family": ("family", "kids", "children", "all ages", "wholesome"),
        "fantasy": ("fantasy", "magical", "magic", "wizard", "dragon", "fairy"),
        "horror": ("horror", "scary", "frightening", "zombie", "vampire", "ghost"),
        "mystery": ("mystery", "detective", "investigation", "clue", "whodunit"),
        "romance": ("romance", "romantic", "love", "relationship", "wedding"),
        "science_fiction": ("sci-fi", "science fiction", "futuristic", "space", "alien"),
        "thriller": ("thriller", "suspense", "tension", "psychological", "paranoia"),
        "war": ("war", "military", "battle", "combat", "soldier", "army"),
        "western": ("western", "cowboy", "frontier", "wild west", "gunslinger"),
    },
    "role": {"creator": ("director", "filmmaker", "directed by"), "performer": ("actor", "actress", "star", "starring", "featuring", "with")},
    "quality": {"positive": ("good", "great", "excellent", "amazing", "best", "acclaimed"), "negative": ("bad", "terrible", "worst", "awful", "low quality"), "rating": ("rated", "pg", "pg-13", "r", "nc-17", "unrated")},
    "temporal": {"decade": ("80s", "90s", "2000s", "2010s", "eighties", "nineties"), "era": ("classic", "old", "vintage", "recent", "new", "modern")},
    "theme": {"psychological": ("mind", "psycho", "mental", "brain", "consciousness"), "dark": ("dark", "grim", "noir", "bleak", "sinister"), "epic": ("epic", "grand", "massive", "huge", "sweeping"), "indie": ("indie", "independent", "art house", "arthouse")},
}
#: Those of books.
BOOK = {
    "genre": {
        "fiction": ("novel", "story", "fiction", "narrative"),
        "non_fiction": ("biography", "history", "science", "memoir", "essay"),
        "mystery": ("mystery", "detective", "crime", "thriller", "suspense"),
        "romance": ("romance", "love story", "romantic", "passion"),
        "fantasy": ("fantasy", "magic", "magical", "wizard", "dragon"),
        "science_fiction": ("sci-fi", "science fiction", "futuristic", "space"),
        "horror": ("horror", "scary", "ghost", "vampire", "supernatural"),
        "young_adult": ("young adult", "ya", "teen", "teenager"),
        "children": ("children", "kids", "picture book", "early reader"),
        "poetry": ("poetry", "poems", "verse", "haiku", "sonnet"),
        "drama": ("drama", "play", "theater", "theatrical"),
        "self_help": ("self-help", "motivational", "personal development"),
    },
    "role": {"creator": ("author", "writer", "novelist", "poet"), "performer": ("narrator", "reader", "voice actor")},
    "quality": {"positive": ("bestseller", "award-winning", "acclaimed", "classic"), "negative": ("poorly written", "bad reviews"), "rating": ("age appropriate", "mature content", "explicit")},
    "temporal": {"period": ("victorian", "medieval", "renaissance", "modern", "contemporary"), "publication": ("recently published", "new release", "classic", "vintage")},
    "theme": {"literary": ("literary", "literature", "prose", "narrative"), "historical": ("historical", "period", "era", "ancient"), "philosophical": ("philosophy", "meaning", "existence", "ethics")},
}
#: Those of music.
MUSIC = {
    "genre": {
        "rock": ("rock", "guitar", "drums", "electric"),
        "pop": ("pop", "popular", "catchy", "mainstream"),
        "hip_hop": ("hip hop", "rap", "beats", "rhymes"),
        "electronic": ("electronic", "edm", "synthesizer", "techno"),
        "classical": ("classical", "orchestra", "symphony", "opera"),
        "jazz": ("jazz", "improvisation", "swing", "blues"),
        "country": ("country", "folk", "acoustic", "rural"),
        "r_and_b": ("r&b", "soul", "rhythm and blues", "vocals"),
        "metal": ("metal", "heavy", "aggressive", "distorted"),
        "reggae": ("reggae", "caribbean", "jamaica", "rastafarian"),
    },
    "role": {"creator": ("composer", "songwriter", "producer", "arranger"), "performer": ("artist", "musician", "singer", "vocalist", "band")},
    "quality": {"positive": ("chart-topping", "platinum", "gold", "grammy-winning"), "negative": ("poorly produced", "off-key"), "rating": ("explicit lyrics", "clean version", "radio edit")},
    "temporal": {"era": ("60s rock", "80s pop", "90s grunge", "2000s indie"), "period": ("golden age", "british invasion", "disco era")},
    "theme": {"emotional": ("love", "heartbreak", "joy", "sadness"), "social": ("protest", "political", "social justice", "revolution"), "party": ("dance", "club", "party", "celebration")},
}
#: Those of television.
TELEVISION = {
    "genre": {
        "drama": ("drama", "dramatic", "serious", "character-driven"),
        "comedy": ("comedy", "sitcom", "funny", "humorous"),
        "reality": ("reality", "documentary", "unscripted", "real life"),
        "news": ("news", "current events", "journalism", "reporting"),
        "talk_show": ("talk show", "interview", "discussion", "chat"),
        "game_show": ("game show", "competition", "contest", "quiz"),
        "soap_opera": ("soap opera", "melodrama", "continuing story"),
        "animated": ("animated", "cartoon", "animation"),
        "documentary": ("documentary", "educational", "informative"),
        "variety": ("variety", "entertainment", "musical", "comedy sketches"),
    },
    "role": {"creator": ("creator", "showrunner", "producer", "director"), "performer": ("actor", "actress", "host", "presenter")},
    "quality": {"positive": ("emmy-winning", "critically acclaimed", "popular"), "negative": ("cancelled", "poorly rated"), "rating": ("tv-ma", "tv-14", "tv-pg", "tv-g")},
    "temporal": {"era": ("golden age", "modern tv", "streaming era"), "season": ("current season", "new episodes", "season finale")},
    "theme": {"procedural": ("procedural", "case-of-the-week", "investigation"), "serialized": ("serialized", "continuing story", "mythology"), "anthology": ("anthology", "different stories", "standalone")},
}
#: Those of any other kind.
GENERIC = {
    "genre": {"entertainment": ("entertaining", "fun", "enjoyable"), "educational": ("educational", "informative", "learning"), "artistic": ("artistic", "creative", "expressive")},
    "role": {"creator": ("creator", "maker", "producer"), "performer": ("performer", "participant", "contributor")},
    "quality": {"positive": ("good", "excellent", "quality"), "negative": ("bad", "poor quality"), "rating": ("appropriate", "mature")},
    "temporal": {"era": ("recent", "old", "classic", "modern")},
    "theme": {"general": ("interesting", "engaging", "compelling")},
}
LEXICONS = {"movie": FILM, "book": BOOK, "music": MUSIC, "tv_show": TELEVISION, "generic": GENERIC}

#: Bytes of terms in one automaton, of text that it reads at a time, and of a lane of that.
MOST, PART, LANE = 1 << 20, 1 << 20, 1024
#: Bytes of words, and A-Z to a-z; all others separate words.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58], _FOLD[95], _FOLD[97:123], _FOLD[128:] = np.arange(48, 58), 95, np.arange(97, 123), np.arange(128, 256)
_FOLD[65:91] = _FOLD[97:123]


def entries(*media_types: str) -> list[tuple[str, str]]:
    """(tag, term) of the lexicons of media types, of all where none is named; a tag is type/kind/group."""
    return [(f"{m}/{kind}/{group}", term) for m in media_types or LEXICONS for kind, groups in LEXICONS[m].items() for group, terms in groups.items() for term in terms]


def plain(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts with one space between, before and after them, and where each text begins (one more: the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    data = _FOLD[np.frombuffer(b" ".join([b"", *texts]) + b" ", np.uint8)]
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 32) | (data[:-1] != 32)
    kept[at[:-1]] = True  # a text's own first space
    return data[kept], np.concatenate(([0], np.cumsum(kept)))[at]


class Automaton:
    """Goto and failure arrays over classes of bytes; terms are words with a space on both sides, so hits are whole words."""

    def __init__(self, terms: list[bytes]):
        words = [bytes(plain([t])[0]) for t in terms]
        letters = sorted({b for w in words for b in w})
        self.kind = np.zeros(256, np.int32)
        self.kind[letters] = np.arange(1, len(letters) + 1)
        self.width, self.longest = len(letters) + 1, max(map(len, words), default=1)
        go, ends = [[-1] * self.width], [[]]
        for n, w in enumerate(words):
            state = 0
            for b in w if w.strip() else b"":
                k = int(self.kind[b])
                if go[state][k] < 0:
                    go[state][k] = len(go)
                    go.append([-1] * self.width)
                    ends.append([])
                state = go[state][k]
            if state:
                ends[state].append(n)
        fail, queue = [0] * len(go), [0]
        for state in queue:  # breadth first: the failure state of a node is complete before the node is
            for k, child in enumerate(go[state]):
                if child < 0:
                    go[state][k] = go[fail[state]][k] if state else 0
                else:
                    fail[child] = go[fail[state]][k] if state else 0
                    ends[child] = ends[child] + ends[fail[child]]
                    queue.append(child)
        self.go = (np.array(go, np.int32) * self.width).ravel()  # a state is the place of its row
        self.count = np.array([len(e) for e in ends], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.hits = np.array([n for e in ends for n in e], np.int64)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End place and term of every occurrence; lanes of LANE bytes are read side by side, each from a term's length before it."""
        lead = self.longest
        lanes = -(-len(data) // LANE)
        padded = np.zeros(lead + lanes * LANE, np.int32)
        padded[lead : lead + len(data)] = self.kind[data]
        begin = np.arange(lanes) * LANE
        state = np.zeros(lanes, np.int32)
        seen = np.empty((LANE, lanes), np.int32)
        for k in range(lead + LANE):
            state = self.go[state + padded[begin + k]]
            if k >= lead:
                seen[k - lead] = state
        state = seen.T.ravel()[: len(data)] // self.width
        at = np.flatnonzero(self.count[state])
        state = state[at]
        n = self.count[state]
        own = np.repeat(self.first[state], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.hits[own]


def lexicon_tags(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """id, tag, n: how often a text holds a tag's terms as whole words, any separators between them, of A-Z in either case.

    lexicon: tag and term.  A term listed twice for a tag counts once, null and
    empty terms are left out.  Characters outside of ASCII are parts of words.
    Nulls have no tags, rows of one id count together.  An automaton holds at
    most `most` bytes of terms; a larger lexicon takes several, each over all
    texts.
    """
    spark = docs.sparkSession
    rows = lexicon.where("tag is not null and trim(term) <> ''").select("tag", F.lower("term").alias("term")).distinct()
    size = rows.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    parts = -(-size // most)
    found = None
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()
        terms = sorted({r.term for r in own})
        place = {t: n for n, t in enumerate(terms)}
        tags = sorted({r.tag for r in own})
        of_term: list[list[int]] = [[] for _ in terms]
        for r in own:
            of_term[place[r.term]].append(tags.index(r.tag))
        sent = spark.sparkContext.broadcast((Automaton([t.encode() for t in terms]), tags, of_term))
        some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(_tagging(sent), docs.select(F.col(id_col).alias("id"), F.lit("").alias("tag"), F.lit(0).cast("long").alias("n")).schema)
        found = some if found is None else found.union(some)
    if found is None:
        found = docs.select(F.col(id_col).alias("id"), F.lit("").alias("tag"), F.lit(0).cast("long").alias("n")).where(F.lit(False))
    return found.groupBy(F.col("id").alias(id_col), "tag").agg(F.sum("n").alias("n"))


def _tagging(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, tags, of_term = sent.value
        counts = np.array([len(t) for t in of_term], np.int64)
        first, flat = np.cumsum(counts) - counts, np.array([t for ts in of_term for t in ts], np.int64)
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            k = 0
            while k < len(texts):
                end, size = k, 0
                while end < len(texts) and (end == k or size + len(texts[end]) < PART):
                    size += len(texts[end])
                    end += 1
                data, at = plain(texts[k:end])
                places, terms = automaton.find(data)
                doc = np.repeat(np.searchsorted(at, places - 1, side="right") - 1, counts[terms])  # the space behind may be the next text's
                tag = flat[np.repeat(first[terms] - np.cumsum(counts[terms]) + counts[terms], counts[terms]) + np.arange(counts[terms].sum())]
                key, n = np.unique(doc * len(tags) + tag, return_counts=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k + key // len(tags))), pa.array([tags[t] for t in key % len(tags)], pa.string()), pa.array(n, pa.int64())], names=["id", "tag", "n"])
                k = end

    return run


_ROWS = ", ".join(f"('{t}', '{w}')" for t, w in entries())
_SPLIT = "list_filter(string_split_regex(lower({}), '[^0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
#: All runs of up to four words of whole texts against the words of terms.
_NEXT = ", ".join(f"lead(w, {k}) OVER d AS w{k}" for k in (1, 2, 3))
_PLACED = f"(SELECT doc_id, w, {_NEXT} FROM (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT doc_id, {_SPLIT.format('text')} AS l FROM documents)) WINDOW d AS (PARTITION BY doc_id ORDER BY p))"
_TERMS = f"(SELECT DISTINCT tag, array_to_string({_SPLIT.format('term')}, ' ') AS term FROM (VALUES {_ROWS}) v(tag, term))"
_ORACLE = f"SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, unnest([w, w || ' ' || w1, w || ' ' || w1 || ' ' || w2, w || ' ' || w1 || ' ' || w2 || ' ' || w3]) AS run FROM {_PLACED}) JOIN {_TERMS} ON run = term GROUP BY 1, 2"

QUERIES = {"f9_lexicon_tags": lambda s, d: lexicon_tags(table(s, d, "documents"), rule_table(s, entries(), "tag", "term"))}
ORACLES = {"f9_lexicon_tags": _ORACLE}
