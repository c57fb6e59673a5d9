"""Column expressions for text normalisation and keyword lists."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop list that the rule of key concepts names.
STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't",
    "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma",
    "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't",
    "won", "won't", "wouldn", "wouldn't",
)
#: Fixed value: what separates words.
DELIMITERS = r"[,.!?;:\s\-()]+"


def decomposed(text: str) -> str:
    """Text with accents folded and what isn't ASCII then left out, of a single string."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What each character of another script becomes: those that become one ASCII character, and those that become several."""
    found = {chr(c): t for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (t := decomposed(chr(c)))}
    return {c: t for c, t in found.items() if len(t) == 1}, {c: t for c, t in found.items() if len(t) > 1}


def _ranges(chars: dict[str, str]) -> str:
    """Characters in ascending order as ranges of a pattern's class, which takes far fewer comparisons than one by one."""
    ends = [c for c in chars if chr(ord(c) - 1) not in chars], [c for c in chars if chr(ord(c) + 1) not in chars]
    return "".join(f"{a}-{b}" for a, b in zip(*ends))


def to_ascii(text: Column) -> Column:
    """Text with accents folded and what isn't ASCII then left out.

    Each character decomposes by itself, as what decomposition reorders isn't
    ASCII, so no text leaves the JVM: the few kinds of characters in a text that
    become several are replaced one by one, the others translated.
    """
    one, many = _folds()
    wide = rf"([[^\x00-\x7F]&&[{_ranges(many)}]])"
    turns = F.str_to_map(F.lit("\n".join(f"{c}\t{t}" for c, t in many.items())), F.lit("\n"), F.lit("\t"))
    spread = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(wide), 1)), text, lambda t, c: F.replace(t, c, F.element_at(turns, c)))
    folded = F.translate(F.when(text.rlike(wide), spread).otherwise(text), "".join(one), "".join(one.values()))
    return F.when(is_ascii(text), text).otherwise(F.regexp_replace(folded, r"[^\x00-\x7F]+", ""))


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def analysis_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(to_ascii(text), r"\s+", " "))


def key_part(text: Column) -> Column:
    """A component of a cache key: lower case, words joined by single underscores."""
    kept = F.regexp_replace(F.lower(to_ascii(text)), r"[^a-z0-9\s\-_]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"[\s\-]+", "_"), "_+", "_"), "^_|_$", "")


def cache_key(kind: Column, field: Column, value: Column, context: Column) -> Column:
    return F.concat_ws(":", kind, key_part(field), key_part(value), key_part(context))


def fast_key_part(text: Column) -> Column:
    """The other variant of a key component: underscores go, hyphens stay."""
    kept = F.regexp_replace(to_ascii(F.lower(text)), r"[^a-z0-9\s\-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"\s+", "_"), "_+", "_"), "^_|_$", "")


def key_words(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct words of three letters or more in order, without stopwords and numbers."""
    words = F.split(F.lower(analysis_text(text)), DELIMITERS)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stopwords) & ~w.rlike("^[0-9]+$")))


def key_concepts(text: Column, most: int = 10, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The first `most` key words, the short list of a field."""
    return F.slice(key_words(text, stopwords), 1, most)


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def listed_concepts(text: Column, most: int = 10) -> Column:
    """Concepts of an answer text: split at commas or else lines, numbering, bullets and quotes removed."""
    body = F.regexp_replace(F.trim(text), r"(?i)^(?:concepts|keywords|answer|related terms):\s*", "")
    parts = F.when(body.contains(","), F.split(body, ",")).otherwise(F.split(body, "\n"))
    clean = F.transform(parts, lambda p: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^\s*(?:[0-9]+[.)]|[-*])\s*", ""), "[\"']", ""), r"\s+", " "))))
    return F.slice(F.filter(clean, lambda p: F.length(p) > 1), 1, most)


def uri_term(uri: Column) -> Column:
    """Term of an English concept URI, null for others."""
    term = F.regexp_extract(uri, "^/c/en/([^/]+)", 1)
    return F.when(term != "", F.translate(term, "_", " "))


#: What answers about time may begin with.
ANSWER_HEADS = ("Related temporal concepts:", "Temporal concepts:", "Concepts:", "Related terms:", "Here are", "The concepts are:")


def temporal_answer(text: Column, most: int = 10) -> Column:
    """Concepts of an answer about time: quoted strings if there are any (and a comma), else what commas or lines separate, cleaned."""
    body = F.trim(text)
    for head in ANSWER_HEADS:
        body = F.trim(F.regexp_replace(body, "(?i)^" + head, ""))
    quoted = F.regexp_extract_all(body, F.lit('"([^"]+)"'), 1)
    parts = F.when(body.contains(","), F.when(F.size(quoted) > 0, quoted).otherwise(F.split(body, ","))).otherwise(F.split(body, "\n"))

    def clean(c: Column) -> Column:
        for pattern, to in ((r"^\s+|\s+$", ""), ("^[\"']+|[\"']+$", ""), ("^[a-zA-Z]/", ""), (r"^[0-9]+\.?\s*", ""), (r"^[-•*]\s*", ""), (r"\s+", " ")):
            c = F.regexp_replace(c, pattern, to)
        return F.trim(F.lower(c))

    return F.slice(F.filter(F.transform(parts, clean), lambda c: F.length(c) > 1), 1, most)


def light_answer(text: Column, most: int = 10) -> Column:
    """Lines of an answer without spaces, then dashes, then stars around them."""
    around = lambda c, what: F.regexp_replace(c, f"^{what}+|{what}+$", "")
    clean = lambda c: around(around(around(around(c, r"\s"), "-"), r"\*"), r"\s")
    return F.slice(F.filter(F.transform(F.split(text, "\n"), clean), lambda c: F.length(c) > 1), 1, most)
