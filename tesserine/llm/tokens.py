"""Token ids of whole texts by the tokenizers library, a piece at a time.

Both vocabularies split a text before any space or line feed that stands alone
between two other characters, so the ids of a text are those of its pieces
between such places, one after another.  Pieces recur, so each is encoded by the
library once for a worker process and looked up after that.  A text with a piece
of which that isn't sure (white space next to white space) goes to the library
as a whole, unless the vocabulary drops white space anyway.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

#: Pieces that a worker process remembers; beyond it, only the short ones are kept, or none if those are more than half of it.
REMEMBERED, SHORT = 600_000, 7
#: Texts whose new pieces go to the library together.
TOGETHER = 64

#: The character that byte-level vocabularies use for each byte: itself where it prints, else the next from 256 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINT)}
SPACE = chr(BYTES[32])

#: Latin letters that stay letters when they are normalised (not U+0130), then ASCII marks; not the apostrophe, which may belong to a contraction.
MARKED = re.compile(r"(\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]+)")

_encoders: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids as bytes.

    Strings of the vocabulary's special tokens in a text become those tokens, as
    the library does it, or with special_as_text ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        #: Strings that a text must not hold to be taken in pieces.
        self.special = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.feed = self._library(["\n"])[0]
        self.drops_space = not self.feed
        self.marks: dict[str, bytes] = {}  # ids of runs of marks that follow a word
        #: Ids of pieces, with the space or line feed before them; a space is not part of the key.
        self.known: dict[str, bytes | bool] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> None:
        """Learns pieces; a run of Latin letters is one word, which the library's model takes as it is."""
        tokenize, known, other = self.library.model.tokenize, self.known, []
        before = "" if self.drops_space else SPACE
        for p in pieces:
            if p.isalpha() and (not self.drops_space or p.islower()):
                if p.isascii():  # its bytes stand for themselves
                    known[p] = array("I", [x.id for x in tokenize(before + p)]).tobytes()
                    continue
                if max(p) <= "\xff":
                    known[p] = array("I", [x.id for x in tokenize(before + p.encode().decode("latin-1").translate(BYTES))]).tobytes()
                    continue
            other.append(p)
        if other:
            for p, ids in zip(other, self._library([p[1:] if p[:1] == "\n" or self.drops_space and p[:1] == " " else p if self.drops_space else " " + p for p in other])):
                known[p] = self.feed + ids if p[:1] == "\n" else ids

    def _learn(self, pieces: set[str]) -> None:
        known = self.known
        if len(known) + len(pieces) > REMEMBERED:
            short = {p: ids for p, ids in known.items() if len(p) <= SHORT}
            self.known = known = short if len(short) < REMEMBERED // 2 else {}
        whole, marked = [], []
        for p in pieces:
            if p.isalpha():
                whole.append(p)
            elif split := MARKED.fullmatch(p):  # letters and marks are separate words
                marked.append((p, *split.groups()))
            elif not self.drops_space and (not (core := p[1:] if p[:1] == "\n" else p) or core[0].isspace() or core[-1].isspace()):
                known[p] = False
            else:
                whole.append(p)
        whole += {base for _, base, _ in marked if base not in known and base not in pieces}
        self._encode(whole)
        for p, base, marks in marked:
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[marks] = self._library([marks])[0]
            known[p] = known[base] + self.marks[marks]

    def _pieces(self, text: str) -> list[str]:
        if self.drops_space:  # such a vocabulary has lower case only
            try:
                text.encode("latin-1")  # letters there change case one by one
                return text.lower().replace("\n", " ").split(" ")
            except UnicodeEncodeError:
                return text.split(" ")
        return ("\n" + text.replace("\n", " \n")).split(" ")

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, whatever its length; none for a null or empty text."""
        skip = len(self.feed)
        for k in range(0, len(texts), TOGETHER):
            group, new = [], set()
            for text in texts[k : k + TOGETHER]:
                if text and self.special and any(t in text for t in self.special):
                    group.append((text, [], [False], []))
                    continue
                pieces = self._pieces(text or "")
                ids = list(map(self.known.get, pieces))
                missing = [i for i, v in enumerate(ids) if v is None] if None in ids else []
                new.update([pieces[i] for i in missing])
                group.append((text, pieces, ids, missing))
            if new:
                self._learn(new)
            for text, pieces, ids, missing in group:
                for i in missing:
                    ids[i] = self.known[pieces[i]]
                if not text:
                    yield b""
                elif False in ids:  # a piece that isn't sure
                    yield self._library([text])[0]
                else:
                    yield b"".join(ids)[skip:]


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of this worker process."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]


def forget() -> None:
    """Drops this worker process's encoders and what they have learned."""
    _encoders.clear()


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
