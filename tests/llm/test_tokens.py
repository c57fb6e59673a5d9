"""Ids of whole texts against the library's own, read from the file anew."""

import random

import numpy as np
import pytest
from tesserine.llm import tokens
from tesserine.llm.tokens import Encoder, vocabulary
from tokenizers import Tokenizer

TEXTS = ["a b", "", None, " x", "a  b", "a\nb.\n\nc", "x.\n", "é. à, foo,\nBar. baz", "<|endoftext|> a", "a <|endoftext|> b", "a<|startoftext|>b", "it's, 12, a.b", "́ a\ta", "  x y z", "日本 語。 x", "A,, b.. C.,", "word### x%%% Y!! a_b don't. can't!! x's z'### q-r (s) t2! naïve*** ß,", "ONE!! TWO!!\nThree&&& four", "İ.", "İ. İ x", "क़. a"]
PARTS = ["a", "b", "Z", "é", "İ", "ß", "Σ", "ς", "ö", "क़", "中", "́", "̇", "²", "½", "Ⅷ", "ª", "µ", "'", "'s", "'t", "’", " ", "  ", "\n", "\t", "\r", "\xa0", " ", "\x1c", "\x85", ".", ",", "!", "-", "_", "<|endoftext|>", "<|startoftext|>", "<|", "0", "12", "٣", "<", "̸", "=", "ﬁ", "ŉ", "ǰ", "Ａ", "the", "word", "...", "(", ")", "‍", "🙂", "\x00", "שׁ", "й"]


def texts(n):
    r = random.Random(8)
    for _ in range(n):
        yield "".join(r.choices(PARTS, k=r.randint(1, 9)))
        yield "".join(chr(r.choice((r.randint(1, 0x250), r.randint(1, 0x2FFF), r.randint(32, 126)))) for _ in range(r.randint(1, 12)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name, monkeypatch):
    fresh = Tokenizer.from_file(vocabulary(name))
    ids = lambda t: np.array(fresh.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    given = [*TEXTS, *texts(50_000)]
    want = list(map(ids, given))
    assert list(Encoder(vocabulary(name)).encode(given)) == want
    monkeypatch.setattr(tokens, "REMEMBERED", 500)  # pieces are forgotten and learned again
    e = Encoder(vocabulary(name))
    assert list(e.encode(given[:5000])) == want[:5000] and len(e.known) < 2500
    fresh.encode_special_tokens = True
    assert list(Encoder(vocabulary(name), special_as_text=True).encode(TEXTS)) == list(map(ids, TEXTS))
