"""Token ids of whole texts with a public tokenizer file, fast for repeated words.

Ids come from the tokenizers library alone. A text of Latin-1 letters is cut at white space, and words at
the places where the tokenizer's own pre-tokenizer cuts them; the ids of pieces and of short words are
remembered. Any other text goes to
the library whole, and so does every text if the tokenizer's file says anything else of case, space or cuts. Memory is bounded: at CACHE entries the long pieces, which come up again the
least, are forgotten.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

from spanloom.llm.common import CACHES

CACHE, SHORT, WORD = 1_000_000, 6, 10
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
#: The pre-tokenizer's pattern, restricted to lower-case Latin-1.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s{LETTERS}0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Control characters that Python alone counts as space.
SEPARATORS = b"\x1c\x1d\x1e\x1f"


#: What a tokenizer's file has to say for words to be looked up one by one.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_words(definition: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space and cuts words as PIECES does; any other reads texts whole."""
    d = json.loads(definition)
    steps = [x.get("type") for x in (d.get("normalizer") or {}).get("normalizers", [])]
    cuts = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return steps == NORMALIZERS and bool(cuts) and cuts[0].get("pattern") == {"Regex": SPLIT} and cuts[0].get("behavior") == "Removed"


def simple(text: str) -> bool:
    """Only Latin-1, no special token and none of the separators."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text and len(data.translate(None, SEPARATORS)) == len(data)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known(dict[str, bytes]):
    """Ids of pieces and short words; those of other words come from their pieces."""

    def __init__(self, tokenizer):
        self.encode = tokenizer.encode

    def __missing__(self, word: str) -> bytes:
        pieces = PIECES.findall(word)
        if len(pieces) == 1:
            ids = array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            ids = b"".join([self[p] for p in pieces])
            if len(word) > WORD:
                return ids
        if len(self) >= CACHE:
            short = {p: i for p, i in self.items() if len(p) <= SHORT}
            self.clear()
            self.update(short if len(short) < CACHE // 2 else {})
        self[word] = ids
        return ids


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process, so that it starts with the pieces it knows."""
    return Encoder(path)


CACHES.append(encoder.cache_clear)


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.tokenizer)
        self.by_words = cuts_at_words(self.tokenizer.to_str())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, t.lower().split())) if self.by_words and simple(t) else self.whole(t) for t in texts]
