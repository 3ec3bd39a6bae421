"""Token ids of texts in Python tasks, through a per-worker memory of distinct pre-tokens.

BPE merges never cross a pre-token, so the ids of a text are the ids of its pre-tokens one after
another. A worker asks the tokenizers library once for each pre-token it has not met and keeps the
answer, up to a bound. Texts with characters outside Latin letters and ASCII, or with the string of
an added token, go to the library whole: its own normaliser, pre-tokenizer and special-token rules
hold there.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Pre-tokens that a worker remembers (about 200 bytes each). Beyond, answers are not kept.
REMEMBERED = 700_000

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \x85\xa0"
#: Beyond U+017F, and for capital dotted I (two characters in lower case), the library decides.
_OTHER = re.compile("[^\x00-įı-ſ]")
_APOSTROPHES = "'s|'t|'re|'ve|'m|'ll|'d"

#: How the two public files split text: fixed by their pre-tokenizers.
_BYTE_LEVEL = re.compile(f" ?[{_LETTER}]+|{_APOSTROPHES}| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
                         f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD_LEVEL = re.compile(f"[{_LETTER}]+|{_APOSTROPHES}|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class Pretokens:
    """Splits texts into pre-tokens and knows their ids; made once per worker and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lower = self.library.normalizer is not None
        self.pattern = _WORD_LEVEL if self.lower else _BYTE_LEVEL
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.known: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        """Whether the classes above split this text as the library does."""
        return (text.isascii() or not _OTHER.search(text)) and not self.special.search(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a plain text."""
        return self.pattern.findall(text.lower() if self.lower else text)

    def parts(self, text: str) -> list[str]:
        """Pre-tokens and special strings of any text: encoded one by one they have the ids of the whole."""
        if self.plain(text):
            return self.split(text)
        out, at = [], 0
        for m in [*self.special.finditer(text), None]:
            gap = text[at: m.start() if m else None]
            if self.lower:
                gap = self.library.normalizer.normalize_str(gap)
            out += [gap[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(gap)]
            if m:
                out.append(m[0])
                at = m.end()
        return out

    def sizes(self, parts: list[str]) -> list[int]:
        """How many ids each string has."""
        return [len(e.ids) for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def encode(self, strings: list[str]) -> list[bytes]:
        """The library's ids of each string as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as ``encode`` gives them."""
        known, out = self.known, []
        for text in texts:
            if not self.plain(text):
                out.append(self.encode([text])[0])
                continue
            parts = self.split(text)
            try:
                out.append(b"".join(map(known.__getitem__, parts)))
            except KeyError:
                new = [p for p in dict.fromkeys(parts) if p not in known]
                found = dict(zip(new, self.encode(new), strict=True))
                if len(known) < REMEMBERED:
                    known.update(found)
                    out.append(b"".join(map(known.__getitem__, parts)))
                else:
                    out.append(b"".join([known.get(p) or found.get(p, b"") for p in parts]))
        return out


@lru_cache(maxsize=2)
def pretokens(path: str) -> Pretokens:
    return Pretokens(path)
