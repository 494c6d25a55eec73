"""What a public tokenizer's vocabulary says about words: which are common, and which of them occur as names only."""

from __future__ import annotations

import base64
from pathlib import Path

TOKENIZERS = "/opt/tokenizers"
DEFAULT = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def tokenizer_path(name: str = DEFAULT[0]) -> str:
    return f"{TOKENIZERS}/{name}"


class Vocabulary:
    """``words``: words that are common in lower case, and the nouns that a language capitalises; ``plain``: these words
    unless they are much commoner with a capital.

    A frequent word is a token of its own behind a space, the commoner the lower its number. A name has a capital only, or
    nearly so. Where several vocabularies are given, the first is taken as the one of a language that capitalises names
    alone: what only the later ones hold with a capital may be a common noun.
    """

    _kept: dict[tuple[str, ...], Vocabulary] = {}

    def __init__(self, paths: tuple[str, ...] | None = None) -> None:
        tokens = [self._tokens(p) for p in paths or tuple(tokenizer_path(x) for x in DEFAULT)]
        lower = {w for t in tokens for w in t if w.islower()}
        known = {w: next(t for t in tokens if w in t or w.title() in t) for w in lower}  # the first that knows it, decides
        self.plain = frozenset(w for w, t in known.items() if w in t and 2 * t.get(w.title(), t[w]) >= t[w])
        first = {w.lower() for w in tokens[0]}
        self.words = frozenset(lower | {w.lower() for t in tokens[1:] for w in t if w.istitle()} - first)

    @staticmethod
    def _tokens(path: str) -> dict[str, int]:
        out = {}
        for line in Path(path).read_bytes().splitlines():
            raw, rank = line.split()
            raw = base64.b64decode(raw)
            if raw[:1] == b" ":
                word = raw[1:].decode("utf-8", "ignore")
                if len(word) > 2 and word.isalpha():
                    out[word] = int(rank)
        return out

    @classmethod
    def shared(cls, paths: tuple[str, ...] | None = None) -> Vocabulary:
        """One of each in a Python worker."""
        key = tuple(paths or ())
        if key not in cls._kept:
            cls._kept[key] = cls(paths)
        return cls._kept[key]
