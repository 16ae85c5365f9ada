"""Splitting texts into the pieces that byte-level tokenizers merge separately, and remembering what pieces became."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import regex

from tidemark.llm.columns import blocks

#: Characters that are encoded at a time, and pieces in one generation of a worker's memory.
BLOCK_CHARS, PIECES = 1 << 20, 400_000


def _latin(pattern: str) -> str:
    """The pattern with explicit classes, for texts of Latin-1 characters alone."""
    chars = [chr(i) for i in range(256)]
    of = lambda kind: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind)
    space = "".join(re.escape(c) for c in chars if regex.match(r"\p{White_Space}", c))
    for name, inner in ((r"\p{L}", of("L")), (r"\p{N}", of("N")), (r"\s", space)):
        # Inside a class the characters themselves stand, elsewhere a class of them.
        pattern = re.sub(r"\[\^?[^\]]*\]", lambda m, n=name, i=inner: m[0].replace(n, i), pattern).replace(name, f"[{inner}]")
    return pattern.replace(r"\S", f"[^{space}]")


class Splitter:
    """All matches of a pattern, where white space is what Unicode calls so. Latin-1 texts take a quicker engine."""

    def __init__(self, pattern: str) -> None:
        self.any = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.latin = re.compile(_latin(pattern)).findall

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(text)
        return self.latin(text)


class Remembering:
    """Encodes texts by their pieces and remembers two generations of them.

    A generation that is full becomes the old one, and the old one goes. A piece found in the old one moves to the new one, so
    common pieces stay and memory is bounded by twice ``PIECES``, whatever the texts hold.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], apart: Sequence[str] = ()) -> None:
        """``apart`` are literals that are pieces of their own wherever they stand; the text between them is split by itself."""
        self.by_pattern, self.encode_pieces, self.apart = Splitter(pattern), encode, sorted(apart, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.apart)) + ")").split
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        if not any(literal in text for literal in self.apart):
            return self.by_pattern(text)
        # Every second part is one of the literals.
        return [p for i, part in enumerate(self.cut(text)) for p in ([part] if i % 2 else self.by_pattern(part))]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Per text the joined codes of its pieces."""
        for part in blocks([len(t) for t in texts], BLOCK_CHARS):
            if len(self.known) > PIECES:
                self.known, self.old = {}, self.known
            get, codes, gaps, new = self.known.get, [], [], {}
            for text in texts[part]:
                pieces = self.split(text)
                found = list(map(get, pieces))
                if None in found:
                    # Most texts hold something new: only those places are filled in later, the rest is looked up once.
                    places = [i for i, code in enumerate(found) if code is None]
                    lacking = [pieces[i] for i in places]
                    gaps.append((len(codes), found, places, lacking))
                    new.update(dict.fromkeys(lacking))
                    codes.append(b"")
                else:
                    codes.append(b"".join(found))
            if new:
                self.known.update((p, self.old[p]) for p in new if p in self.old)
                unknown = [p for p in new if p not in self.old]
                self.known.update(zip(unknown, self.encode_pieces(unknown), strict=True))
                for i, found, places, lacking in gaps:
                    for place, code in zip(places, map(get, lacking), strict=True):
                        found[place] = code
                    codes[i] = b"".join(found)
            yield from codes
