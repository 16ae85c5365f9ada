"""Words of whole texts as numpy arrays of small numbers, in blocks of bounded size."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Bytes of a text that are split at once.
SLICE = 1 << 20


def slices(raw: bytes, inside: re.Pattern, most: int = SLICE) -> Iterator[bytes]:
    """``raw`` in parts of about ``most`` bytes; a part ends behind a whole run of what ``inside`` matches."""
    at = 0
    while len(raw) - at > most:
        run = inside.match(raw, at + most)
        end = run.end() if run else at + most
        yield raw[at:end]
        at = end
    yield raw[at:]


def numbering() -> defaultdict:
    """A dictionary that numbers words from 0 in the order in which they are met."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def numbered(raw: bytes, word: re.Pattern, inside: re.Pattern, numbers: defaultdict) -> np.ndarray:
    """The words of one text by number. The list of its words never holds more than a slice."""
    parts = []
    for part in slices(raw, inside):
        found = word.findall(part)
        parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions ``first[i] ... first[i] + size[i] - 1`` one after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
