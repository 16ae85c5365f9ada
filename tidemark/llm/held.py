"""What a worker process keeps from task to task."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_kept: dict[tuple, Any] = {}


def begin(owner: str) -> None:
    """A task of ``owner`` starts here: what other operators kept goes, so a worker never adds up all that it has served."""
    for key in [key for key in _kept if key[0] != owner]:
        del _kept[key]


def kept(owner: str, key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, kept for the next tasks of ``owner``, for two keys at most."""
    begin(owner)
    if (owner, *key) not in _kept:
        while len(_kept) > 1:
            del _kept[next(iter(_kept))]
        _kept[owner, *key] = make()
    return _kept[owner, *key]
