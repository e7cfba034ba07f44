"""Helpers for the few places where Python runs inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Send a module's functions to the executors by value, so that they need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def once(key: Hashable, make: Callable, most: int = 4):
    """A value built once per worker process; the oldest of more than ``most`` values goes.

    The first part of a key is its kind. Values of other kinds go when one is built: a worker outlives the stage that
    needed them, and what every stage before it has learned would add up.
    """
    held = sys.__dict__.setdefault("_meshlark_held", {})
    if key not in held:
        kind = lambda k: k[0] if isinstance(k, tuple) else k
        for other in [k for k in held if kind(k) != kind(key)]:
            del held[other]
        while len(held) >= most:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


ship(__name__)
