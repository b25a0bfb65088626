"""Memory of long-lived Python workers, which live from stage to stage."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_HELD: list[dict] = []


def held(cache: dict) -> dict:
    """Remember a cache of this worker, to be emptied when work of another kind begins."""
    _HELD.append(cache)
    return cache


def release() -> None:
    """Empty the caches, and give back to the system what is no longer used, as far as its C library can."""
    for cache in _HELD:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass
