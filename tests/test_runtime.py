"""What operators leave behind in the driver."""

import ctypes
import os
from pathlib import Path

from depthlane.runtime import materialise, trim


def resident() -> float:
    """MB of this process."""
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_materialise_returns_freed_memory(spark):
    """Freed blocks below one in use stay with the C library until it is told to return them."""
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
    blocks = [libc.malloc(60_000) for _ in range(3000)]
    for b in blocks:
        ctypes.memset(b, 1, 60_000)
    last = libc.malloc(60_000)
    for b in blocks:
        libc.free(b)
    before = resident()
    assert sorted(r["id"] for r in materialise(spark.range(3), "trim").collect()) == [0, 1, 2]
    assert before - resident() > 100
    libc.free(last)


def test_the_jvm_is_asked_too(spark):
    assert trim(spark)
