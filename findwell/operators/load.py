"""Load measurement: a weighted mix of queries, their latencies and their throughput."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

#: Shares of single words, several words, phrases and restricted words in the mix.
SHARES = (0.40, 0.30, 0.15, 0.15)


def mixed(kinds: list[list[str]], n: int, shares: tuple[float, ...] = SHARES, seed: int = 42) -> list[str]:
    """``n`` queries, of each kind about its share; the same for the same seed."""
    r = random.Random(seed)
    return [r.choice(kinds[r.choices(range(len(kinds)), shares)[0]]) for _ in range(n)]


def percentile(values: list[float], share: float) -> float:
    """The value at place floor(n * share) of the sorted values, at most the last."""
    ordered = sorted(values)
    return ordered[min(int(len(ordered) * share), len(ordered) - 1)]


def measure(run: Callable[[str], object], queries: list[str], warm_up: int = 0, threads: int = 1) -> dict[str, float]:
    """Milliseconds at p50, p95, p99 and on average, and queries a second, of ``queries`` asked one
    after the other or by so many threads."""
    for q in queries[:warm_up]:
        run(q)

    def one(q: str) -> float:
        began = time.perf_counter()
        run(q)
        return (time.perf_counter() - began) * 1000

    began = time.perf_counter()
    if threads == 1:
        took = [one(q) for q in queries]
    else:
        with ThreadPoolExecutor(threads) as pool:
            took = list(pool.map(one, queries))
    wall = time.perf_counter() - began
    return {"n": len(took), "p50_ms": round(percentile(took, 0.5), 1), "p95_ms": round(percentile(took, 0.95), 1), "p99_ms": round(percentile(took, 0.99), 1), "mean_ms": round(sum(took) / len(took), 1), "qps": round(len(took) / wall, 2)}
