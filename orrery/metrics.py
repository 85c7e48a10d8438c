"""Counters and phase times of an engine, as Prometheus text."""

from __future__ import annotations

import time
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

#: Upper bounds of the histograms' buckets, in seconds.
BUCKETS = (0.005, 0.02, 0.1, 0.5, 2.0, 10.0, 60.0, 600.0)


class Metrics:
    def __init__(self, prefix: str = "orrery"):
        self.prefix = prefix
        self.counters: Counter[str] = Counter()
        self.buckets: dict[str, list[int]] = {}
        self.seconds: Counter[str] = Counter()

    def add(self, name: str, n: int = 1) -> None:
        self.counters[name] += n

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Times what is inside, and counts an error if it raises."""
        began = time.perf_counter()
        try:
            yield
        except BaseException:
            self.add("errors")
            raise
        finally:
            took = time.perf_counter() - began
            self.buckets.setdefault(name, [0] * (len(BUCKETS) + 1))[bisect_left(BUCKETS, took)] += 1
            self.seconds[name] += took

    def prometheus(self) -> str:
        lines = []
        for name, n in sorted(self.counters.items()):
            lines += [f"# TYPE {self.prefix}_{name}_total counter", f"{self.prefix}_{name}_total {n}"]
        if self.buckets:
            lines.append(f"# TYPE {self.prefix}_phase_seconds histogram")
        for name, counts in sorted(self.buckets.items()):
            upto = 0
            for bound, n in zip([*map(str, BUCKETS), "+Inf"], counts, strict=True):
                upto += n
                lines.append(f'{self.prefix}_phase_seconds_bucket{{phase="{name}",le="{bound}"}} {upto}')
            lines += [f'{self.prefix}_phase_seconds_sum{{phase="{name}"}} {self.seconds[name]:.6f}', f'{self.prefix}_phase_seconds_count{{phase="{name}"}} {upto}']
        return "\n".join(lines) + "\n" if lines else ""
