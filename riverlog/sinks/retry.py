"""Repeated attempts with growing pauses."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from riverlog.model import require

Result = TypeVar("Result")


class RetriesExhausted(RuntimeError):
    """Every attempt failed; the last error is the cause."""


@dataclass(frozen=True)
class RetryPolicy:
    """``max_attempts`` counts the first try.  The pause before attempt k+2 is
    ``base_delay * multiplier**k`` seconds, at most ``max_delay`` if that is set."""

    max_attempts: int = 1
    base_delay: float = 0.1
    max_delay: float = 0.0
    multiplier: float = 2.0

    def __post_init__(self) -> None:
        require(self.max_attempts >= 1, f"retry: at least one attempt is needed, got {self.max_attempts}")

    def delay(self, failures: int) -> float:
        factor = self.multiplier if self.multiplier >= 1 else 2.0
        pause = self.base_delay * factor**failures
        return min(pause, self.max_delay) if self.max_delay > 0 else pause

    def run(self, action: Callable[[], Result], sleep: Callable[[float], None] = time.sleep) -> Result:
        for failures in range(self.max_attempts):
            try:
                return action()
            except Exception as error:  # noqa: BLE001 - any delivery failure is retried
                if failures + 1 == self.max_attempts:
                    raise RetriesExhausted(f"all {self.max_attempts} attempts exhausted: {error}") from error
            sleep(self.delay(failures))
        raise AssertionError("unreachable")
