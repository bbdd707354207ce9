"""One budget of requests and tokens per minute for all tasks of an inference run."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any


def prompt_tokens(row: Mapping[str, Any]) -> float:
    """A usual estimate: a token for each four characters of a row's inputs."""
    return len(str([*row.values()])) / 4


@dataclass(frozen=True)
class Budget:
    """What a service allows the whole run, whose rows are dealt to a fixed number of lanes.

    ``tokens`` estimates the tokens of a row, ``reply_tokens`` is added for its reply. No more lanes than the cluster has cores work
    at a time, so more lanes leave a part of the budget unused.
    """

    requests_per_minute: float
    tokens_per_minute: float | None = None
    lanes: int = 8
    tokens: Callable[[Mapping[str, Any]], float] = prompt_tokens
    reply_tokens: float = 0.0

    @property
    def slot(self) -> float:
        """Seconds from one request of the run to the next."""
        return 60.0 / self.requests_per_minute


class Lane:
    """The share of one lane: every ``lanes``-th slot of the clock, and that part of the tokens.

    Time is cut into slots, and a slot belongs to one lane, which may start one request in it. So the tasks need no word
    with each other, and no stretch of time sees more requests than it has slots. Tokens are saved up before a request, so
    the lanes' requests never add up to more than the time allows, but for one request of each lane.
    """

    def __init__(self, number: int, budget: Budget, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.number, self.budget, self.clock, self.sleep = number % budget.lanes, budget, clock, sleep
        self.last = -1
        self.saved_from = clock()

    def take(self, tokens: float) -> None:
        """Wait for the lane's next slot in which the tokens are saved up."""
        slot, lanes, per_minute = self.budget.slot, self.budget.lanes, self.budget.tokens_per_minute
        ready = self.saved_from + tokens * 60.0 * lanes / per_minute if per_minute else 0.0
        while True:
            number = max(int(max(self.clock(), ready) // slot), self.last + 1)
            number += (self.number - number) % lanes
            wait = number * slot - self.clock()
            if wait > 0:
                self.sleep(wait)
            # Who wakes too late has missed the slot.
            if number * slot <= self.clock() < (number + 1) * slot:
                self.last, self.saved_from = number, self.clock()
                return
            self.last = max(self.last, number - 1)


def paced(predict: Callable[..., Any], lane: Lane) -> Callable[..., Any]:
    """``predict``, each call of which waits for its turn."""

    def call(rows: list[dict[str, Any]], settings: Mapping[str, Any]) -> Any:
        lane.take(sum(lane.budget.tokens(row) + lane.budget.reply_tokens for row in rows))
        return predict(rows, settings)

    return call
