"""Endpoints that are asked as fast as they let themselves be asked.

Each endpoint has a limit of open requests.  An answer raises it by one for each full limit of answers, a refusal for its
rate halves it (once for what was open then) and gives the endpoint a pause.  Other failures put an endpoint aside for a
time that doubles with each of them, while the others go on; a request goes to the endpoint with most room.

Limits live in a worker process and last from task to task.  What all tasks may have open at an endpoint together is
divided among the tasks that run at once.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from marlstone.operators.model_calls import RateLimited


@dataclass
class Endpoint:
    client: object
    limit: float
    open: int = 0
    free_at: float = 0.0
    cut_at: float = 0.0
    failures: int = 0
    limits: list = field(default_factory=list)  # after each answer and refusal


class _Shared:
    def __init__(self, clients: tuple, first: int, start: float):
        self.changed = threading.Condition()
        order = [*clients[first % len(clients) :], *clients[: first % len(clients)]]
        self.endpoints = [Endpoint(c, start) for c in order]


_processes: dict[str, _Shared] = {}


@dataclass(frozen=True)
class PacedClient:
    """clients: one for each endpoint; name: what its limits are known by in a process.

    most: requests that may be open at an endpoint in all; tasks: how many tasks run at once, which share that.  A task's
    in_flight should be the number of endpoints times most / tasks.
    """

    clients: tuple
    name: str
    most: int = 64
    tasks: int = 1
    pause: float = 1.0

    @property
    def share(self) -> float:
        return max(1.0, self.most / self.tasks)

    def shared(self) -> _Shared:
        if self.name not in _processes:
            from pyspark import TaskContext

            context = TaskContext.get()  # tasks begin at different endpoints
            _processes[self.name] = _Shared(self.clients, context.partitionId() if context else 0, min(2.0, self.share))
        return _processes[self.name]

    def _take(self, state: _Shared) -> Endpoint:
        with state.changed:
            while True:
                now = time.monotonic()
                ready = [e for e in state.endpoints if e.free_at <= now and e.open + 1 <= e.limit]
                if ready:
                    best = min(ready, key=lambda e: e.open / e.limit)
                    best.open += 1
                    return best
                waits = [e.free_at - now for e in state.endpoints if e.free_at > now]
                state.changed.wait(min([*waits, 1.0]))

    def chat(self, messages: list[dict], **parameters) -> dict:
        state = self.shared()
        e = self._take(state)
        began = time.monotonic()
        try:
            answer = e.client.chat(messages, **parameters)
        except BaseException as problem:
            with state.changed:
                now = time.monotonic()
                if isinstance(problem, RateLimited):
                    if began >= e.cut_at:  # what was open at the last cut is no further sign
                        e.limit, e.cut_at = max(1.0, e.limit / 2), now
                    e.free_at = max(e.free_at, now + self.pause)
                else:
                    e.failures += 1
                    e.free_at = now + min(60.0, self.pause * 2**e.failures)
                e.open -= 1
                e.limits.append(e.limit)
                state.changed.notify_all()
            raise
        with state.changed:
            e.failures = 0
            e.limit = min(self.share, e.limit + 1 / e.limit)
            e.open -= 1
            e.limits.append(e.limit)
            state.changed.notify_all()
        return answer
