"""A small task graph: edges, retries, tasks that run whatever happened before, threads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field


@dataclass
class Task:
    name: str
    action: Callable[[], object]
    after: tuple[str, ...] = ()
    retries: int = 1
    delay: float = 30.0
    all_done: bool = False  # runs when all before it have ended, well or not


@dataclass
class Outcome:
    state: dict[str, str] = field(default_factory=dict)  # done, failed or skipped
    errors: dict[str, BaseException] = field(default_factory=dict)
    values: dict[str, object] = field(default_factory=dict)

    def check(self) -> Outcome:
        for e in self.errors.values():
            raise e
        return self


def poll(done: Callable[[], object], every: float = 5.0, tries: int = 120, sleep: Callable[[float], None] = time.sleep) -> object:
    """Ask until the answer is true, ``tries`` times at most; a TimeoutError then."""
    for k in range(tries):
        if k:
            sleep(every)
        if answer := done():
            return answer
    raise TimeoutError(f"not done after {tries} tries")


class Graph:
    def __init__(self, tasks: Iterable[Task]):
        self.tasks = {t.name: t for t in tasks}
        for t in self.tasks.values():
            unknown = set(t.after) - set(self.tasks)
            if unknown:
                raise ValueError(f"{t.name} comes after unknown {sorted(unknown)}")
        self.order()

    def order(self) -> list[str]:
        """A topological order; a cycle is an error."""
        left, out = {n: set(t.after) for n, t in self.tasks.items()}, []
        while left:
            ready = sorted(n for n, before in left.items() if not before)
            if not ready:
                raise ValueError(f"cycle among {sorted(left)}")
            out += ready
            left = {n: before - set(ready) for n, before in left.items() if n not in ready}
        return out

    def before(self, name: str) -> set[str]:
        """All tasks that end before a task starts."""
        found, todo = set(), list(self.tasks[name].after)
        while todo:
            n = todo.pop()
            if n not in found:
                found.add(n)
                todo += self.tasks[n].after
        return found

    def run(self, threads: int = 4) -> Outcome:
        out, running = Outcome(), {}
        with ThreadPoolExecutor(threads) as pool:
            while len(out.state) < len(self.tasks):
                for name, t in self.tasks.items():
                    if name in out.state or name in running.values() or not all(b in out.state for b in t.after):
                        continue
                    if t.all_done or all(out.state[b] == "done" for b in t.after):
                        running[pool.submit(self._attempt, t)] = name
                    else:
                        out.state[name] = "skipped"
                if running:
                    self._settle(running, out)
        return out

    @staticmethod
    def _settle(running: dict[Future, str], out: Outcome) -> None:
        for f in wait(running, return_when=FIRST_COMPLETED).done:
            name = running.pop(f)
            if f.exception():
                out.state[name], out.errors[name] = "failed", f.exception()
            else:
                out.state[name], out.values[name] = "done", f.result()

    @staticmethod
    def _attempt(t: Task) -> object:
        for k in range(t.retries + 1):
            try:
                return t.action()
            except Exception:
                if k == t.retries:
                    raise
                time.sleep(t.delay)
        raise AssertionError
