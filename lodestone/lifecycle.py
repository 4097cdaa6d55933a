"""Work around an engine: sessions, bounded repair, requests that overtake each other, and whom to trust."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestone.engine import Answer, Engine

#: Answers that a fresh look at the files can mend.
REPAIRABLE = ("stale", "missing")
MOST_ATTEMPTS, MOST_SECONDS = 8, 60.0


def start_session(engine: Engine, files: DataFrame, name: str | None = None) -> str:
    """Builds a generation of the files and keeps them as a session's base."""
    engine.build(files)
    return engine.store.start_session(engine.files(files).select("path", "project", "digest", "text"), name=name)


def session_changes(engine: Engine, session: str, now: DataFrame) -> DataFrame:
    """(path, change, base_value, target_value): what has changed since the session began."""
    from lodestone.operators import reconcile

    return reconcile.changes(engine.store.open_session(session), engine.files(now), "path", "digest").orderBy("path", "change")


def repaired(ask: Callable[[], Answer], mend: Callable[[], object], attempts: int = MOST_ATTEMPTS, seconds: float = MOST_SECONDS, clock: Callable[[], float] = time.monotonic) -> Answer:
    """Asks, and while the answer is stale or missing mends and asks again, within both bounds; any other answer is final.

    What the bounds left undone is named in the answer's limitations.
    """
    if not 1 <= attempts <= MOST_ATTEMPTS or not 0 < seconds <= MOST_SECONDS:
        raise ValueError(f"attempts are 1 to {MOST_ATTEMPTS}, seconds up to {MOST_SECONDS}")
    began, answer = clock(), ask()
    for _ in range(attempts):
        if answer.status not in REPAIRABLE:
            return answer
        if clock() - began >= seconds:
            break
        mend()
        answer = ask()
    if answer.status in REPAIRABLE:
        answer.limitations = (*answer.limitations, "repair ended at its bound")
    return answer


class LatestWins:
    """Of requests that run at the same time only the one begun last may answer."""

    def __init__(self) -> None:
        self._lock, self._epoch = threading.Lock(), 0

    def begin(self) -> int:
        with self._lock:
            self._epoch += 1
            return self._epoch

    def finish(self, request: int, answer: Answer) -> Answer:
        with self._lock:
            return answer if request == self._epoch else Answer("superseded", generation=answer.generation)


class Trust:
    """Trusted workspaces by exact path; a folder inside a trusted one is not trusted."""

    def __init__(self, paths: tuple[str, ...] = ()):
        self.paths = frozenset(p.replace("\\", "/").rstrip("/") for p in paths)

    def holds(self, path: str) -> bool:
        return path.replace("\\", "/").rstrip("/") in self.paths


def carried(limitations: DataFrame, changed: DataFrame) -> DataFrame:
    """Limitations (path, note) of files that have not changed since: they hold for the next generation too."""
    return limitations.join(changed.select("path").distinct(), "path", "left_anti")
