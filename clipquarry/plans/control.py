"""The control plane: task states and metadata in SQLite on the driver."""

from __future__ import annotations

import json
import sqlite3
from contextlib import closing
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

STATUSES = ("pending", "running", "completed", "failed")


@dataclass(frozen=True)
class Task:
    task_name: str
    status: str
    retry_count: int
    checkpoint: str | None
    error_message: str | None
    started_at: str | None
    completed_at: str | None
    updated_at: str


class TaskStore:
    """Tasks and key-value metadata. Every call opens its own connection, so threads and processes may share a file."""

    def __init__(self, path: Path) -> None:
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with closing(self._open()) as db, db:
            db.execute("CREATE TABLE IF NOT EXISTS tasks (name TEXT PRIMARY KEY, status TEXT NOT NULL, retries INTEGER NOT NULL DEFAULT 0, checkpoint TEXT, error TEXT, started TEXT, completed TEXT, updated TEXT NOT NULL)")
            db.execute("CREATE TABLE IF NOT EXISTS metadata (key TEXT PRIMARY KEY, value TEXT NOT NULL, updated TEXT NOT NULL)")

    def _open(self) -> sqlite3.Connection:
        db = sqlite3.connect(self.path, timeout=30)
        db.execute("PRAGMA journal_mode=WAL")
        return db

    def _run(self, sql: str, *values: Any) -> int:
        with closing(self._open()) as db, db:
            return db.execute(sql, values).rowcount

    def _rows(self, sql: str, *values: Any) -> list[tuple]:
        with closing(self._open()) as db:
            return db.execute(sql, values).fetchall()

    @staticmethod
    def _now() -> str:
        return datetime.now(UTC).isoformat()

    @staticmethod
    def _known(status: str) -> None:
        if status not in STATUSES:
            raise ValueError(f"{status!r} is no status")

    def create(self, name: str, status: str = "pending") -> None:
        """Adds a task, or leaves the one there is."""
        self._known(status)
        self._run("INSERT OR IGNORE INTO tasks (name, status, updated) VALUES (?, ?, ?)", name, status, self._now())

    def update(self, name: str, status: str, error: str | None = None) -> None:
        """Running starts the clock, pending clears it; only completed has an end, only failed an error."""
        self._known(status)
        now = self._now()
        done = self._run(
            "UPDATE tasks SET status = ?1, started = CASE ?1 WHEN 'running' THEN ?2 WHEN 'pending' THEN NULL ELSE started END, completed = CASE ?1 WHEN 'completed' THEN ?2 END, error = CASE ?1 WHEN 'failed' THEN ?3 END, updated = ?2 WHERE name = ?4",
            status, now, error, name,
        )
        if not done:
            raise KeyError(name)

    _COLUMNS = "SELECT name, status, retries, checkpoint, error, started, completed, updated FROM tasks"

    def get(self, name: str) -> Task | None:
        rows = self._rows(f"{self._COLUMNS} WHERE name = ?", name)
        return Task(*rows[0]) if rows else None

    def all(self) -> list[Task]:
        return [Task(*r) for r in self._rows(f"{self._COLUMNS} ORDER BY name")]

    def pending(self) -> list[Task]:
        return [Task(*r) for r in self._rows(f"{self._COLUMNS} WHERE status IN ('pending', 'failed') ORDER BY name")]

    def retry(self, name: str) -> int:
        if not self._run("UPDATE tasks SET retries = retries + 1, updated = ? WHERE name = ?", self._now(), name):
            raise KeyError(name)
        return self.get(name).retry_count

    def set_checkpoint(self, name: str, checkpoint: str | None) -> None:
        if not self._run("UPDATE tasks SET checkpoint = ?, updated = ? WHERE name = ?", checkpoint, self._now(), name):
            raise KeyError(name)

    def checkpoint(self, name: str) -> str | None:
        task = self.get(name)
        if task is None:
            raise KeyError(name)
        return task.checkpoint

    def set_metadata(self, key: str, value: Any) -> None:
        self._run("INSERT INTO metadata VALUES (?, ?, ?) ON CONFLICT (key) DO UPDATE SET value = excluded.value, updated = excluded.updated", key, json.dumps(value, default=str), self._now())

    def metadata(self, key: str) -> Any:
        rows = self._rows("SELECT value FROM metadata WHERE key = ?", key)
        return json.loads(rows[0][0]) if rows else None
