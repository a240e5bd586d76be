"""Claims in an SQLite file, for workers of one machine or a shared disk."""

from __future__ import annotations

import os
import sqlite3
import threading

from tidemark.coordination.claims import Claim, ClaimStore


class LocalClaimStore(ClaimStore):
    def __init__(self, path: str):
        if os.path.dirname(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
        self.path, self._lock = path, threading.Lock()
        self._db = sqlite3.connect(path, timeout=30, isolation_level=None, check_same_thread=False)
        self._run("PRAGMA journal_mode=WAL")
        self._run("CREATE TABLE IF NOT EXISTS claims (shard TEXT PRIMARY KEY, version INTEGER NOT NULL, body TEXT)")

    def _run(self, query: str, *values) -> sqlite3.Cursor:
        with self._lock:
            return self._db.execute(query, values)

    def _row(self, shard: str):
        with self._lock:
            return self._db.execute("SELECT version, body FROM claims WHERE shard = ?", (shard,)).fetchone()

    def _read(self, shard: str) -> tuple[Claim | None, object]:
        row = self._row(shard)
        return (None, None) if row is None else (Claim.load(row[1]) if row[1] else None, row[0])

    def _swap(self, shard: str, version: object, claim: Claim | None) -> bool:
        body = claim.dump().decode() if claim else None
        if version is None:
            return self._run("INSERT OR IGNORE INTO claims VALUES (?, 0, ?)", shard, body).rowcount == 1
        return self._run("UPDATE claims SET version = version + 1, body = ? WHERE shard = ? AND version = ?", body, shard, version).rowcount == 1

    def list_claims(self) -> dict[str, Claim]:
        with self._lock:
            rows = self._db.execute("SELECT shard, body FROM claims WHERE body IS NOT NULL").fetchall()
        return {shard: Claim.load(body) for shard, body in rows}

    def close(self) -> None:
        self._db.close()
