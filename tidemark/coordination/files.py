"""Claims as numbered files of a folder that all drivers reach: no service is needed.

Each change of a claim is the next number, published by put-if-absent.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import SparkSession

from tidemark.coordination.claims import Claim, ClaimStore
from tidemark.sources.log_store import store_for


class FileClaimStore(ClaimStore):
    def __init__(self, spark: SparkSession | None, folder: str):
        self.store, self.root = store_for(spark, folder.rstrip("/"))

    def _folder(self, shard: str) -> str:
        return f"{self.root}/{quote(shard, safe='')}"

    def _read(self, shard: str) -> tuple[Claim | None, object]:
        names = self.store.names(self._folder(shard))
        if not names:
            return None, -1
        data = self.store.read(f"{self._folder(shard)}/{names[-1]}")
        return (Claim.load(data) if data else None), int(names[-1])

    def _swap(self, shard: str, version: object, claim: Claim | None) -> bool:
        return self.store.put_if_absent(f"{self._folder(shard)}/{version + 1:012d}", claim.dump() if claim else b"")

    def list_claims(self) -> dict[str, Claim]:
        found = {s: self._read(s)[0] for s in map(unquote, self.store.names(self.root))}
        return {s: c for s, c in found.items() if c}
