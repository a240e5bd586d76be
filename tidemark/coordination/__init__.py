"""Claim stores and the URIs that open them."""

from __future__ import annotations

import os
import tempfile
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from tidemark.coordination.claims import Claim, ClaimStore
from tidemark.coordination.etcd import EtcdClaimStore
from tidemark.coordination.files import FileClaimStore
from tidemark.coordination.sqlite import LocalClaimStore

__all__ = ["Claim", "ClaimStore", "EtcdClaimStore", "FileClaimStore", "LocalClaimStore", "open_claim_store"]


def open_claim_store(uri: str = "local", spark: SparkSession | None = None) -> ClaimStore:
    """``local`` (a file named by TIDEMARK_CLAIMS, else in the temporary folder), ``sqlite:///path``,
    ``files:folder`` (a path or URI all drivers reach) or ``etcd://host:port``."""
    if uri == "local":
        return LocalClaimStore(os.environ.get("TIDEMARK_CLAIMS") or os.path.join(tempfile.gettempdir(), "tidemark", "claims.db"))
    if uri.startswith("files:"):
        return FileClaimStore(spark, uri.removeprefix("files:"))
    parts = urlparse(uri)
    if parts.scheme == "sqlite" and parts.path:
        return LocalClaimStore(parts.path)
    if parts.scheme == "etcd":
        return EtcdClaimStore(parts.hostname or "localhost", parts.port or 2379)
    raise ValueError(f"no claim store at {uri!r}: give local, sqlite:///path, files:folder or etcd://host:port")
