"""Incremental tables on Spark: offsets, consumers, exactly-once models, and the SQL in between."""

from tidemark.coordination import Claim, ClaimStore, EtcdClaimStore, FileClaimStore, LocalClaimStore, open_claim_store
from tidemark.functions.sql import sql
from tidemark.operators.changes import apply_changes
from tidemark.operators.incremental import IncrementalAggregate, Total, fingerprint
from tidemark.operators.latest import dedup_latest, latest_by_key
from tidemark.sources.adapters import DeltaFormat, IcebergFormat
from tidemark.sources.log_table import LogTable
from tidemark.sources.table_format import CommitConflict, StaleWriter, TableFormat
from tidemark.streaming.checkpoint import JsonCheckpointStore, SinkCheckpointStore
from tidemark.streaming.consumer import Batch, Consumer
from tidemark.streaming.elastic import Backfill, ElasticRunner, LeaseLost, run_worker
from tidemark.streaming.pipeline import Model, Pipeline, Session, TableHandle, connect, session
from tidemark.version import __version__

__all__ = [
    "Backfill", "Batch", "Claim", "ClaimStore", "CommitConflict", "Consumer", "DeltaFormat", "ElasticRunner", "EtcdClaimStore", "FileClaimStore", "IcebergFormat",
    "IncrementalAggregate", "JsonCheckpointStore", "LeaseLost", "LocalClaimStore", "LogTable", "Model", "Pipeline", "Session", "SinkCheckpointStore", "StaleWriter",
    "TableFormat", "TableHandle", "Total", "__version__", "apply_changes", "connect", "dedup_latest", "fingerprint", "latest_by_key", "open_claim_store", "run_worker", "session", "sql",
]
