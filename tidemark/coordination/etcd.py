"""Claims in etcd, through the JSON gateway that its servers have; no client package is needed.

A claim's key is bound to an etcd lease as well, so the key of a dead worker goes by itself. A claim has one lease for
as long as it is held: renewals keep it alive, and it is revoked when the claim ends.
"""

from __future__ import annotations

import base64
import json
import threading
import urllib.request

from tidemark.coordination.claims import DONE, Claim, ClaimStore, deadline

PREFIX = "/tidemark/claims/"


def _b64(text: str | bytes) -> str:
    return base64.b64encode(text.encode() if isinstance(text, str) else text).decode()


class EtcdClaimStore(ClaimStore):
    def __init__(self, host: str = "localhost", port: int = 2379, timeout: float = 5.0):
        self.url, self.timeout, self._lock = f"http://{host}:{port}/v3", timeout, threading.Lock()
        #: (shard, worker) of the claims made here: their lease and its seconds.
        self._leases: dict[tuple[str, str], tuple[str, int]] = {}

    def _call(self, what: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.url}/{what}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def _read(self, shard: str) -> tuple[Claim | None, object]:
        found = self._call("kv/range", {"key": _b64(PREFIX + shard)}).get("kvs", [])
        return (Claim.load(base64.b64decode(found[0]["value"])), int(found[0]["mod_revision"])) if found else (None, 0)

    def _lease(self, shard: str, claim: Claim) -> tuple[str, int]:
        """The lease of a claim that is held, kept alive, or a new one; and its seconds."""
        seconds = max(1, -(-(claim.lease_expiry_ms - deadline(0)) // 1000))
        have = self._leases.get((shard, claim.worker))
        if have and have[1] >= seconds:
            answer = self._call("lease/keepalive", {"ID": have[0]})
            if int(answer.get("result", answer).get("TTL", 0)) > 0:
                return have
        return self._call("lease/grant", {"TTL": seconds})["ID"], seconds

    def _swap(self, shard: str, version: object, claim: Claim | None) -> bool:
        key = _b64(PREFIX + shard)
        with self._lock:
            # A finished claim outlives its lease: that a shard is done stays known.
            lease = None if claim is None or claim.status == DONE else self._lease(shard, claim)
            if claim is None:
                change = {"request_delete_range": {"key": key}}
            else:
                change = {"request_put": {"key": key, "value": _b64(claim.dump()), **({"lease": lease[0]} if lease else {})}}
            compare = {"key": key, "target": "MOD", "result": "EQUAL", "mod_revision": version}
            won = bool(self._call("kv/txn", {"compare": [compare], "success": [change]}).get("succeeded"))
            held = {k: v for k, v in self._leases.items() if k[0] == shard}
            over = [v for v in held.values() if v != lease] if won else [lease] if lease and lease not in held.values() else []
            if won:
                for k in held:
                    del self._leases[k]
                if lease:
                    self._leases[shard, claim.worker] = lease
            for old in over:
                self._call("lease/revoke", {"ID": old[0]})
        return won

    def list_claims(self) -> dict[str, Claim]:
        end = PREFIX[:-1] + chr(ord(PREFIX[-1]) + 1)
        found = self._call("kv/range", {"key": _b64(PREFIX), "range_end": _b64(end)}).get("kvs", [])
        claims = (Claim.load(base64.b64decode(x["value"])) for x in found)
        return {c.shard: c for c in claims}
