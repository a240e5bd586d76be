"""Loads split among workers, and what claims promise."""

import base64
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark import Backfill, ElasticRunner, EtcdClaimStore, FileClaimStore, JsonCheckpointStore, LeaseLost, LocalClaimStore, StaleWriter, open_claim_store, run_worker
from tidemark.coordination import claims as claims_module
from tidemark.coordination.claims import Hold
from tidemark.functions.offsets import buckets


class Etcd(BaseHTTPRequestHandler):
    """As much of etcd's JSON gateway as the store uses."""

    data: dict = {}
    revision = 1
    lock = threading.Lock()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with self.lock:
            out = getattr(self, self.path.rsplit("/", 1)[1])(body)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *a):
        pass

    leases: dict = {}

    def grant(self, body):
        name = str(len(Etcd.leases) + 7)
        Etcd.leases[name] = "granted"
        return {"ID": name, "TTL": body["TTL"]}

    def keepalive(self, body):
        return {"result": {"ID": body["ID"], "TTL": "30" if self.leases.get(body["ID"]) == "granted" else "0"}}

    def revoke(self, body):
        self.leases[body["ID"]] = "revoked"
        for k in [k for k, v in self.data.items() if v[2] == body["ID"]]:
            del self.data[k]
        return {}

    def range(self, body):
        lo, hi = base64.b64decode(body["key"]), base64.b64decode(body.get("range_end", ""))
        found = [(k, v) for k, v in self.data.items() if (lo <= k < hi if hi else k == lo)]
        return {"kvs": [{"value": v, "mod_revision": str(r)} for _, (v, r, _) in found]} if found else {}

    def txn(self, body):
        c = body["compare"][0]
        key = base64.b64decode(c["key"])
        if self.data.get(key, (None, 0, None))[1] != int(c["mod_revision"]):
            return {}
        Etcd.revision += 1
        change = body["success"][0]
        if "request_put" in change:
            self.data[key] = (change["request_put"]["value"], Etcd.revision, change["request_put"].get("lease"))
        else:
            self.data.pop(key, None)
        return {"succeeded": True}


@pytest.fixture(params=["sqlite", "files", "etcd"])
def claims(request, tmp_path):
    if request.param == "sqlite":
        with LocalClaimStore(str(tmp_path / "a" / "claims.db")) as c:
            yield c
    elif request.param == "files":
        yield FileClaimStore(None, str(tmp_path / "claims"))
    else:
        Etcd.data, Etcd.leases = {}, {}
        server = ThreadingHTTPServer(("127.0.0.1", 0), Etcd)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        yield EtcdClaimStore("127.0.0.1", server.server_address[1])
        server.shutdown()


def test_claims(claims):
    assert claims.get("s/1") is None and claims.list_claims() == {}
    assert claims.claim("s/1", "a", 30) and claims.claim("s/1", "a", 30) and not claims.claim("s/1", "b", 30)
    assert claims.renew("s/1", "a", 30) and not claims.renew("s/1", "b", 30) and not claims.renew("none", "a", 30)
    claims.bookmark("s/1", "b", 9)
    assert claims.get("s/1").bookmark_offset == -1
    claims.bookmark("s/1", "a", 9)
    c = claims.get("s/1")
    assert (c.shard, c.worker, c.bookmark_offset, c.status) == ("s/1", "a", 9, "in_progress") and c.live() and not c.expired()
    claims.release("s/1", "b")
    claims.complete("s/1", "b")
    assert claims.get("s/1").status == "in_progress"
    claims.complete("s/1", "a")
    assert claims.get("s/1").status == "done"
    assert claims.claim("s/2", "b", 30) and set(claims.list_claims()) == {"s/1", "s/2"}
    claims.release("s/2", "b")
    assert claims.get("s/2") is None and claims.claim("s/2", "c", 30)


def test_lapsed_leases(claims, monkeypatch):
    now = [1_000_000]
    monkeypatch.setattr(claims_module, "deadline", lambda seconds: now[0] + int(seconds * 1000))
    assert claims.claim("s", "a", 2)
    claims.bookmark("s", "a", 5)
    now[0] += 1999
    assert not claims.claim("s", "b", 2)
    now[0] += 2
    assert not claims.renew("s", "a", 2) and claims.claim("s", "b", 2)
    assert claims.get("s").worker == "b" and claims.get("s").bookmark_offset == 5 and not claims.renew("s", "a", 2)


def test_a_claim_has_one_lease(claims):
    if not isinstance(claims, EtcdClaimStore):
        pytest.skip("leases of etcd")
    assert claims.claim("s", "a", 30)
    for k in range(5):
        assert claims.renew("s", "a", 30)
        claims.bookmark("s", "a", k)
    assert not claims.claim("s", "b", 30) and list(Etcd.leases.values()) == ["granted"]
    claims.complete("s", "a")
    assert claims.get("s").status == "done" and set(Etcd.leases.values()) == {"revoked"}
    assert claims.claim("t", "a", 30)
    claims.release("t", "a")
    assert claims.get("t") is None and set(Etcd.leases.values()) == {"revoked"}


def test_a_hold_outlives_its_time(claims):
    assert claims.claim("s", "a", 1.2)
    with Hold(claims, ["s"], "a", 1.2) as hold:
        time.sleep(2)
        assert hold.renew() and not claims.claim("s", "b", 1)
    time.sleep(1.5)
    assert claims.claim("s", "b", 30)
    with Hold(claims, ["s"], "a", 0.1) as hold:
        time.sleep(0.2)
        assert hold.lost and not hold.renew()


def test_a_race_has_one_winner(claims):
    won, gate = [], threading.Barrier(12)

    def take(k):
        gate.wait()
        if claims.claim("s", f"w{k}", 30):
            won.append(k)

    threads = [threading.Thread(target=take, args=(k,)) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1


def test_store_uris(tmp_path, monkeypatch):
    assert open_claim_store(f"sqlite://{tmp_path}/x.db").path == f"{tmp_path}/x.db"
    monkeypatch.setenv("TIDEMARK_CLAIMS", str(tmp_path / "y.db"))
    assert open_claim_store().path == str(tmp_path / "y.db")
    assert open_claim_store("etcd://h:1").url == "http://h:1/v3" and open_claim_store(f"files:{tmp_path}/f").root == f"{tmp_path}/f"
    for bad in ("redis://x", "sqlite://", ""):
        with pytest.raises(ValueError):
            open_claim_store(bad)


@pytest.mark.parametrize("until,n", [(99, 4), (99, 7), (2, 5), (0, 1), (0, 3), (1000, 1)])
def test_bucket_plan(until, n):
    plan = buckets(until, n, "x")
    assert [k for k, _, _ in plan] == [f"x.bucket{i}" for i in range(n)] and plan[0][1] == -1 and plan[-1][2] == until
    assert all(a[2] == b[1] and a[1] <= a[2] for a, b in zip(plan, plan[1:]))
    assert sorted(o for _, lo, hi in plan for o in range(lo + 1, hi + 1)) == list(range(until + 1))


def test_no_bucket():
    with pytest.raises(ValueError):
        buckets(10, 0, "x")


@pytest.fixture
def big(spark, lake):
    lake.table("s").write(spark.range(3000, numPartitions=3).select((F.col("id") % 200).alias("value"), F.col("id").alias("n")))
    return lake


def over_100(d):
    return d.where("value > 100").drop("_offset")


def check(lake, table="t"):
    want = sorted(r.n for r in lake.table("s").read().where("value > 100").collect())
    assert sorted(r.n for r in lake.table(table).read().collect()) == want


def test_workers_share_buckets(big, tmp_path):
    stats, events = [], []

    def work(k):
        with LocalClaimStore(str(tmp_path / "c.db")) as claims:
            stats.append(run_worker(big.source("s"), big.source("t"), over_100, name="load", num_buckets=6, claim_store=claims, worker=f"w{k}", batch_rows=300, idle_sleep=0.02, on_event=events.append))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    check(big)
    done = [b for s in stats for b in s["buckets_completed"]]
    assert sorted(done) == [f"load.bucket{i}" for i in range(6)] and sum(s["rows_out"] for s in stats) == big.table("t").read().count()
    assert {e["event"] for e in events} == {"claimed", "committed", "completed"} and sum(s["chunks"] for s in stats) == 12
    with LocalClaimStore(str(tmp_path / "c.db")) as claims:
        again = ElasticRunner(big.source("s"), big.source("t"), over_100, name="load", num_buckets=6, claim_store=claims)
        assert again.all_done() and again.run()["chunks"] == 0


def test_another_worker_goes_on_from_the_sink(big, tmp_path):
    events = []
    with LocalClaimStore(str(tmp_path / "c.db")) as claims:
        calls = []

        def dies(d):
            calls.append(1)
            if len(calls) == 3:
                raise KeyboardInterrupt
            return over_100(d)

        how = {"name": "load", "num_buckets": 2, "claim_store": claims, "batch_rows": 400}
        with pytest.raises(KeyboardInterrupt):
            run_worker(big.source("s"), big.source("t"), dies, worker="a", **how)
        stats = run_worker(big.source("s"), big.source("t"), over_100, worker="b", on_event=lambda e: events.append(e) or 1 / 0, **how)
    assert stats["reclaimed"] == ["load.bucket0"] and next(e for e in events if e["event"] == "failover")["resume"] == 799
    check(big)


def test_a_worker_that_lost_its_lease_writes_nothing(big, tmp_path):
    with LocalClaimStore(str(tmp_path / "c.db")) as claims:
        def robbed(d):
            claims.release("load.bucket0", "zombie")
            return over_100(d)

        # Its lease goes during the transform; it must not commit, and another does the work.
        zombie = ElasticRunner(big.source("s"), big.source("t"), robbed, name="load", num_buckets=1, claim_store=claims, worker="zombie")
        claims.claim("load.bucket0", "zombie", 30)
        with pytest.raises(LeaseLost):
            zombie.drain(zombie.buckets[0])
        assert not big.exists("t") or big.table("t").read().count() == 0
        run_worker(big.source("s"), big.source("t"), over_100, name="load", num_buckets=1, claim_store=claims)
        with pytest.raises(StaleWriter):
            big.source("t").append(big.table("t").read().limit(1), {"load.bucket0": 1}, {"load.bucket0": None})
    check(big)


def test_a_chunk_longer_than_its_lease_is_kept(big, tmp_path):
    with LocalClaimStore(str(tmp_path / "c.db")) as claims:
        def slow(d):
            time.sleep(0.5)
            return over_100(d)

        stats = run_worker(big.source("s"), big.source("t"), slow, name="load", num_buckets=1, claim_store=claims, ttl=0.3, idle_sleep=0.02)
        assert stats["chunks"] == 1 and stats["buckets_completed"] == ["load.bucket0"]
    check(big)


def test_transform_sees_offsets(spark, big, tmp_path):
    with LocalClaimStore(str(tmp_path / "c.db")) as claims:
        run_worker(big.source("s"), big.source("t"), lambda d: d.where("_offset % 2 = 0"), name="x", num_buckets=3, claim_store=claims)
        run_worker(big.source("nothing"), big.source("t"), lambda d: d, name="y", num_buckets=3, claim_store=claims)
    assert sorted(r._offset for r in big.source("t").read_all().collect()) == list(range(0, 3000, 2))


@pytest.mark.parametrize("kept", ["sink", "json", "claims"])
def test_backfill(big, tmp_path, kept):
    claims = LocalClaimStore(str(tmp_path / "c.db")) if kept == "claims" else None
    store = JsonCheckpointStore(str(tmp_path / "p.json")) if kept == "json" else None
    make = lambda: Backfill(big.source("s"), big.source("t"), over_100, num_shards=4, checkpoint=store, claim_store=claims, batch_rows=250)
    b = make()
    assert b.run(2) == 750 and b.status()[2] == {"bookmark": 2999, "complete": True, "until": 2999} and not b.status()[0]["complete"]
    assert b.run([0, 1]) == 1500 and make().run() == 750 and make().run() == 0
    check(big)
    with pytest.raises(ValueError):
        b.run_shard(4)
    with pytest.raises(ValueError):
        Backfill(big.source("s"), big.source("t"), over_100, num_shards=0)


def test_backfill_reads_the_source_once(big, monkeypatch):
    source, reads = big.source("s"), []
    since = source.read_since
    monkeypatch.setattr(source, "read_since", lambda *a: reads.append(a) or since(*a))
    work = Backfill(source, big.source("t"), over_100, num_shards=4)
    assert work.run(3) == 750 and work.run() == 2250 and len(reads) == 2
    check(big)
    assert set(big.source("t").read_offsets().values()) == {2999} and work.run() == 0 and len(reads) == 2


def test_backfill_stops_at_until_and_resumes(big):
    calls = []

    def dies(d):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return over_100(d)

    how = {"num_shards": 2, "until": 1999, "batch_rows": 300}
    with pytest.raises(KeyboardInterrupt):
        Backfill(big.source("s"), big.source("t"), dies, **how).run(0)
    assert Backfill(big.source("s"), big.source("t"), over_100, **how).run() == 2000 - 300
    assert sorted(r.n for r in big.table("t").read().collect()) == [n for n in range(2000) if n % 200 > 100]
    assert Backfill(big.source("empty"), big.source("u"), over_100, num_shards=2).run() == 0
