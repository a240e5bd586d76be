"""The rollup against a recount with the tokenizers library."""

from collections import defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import queries, tokens
from tidemark.llm import token_counts as tc


def recount(rows):
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    out = defaultdict(lambda: [0, 0, 0])
    for source, lang, text in rows:
        for k, n in enumerate((1, len(t.encode(text or "", add_special_tokens=False).ids), len((text or "").encode()))):
            out[source, lang][k] += n
    return {k: tuple(v) for k, v in out.items()}


def totals(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().collect()}


def test_query_is_a_recount(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_bytes) for r in queries.op1_token_counts(spark, sf).collect()}
    once = lambda t: t and "\n".join(dict.fromkeys(t.split("\n")))
    assert any(r.text != once(r.text) for r in docs if r.doc_id not in bad)
    assert got == recount((r.source, r.lang, once(r.text)) for r in docs if r.doc_id not in bad)


def test_inserts_deletes_revisions(spark, tmp_path):
    old = [(1, "a b c", "s", "en"), (2, None, "s", None), (3, "x", None, "en"), (4, "same", "s", "en"), (None, "n", "s", "en")]
    new = [(1, "a b c d e f", "s", "en"), (3, "x", "t", "en"), (4, "same", "s", "en"), (5, "", "t", "de"), (None, "n", "s", "en")]
    make = lambda rows: tc.count_tokens(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, lang string, n_tokens int"))
    rollup = tc.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().collect() == []
    rollup.compact()
    assert rollup.commit("one", tc.signed(make(old), 1)) and not rollup.commit("one", tc.signed(make(old), 1))
    assert totals(rollup) == recount((s, x, t) for _, t, s, x in old)
    moved = tc.changes(make(old), make(new))
    assert moved.where("id = 4").count() == 0
    rollup.commit("two", moved)
    rollup.compact()
    assert totals(rollup) == recount((s, x, t) for _, t, s, x in new)
    assert not rollup.commit("two", lambda: 1 / 0)
    rollup.commit("three", tc.signed(make(new), -1))
    rollup.commit("none", tc.signed(make(new), 1).limit(0))
    assert totals(rollup) == {}
    rollup.compact()
    assert totals(rollup) == {} and rollup.committed("none")


def test_two_drivers_send_one_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "s", "en")], "doc_id long, text string, source string, lang string")
    a, b = (tc.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    late = tc.signed(tc.count_tokens(docs), 1)

    def rows():  # the other driver commits after this one has looked
        b.commit("x", late)
        return late

    assert not a.commit("x", rows)
    assert totals(a) == {("s", "en"): (1, 2, 3)}
    assert a.totals().select(F.sum("n_docs")).first()[0] == 1


def one(spark, n=1):
    return tc.signed(tc.count_tokens(spark.createDataFrame([(1, "a b", "s", "en")] * n, "doc_id long, text string, source string, lang string")), 1)


def test_a_commit_between_a_compaction_s_steps(spark, tmp_path, monkeypatch):
    a, b = (tc.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    a.commit("x", one(spark))
    summed = a._sums

    def slow(paths):
        b.commit("y", one(spark, 2))  # after the compaction has read the log
        return summed(paths)

    monkeypatch.setattr(a, "_sums", slow)
    a.compact()
    assert totals(b) == {("s", "en"): (3, 6, 9)}
    b.compact()
    assert totals(b) == {("s", "en"): (3, 6, 9)} and not b.commit("x", one(spark)) and not b.commit("y", one(spark))


def test_a_driver_is_lost_between_entry_and_mark(spark, tmp_path, monkeypatch):
    a, b = (tc.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    owner = a._owner

    def lost(batch, number=None):
        if number is not None:
            raise KeyboardInterrupt
        return owner(batch)

    monkeypatch.setattr(a, "_owner", lost)
    try:
        a.commit("x", one(spark))
    except KeyboardInterrupt:
        pass
    assert not b.commit("x", one(spark)) and totals(b) == {("s", "en"): (1, 2, 3)}


def test_commits_compact_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tc, "EVERY", 3)
    r = tc.Rollup(spark, f"file://{tmp_path}/r")
    for k in range(7):
        assert r.commit(str(k), one(spark))
    assert totals(r) == {("s", "en"): (7, 14, 21)} and r._whole()[0] == 5 and len(r._entries(5)[0]) == 1


def test_very_long_text(spark):
    text = "word " * 400_000 + "\u00e9" * 1000
    docs = spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")
    got = tc.count_tokens(docs).first()
    assert got.n_bytes == len(text.encode()) and got.n_tokens == len(tokens.encode(text, tokens.default_path()))
