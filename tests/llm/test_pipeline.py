"""The pipeline's stages, each on what the one before it kept, against brute force."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_repeats, test_simhash
from tests.llm.test_packing import check
from tidemark.llm import tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_by_rules(rows):
    """rows: dicts; limits of 20 documents and 0.002 of a host."""
    norm = lambda x: re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" "))
    docs_of, seen = {}, {}
    for r in rows:
        docs_of.setdefault(r["source"], set()).add(r["text"] or "")
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if norm(x):
                seen.setdefault((r["source"], norm(x)), set()).add(r["text"])
    often = {k for k, d in seen.items() if len(d) > 20 and len(d) > 0.002 * len(docs_of[k[0]])}
    out = []
    for r in rows:
        w = WORD.findall(r["text"] or "")
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        if len(w) < 10 or 100 * len(hit) > 20 * len(w):
            continue
        lines = [x for x in r["text"].split("\n") if (r["source"], norm(x)) not in often]
        left = sum(len(WORD.findall(x)) for x in lines)
        if left >= 10 and left >= 0.2 * len(w):
            text = "\n".join(lines)
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def one_of_each(rows):
    least = test_simhash.classes([(r["doc_id"], test_simhash.plain(r["text"])) for r in rows])
    return [r for r, c in zip(rows, least) if r["doc_id"] == c]


def without_passages(rows):
    out = []
    for r, (words, gone) in zip(rows, test_repeats.covered([(r["doc_id"], r["text"]) for r in rows], 50)):
        out.append(r | {"text": [w.decode() for w, g in zip(words, gone) if not g]})
    return out


def clean(items):
    def run(rows):
        bad = {x[0] for x in test_decontaminate.plain([(r["doc_id"], r["text"]) for r in rows], items) if x[-1]}
        return [r for r in rows if r["doc_id"] not in bad]

    return run


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The generated documents, and others that every stage has work with."""
    rng = random.Random(6)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [r.text for r in bench.where("text is not null").collect()]
    say = lambda n: " ".join(rng.choice("river stone cloud harbor window silver paper garden engine winter".split()) + str(rng.randrange(1000)) for _ in range(n))
    passage, near = say(53), say(400)
    more = [f"Share this with 12 friends\n{say(60)}" for _ in range(25)] + [f"{say(30)} {passage}\n{say(40)}" for _ in range(4)]
    more += [near, near.replace("river", "River"), near, f"{say(20)} {items[0]} {items[1]}", "", "short one", say(12) + "\n" + say(12)]
    more += ["Share this with 7 friends " + say(1), "same words again " * 30, None, "<|endoftext|> " + say(2000)]
    schema = docs.schema
    rows = [(10**6 + k, t, "en", "site", len(t or "")) for k, t in enumerate(more)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = made.select(*(made[f.name].cast(f.dataType) for f in schema.fields))
    where = tmp_path_factory.mktemp("tables")
    docs.unionByName(made).write.parquet(f"{where}/documents.parquet")
    bench.write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    plain = [kept_by_rules, one_of_each, without_passages, clean(bench)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = [r.asDict() for r in docs.collect()], stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns, name
            want, got = plain[k](before), [r.asDict() for r in docs.collect()]
            assert 100 < len(got), name
            if k == 2:  # what is left, word by word
                assert any(r["n_chars"] != b["n_chars"] for r, b in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(before, key=lambda r: r["doc_id"])))
                assert all(r["n_chars"] == len(r["text"]) for r in got)
                got = [r | {"text": WORD.findall(r["text"])} for r in got]
                got, want = ([{c: r[c] for c in columns if c != "n_chars"} for r in x] for x in (got, want))
            else:
                assert len(got) < len(before), name
            assert sorted(got, key=str) == sorted(want, key=str), name
    ids = [(r["doc_id"], tokens.encode(r["text"], tokens.default_path(), True) + [2]) for r in before]
    check(docs.collect(), ids, 1024)
    again = corpus_pipeline.run(spark, folder)
    assert again.count() == docs.count()


def test_odd_documents(spark, folder):
    """Nulls in any column, rows that repeat, columns with names that the stages use themselves, very long texts."""
    long = " ".join(f"word{i}" for i in range(60_000))
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, spans int, component_id int, matches string, fp string, kept int"
    extra = ("r", "i", 1, 2, "m", "f", 0)
    rows = [(1, long, "en", None, 5, *extra), (1, long, "en", None, 5, *extra), (None, long[:900], None, None, None, *[None] * 7), (2, None, None, "s", 0, *extra),
            (3, "", "en", "s", 0, *extra), (4, "a b c d e f g h i j k l", "en", "s", 23, *extra)]
    docs = spark.createDataFrame(rows, names)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == [c.split()[0] for c in names.split(", ")], name
            want = ["1", "1", "4", "None"] if k == 0 else ["1", "4", "None"]
            assert sorted(str(r.doc_id) for r in docs.collect()) == want, name
    assert {r.doc_id for r in docs.collect()} == {1, 4, None}


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
