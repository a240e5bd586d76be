"""Parts of the operators' jobs that results on the generated tables do not show."""

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_packing import check
from tidemark.llm import html_extract, queries, quality_rules, simhash, tokens


def test_frequent_lines_leave_the_text(spark):
    body = lambda i: " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + k) for k in range(15))  # digits would be one
    often = "Share  this page 12 times"
    rows = [(i, f"\n{often}\n\n{body(i)}\n{often.upper()}\n \nlast {body(i)[:1]}\n", "a", 0) for i in range(25)]
    rows += [(50 + i, f"{often}\n{body(50 + i)}", "b", 0) for i in range(5)] + [(60, f"{body(60)}\n\n", "a", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    want = [(d, "\n".join(x for x in t.split("\n") if s != "a" or not x.lower().startswith("share")), s) for d, t, s, _ in rows]
    got = quality_rules.keep_good(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.source) for r in got.collect()) == sorted(want)
    got = corpus_pipeline.rules(spark, docs, "")
    assert sorted((r.doc_id, r.text, r.source, r.n_chars) for r in got.collect()) == sorted((*w, len(w[1])) for w in want)


def test_ids_are_the_library_s_as_loaded(spark, tmp_path):
    library = Tokenizer.from_file(tokens.default_path())
    end = "<|endoftext|>"
    texts = [None, "", "a <|endoftext|> b", end, f"{end}{end} x{end}", "<|endoftext|", f" {end}\n\n  {end}  'll", "plain"]
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [tokens.encode(t, tokens.default_path(), True) for t in texts] == ids and ids[2] == [64, 220, 50256, 275]
    docs = spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(k, x + [2]) for k, x in enumerate(ids)]
    check(queries.op3_packing(spark, str(tmp_path)).collect(), rows, 1024)
    check(corpus_pipeline.packed(spark, docs, "").collect(), rows, 1024)
    assert [(r.n_docs, r.n_tokens) for r in queries.op1_token_counts(spark, str(tmp_path)).collect()] == [(len(texts), sum(map(len, ids)))]


def test_one_row_of_each_component(spark):
    text = "one two three four five six seven eight nine ten"
    alone, other = "alone with no id at all", "zebra crossing " * 30
    rows = [(7, text, 1), (7, text.upper(), 2), (7, text, 3), (8, text, 4), (None, text, 5), (None, alone, 6), (None, alone, 7), (None, alone.upper(), 8), (9, other, 9), (9, other, 10), (3, None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    for kept in (simhash.keep_single(docs), corpus_pipeline.near_dedup(spark, docs, "")):
        assert kept.columns == docs.columns
        got = [(r.doc_id, (r.text or "").lower()) for r in kept.collect()]
        assert sorted(got, key=str) == sorted([(7, text), (None, alone), (9, other), (3, "")], key=str)
    assert simhash.keep_single(docs.limit(0)).collect() == []


def test_root_holds_every_slot(spark):
    words = lambda k, n: " ".join(f"{chr(97 + k)}word{i}" for i in range(n))
    frame = "<html><body><div class=top>My site of many things</div>{}<div class=foot>Call us any time</div></body></html>"
    lead = lambda k: frame.format(f"<div class=post><h1>Title {k}</h1><div class=lead>{words(k, 20)}</div><div class=body><p>{words(k, 80)}</p></div></div>")
    split = lambda k: frame.format(f"<section class=a><p>{words(k, 60)}</p></section><section class=b><p>{words(k, 40)}</p></section>")
    rows = [(k, "http://lead.example/", lead(k)) for k in range(12)] + [(100 + k, "http://split.example/", split(k)) for k in range(12)]
    text = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert text[k] == f"Title {k}\n{words(k, 20)}\n{words(k, 80)}"
        assert text[100 + k] == f"{words(k, 60)}\n{words(k, 40)}"
