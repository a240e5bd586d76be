"""Quality rules against brute force."""

import re
from collections import Counter, defaultdict

from tidemark.llm import quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def plain(rows, min_docs=20, share=0.002):
    norm = lambda x: re.sub("[0-9]", "0", " ".join(re.findall(WORD, x.lower())))
    docs, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                docs[host, norm(line)].add(text or "")
    often = {k for k, v in docs.items() if len(v) > min_docs and len(v) > share * len(hosts[k[0]])}
    out = []
    for doc, text, host in rows:
        text = text or ""
        words, lines = re.findall(WORD, text), [x for x in text.split("\n") if re.search(WORD, x)]
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        gone = sum(len(norm(x).split(" ")) for x in lines if (host, norm(x)) in often)
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        left = len(words) - gone
        out.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
                    len(again), failed, not failed and left >= 10 and left >= 0.2 * len(words), gone))
    return sorted(out, key=str)


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, kept string, id int")
    got = quality_rules.quality_rules(docs, **({"min_docs": kw["min_docs"]} if kw else {}))
    want = plain(rows, **kw)
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = quality_rules.keep_good(docs, **({"min_docs": kw["min_docs"]} if kw else {}))
    assert kept.columns == docs.columns and kept.count() == sum(r[7] for r in want)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    check(spark, [tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    line = "Share  this page 12 times"
    rows = [(i, f"{body(i)}\n{line}\n", "a") for i in range(6)] + [(50 + i, f"{line}\n" * 2 + f"u{i} only", None) for i in range(6)]
    rows += [(90, "share this page 99 times " + chr(10) + " ".join(line for _ in range(9)), "a"), (91, None, "a"), (92, "", None), (None, body(7), "a"),
             (3, rows[3][1], "a"), (3, rows[3][1], "a"), (4, rows[3][1], "a"), (93, "one two three four five " * 2000, "b"), (94, "\x0b\x0c\r\n", "b"), (95, "a b c d e f g h i j k", None)]
    check(spark, rows, min_docs=4)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules.quality_rules(docs).collect() == []
