"""Chat windows against a plain formatter, and what is read back from them."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import chat
from tidemark.llm.tokens import default_path

KNOWN = set(chat.whole_pieces(default_path()))
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s")


def tokens(text):
    return sum(1 if w in KNOWN else len(w.encode()) for w in PIECE.findall(text))


def esc(text):
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def plain(turns, budget, most, limit):
    """[(text, spans, context)] of one conversation's (role, text) in order."""
    draw = lambda i: f"<|im_start|>{esc(turns[i][0]).replace(chr(10), chr(92) + 'n')}\n{esc(turns[i][1])}<|im_end|>\n"
    size = [tokens(draw(i)) for i in range(len(turns))]
    system = turns[0][0] == "system"
    out, at = [], 0
    while at < len(turns):
        lead = [0] if system and at else []
        back = 0
        while at and back < most and at - back - 1 >= system and sum(size[at - back - 1 : at]) <= limit and sum(
                size[i] for i in lead) + sum(size[at - back - 1 : at + 1]) <= budget:
            back += 1
        shown = lead + list(range(at - back, at))
        context, stop = len(shown), at
        while stop == at or (stop < len(turns) and sum(size[i] for i in shown) + size[stop] <= budget):
            shown.append(stop)
            stop += 1
        text, spans = "", []
        for k, i in enumerate(shown):
            one = draw(i)
            if k >= context and turns[i][0] == "assistant":
                spans.append((len(text) + one.index("\n") + 1, len(esc(turns[i][1]))))
            text += one
        out.append((text, spans, context, sum(size[i] for i in shown)))
        at = stop
    return out


@pytest.mark.parametrize("budget,most,limit", [(120, 2, 45), (1024, 4, 256), (15, 0, 0)])
def test_windows(spark, budget, most, limit):
    rng = random.Random(budget)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "\\n", "<", "|", "<\\|", "\n", "é🙂", "word ", "a1 ", "", "x " * 30]
    convs = {c: [(rng.choice(["user", "assistant", "assistant", "tool", "we\nird<|"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8))))
                 for _ in range(rng.randrange(1, 25))] for c in range(30)}
    for c in range(0, 30, 2):
        convs[c].insert(0, ("system", "be good " * (c % 5)))
    rows = [(c, i, r, t, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, windows string")
    made = chat.format_chats(df, budget=budget, history_turns=most, history_tokens=limit)
    got = {r.conv_id: [(w.text, [tuple(s) for s in w.loss], w.n_context, w.tokens) for w in r.windows] for r in made.collect()}
    assert got == {c: plain(t, budget, most, limit) for c, t in convs.items()}
    for r in chat.read_back(made).collect():
        turns = convs[r.conv_id]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == sum(len(w[0]) for w in got[r.conv_id])
    turns = made.select("conv_id", chat.read_turns(F.col("windows")).alias("t"), chat.read_loss(F.col("windows")).alias("l")).collect()
    for r in turns:
        assert [tuple(x) for x in r.t] == convs[r.conv_id]
        assert r.l == [t for role, t in convs[r.conv_id] if role == "assistant"]


def test_odd_rows(spark):
    rows = [(None, 1, None, None), (None, None, "assistant", "a"), (1, 0, "system", None), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"),
            (3, 0, "user", "w " * 5000), (3, 1, "assistant", "v " * 5000)]
    made = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.n_windows) for r in made.collect()}
    assert got == {None: (2, 1, 1), 1: (1, 0, 1), 2: (2, 2, 1), 3: (2, 10000, 2)}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(empty)).collect() == []


def test_pieces_of_the_vocabulary_are_one_token():
    library = Tokenizer.from_file(default_path())
    assert len(KNOWN) > 45_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(sorted(KNOWN), add_special_tokens=False))


def test_no_window_exceeds_the_budget(spark, sf):
    """By the encoder: more than the budget only where a window's one new turn brings it."""
    library = Tokenizer.from_file(default_path())
    library.encode_special_tokens = True
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = ["\u00a0 \u2003x\x1c \x1f\n\n y", "don't  we'll\t\tit's '' 's", "日本語 Ωmega 🙂🙂 １２３ ²³ \u0301a", "\r\n \x85 ", "<|endoftext|>"]
    more = spark.createDataFrame([(-2, i, "user", t * 9) for i, t in enumerate(odd)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(rows.select("conv_id", "turn", "role", "text").union(more)).collect()
    seen = 0
    for w in (w for r in made for w in r.windows):
        real = len(library.encode(w.text, add_special_tokens=False).ids)
        assert real <= w.tokens
        new = w.text.count("<|im_start|>") - w.n_context
        assert w.tokens <= chat.BUDGET or new == 1
        seen += new > 1
    assert seen
