"""Chat formatting in budgeted windows (DataFrame functions only).

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. A backslash in a role or text
is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control string, and both
are read back exactly; in a role a line feed becomes ``\\n`` as two characters.

A turn's tokens, its marks among them, are bounded from above by expressions alone: of its pieces, split as
byte-level BPE splits, one that the vocabulary has is one token, any other has at most its bytes.
Their prefix sums, made by a window function, choose spans of whole turns: a window takes turns while
the bound fits the budget, so no window of more than one new turn has more tokens than that. Each window after the first repeats the first turn if that is a
system turn, then the last few turns before it, as far as the history's limits
and the budget allow. Repeated turns are context: assistant texts among them
are masked, so each assistant text is a target exactly once. A turn longer than the
budget has a window of its own and is never cut.

Scale. One shuffle by conversation; the window function and the grouping share
it. A conversation is one row of the result, like a document.

Cases. Null texts and roles are empty. Turns go by ``turn``, null first; equal
ones by role and text, and equal rows are turns each. A null conversation id is
one conversation. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import let
from tidemark.llm.tokens import default_path, encoder

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY_TURNS = 4
HISTORY_TOKENS = 256
#: Unicode white space, and the pieces that byte-level BPE cuts a text into, but each white space by itself: where
#: BPE takes several for one piece, they are at most as many tokens. Java, RE2 and ``regex`` read it alike.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]"
BUCKETS = 1 << 15


@lru_cache(maxsize=4)
def whole_pieces(path: str) -> tuple[str, ...]:
    """The vocabulary's entries of two bytes or more that can be a piece, in order of their ids."""
    piece = regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", PIECE))
    found = []
    for token in encoder(path).token_byte_values():
        try:
            word = token.decode()
        except UnicodeDecodeError:
            continue
        if len(token) > 1 and piece.fullmatch(word):
            found.append(word)
    return tuple(found)


@lru_cache(maxsize=4)
def _table(path: str) -> str:
    """The pieces in buckets by hash: a literal that is looked up in constant time. No piece holds a tab or line feed."""
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    for word in whole_pieces(path):
        buckets[xxhash.xxh64_intdigest(word.encode(), 42) % BUCKETS].append(word)
    return "\t".join("\n".join(["", *b, ""]) if b else "" for b in buckets)


def token_bound(text: Column, tokenizer: str | None = None) -> Column:
    """At least as many tokens as the byte-level BPE file ``tokenizer`` makes of ``text``."""
    table = F.split(F.lit(_table(tokenizer or default_path())), "\t")  # folded to a constant

    def cost(w: Column) -> Column:
        bucket = F.get(table, F.xxhash64(w).bitwiseAND(BUCKETS - 1).cast("int"))
        known = F.instr(bucket, F.concat(F.lit("\n"), w, F.lit("\n"))) > 0
        return F.when((F.octet_length(w) > 1) & ~known, F.octet_length(w)).otherwise(1)

    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda n, w: n + cost(w))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`, also for line feeds of roles."""
    parts = F.transform(
        F.split(text, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    )
    return F.array_join(parts, "\\")


def _turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, tokenizer: str | None) -> DataFrame:
    """A row per conversation with its turns in order and their prefix sums."""
    plain = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    made = plain.select(
        "conv", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"),
        token_bound(F.concat(head, escape(F.col("text")), F.lit(CLOSE + "\n")), tokenizer).alias("tokens"),
    ).withColumn("chars", (F.char_length("head") + F.char_length("body") + len(CLOSE) + 1).cast("long"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    summed = made.select(
        "conv", (F.row_number().over(order) - 1).alias("i"), "role", "head", "body", "tokens", "chars",
        F.coalesce(F.sum("tokens").over(until), zero).alias("tokens_before"),
        F.coalesce(F.sum("chars").over(until), zero).alias("chars_before"),
    )
    one = F.struct("i", "role", "head", "body", "tokens", "chars", "tokens_before", "chars_before")
    return summed.groupBy("conv").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def _history(turns: Column, i: Column, system: Column, budget: int, most: int, tokens: int) -> Column:
    """How many turns before turn ``i`` a window that starts there repeats."""
    first = F.when(system, 1).otherwise(0)
    own = F.when(system, turns[0]["tokens"]).otherwise(0) + turns[i]["tokens"]
    fits = lambda k: (
        (i - k >= first)
        & (turns[i]["tokens_before"] - F.get(turns, i - k)["tokens_before"] <= tokens)
        & (own + turns[i]["tokens_before"] - F.get(turns, i - k)["tokens_before"] <= budget)
    )
    found = F.lit(0)
    for k in range(1, most + 1):  # fitting k turns means fitting fewer
        found = F.when(F.coalesce(fits(k), F.lit(False)), F.lit(k)).otherwise(found)
    return found


def _starts(turns: Column, system: Column, budget: int, most: int, tokens: int) -> Column:
    """(first new turn, repeated turns) of each window."""
    none = F.array().cast("array<struct<at:int,history:int>>")
    start = F.struct(none.alias("windows"), F.lit(0).cast("long").alias("used"))

    def step(state: Column, i: Column) -> Column:
        size = turns[i]["tokens"]
        goes_on = (i > 0) & (state["used"] + size <= budget)
        history = F.when(i == 0, F.lit(0)).otherwise(_history(turns, i, system, budget, most, tokens))

        def opened(h: Column) -> Column:
            kept = F.when(system & (i > 0), turns[0]["tokens"]).otherwise(F.lit(0))
            return F.struct(
                F.concat(state["windows"], F.array(F.struct(i.alias("at"), h.alias("history")))).alias("windows"),
                (kept + turns[i]["tokens_before"] - turns[i - h]["tokens_before"] + size).cast("long").alias("used"),
            )

        return F.when(goes_on, F.struct(state["windows"].alias("windows"), (state["used"] + size).alias("used"))).otherwise(let(history, opened))

    return F.aggregate(F.sequence(F.lit(0), F.size(turns) - 1), start, step, lambda s: s["windows"])


def _windows(turns: Column, starts: Column, system: Column) -> Column:
    whole = F.transform(turns, lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n")))

    def window(rendered: Column, w: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1)["at"], F.size(turns))
        origin = w["at"] - w["history"]
        again = system & (w["at"] > 0)
        lead = F.when(again, turns[0]["chars"]).otherwise(F.lit(0))
        new = F.slice(turns, w["at"] + 1, stop - w["at"])
        spans = F.transform(
            F.filter(new, lambda t: t["role"] == "assistant"),
            lambda t: F.struct(
                (lead + t["chars_before"] - turns[origin]["chars_before"] + F.char_length(t["head"])).cast("long").alias("start"),
                F.char_length(t["body"]).cast("long").alias("length"),
            ),
        )
        last = turns[stop - 1]
        return F.struct(
            F.concat(F.when(again, rendered[0]).otherwise(F.lit("")), F.array_join(F.slice(rendered, origin + 1, stop - origin), "")).alias("text"),
            spans.alias("loss"),
            (w["history"] + F.when(again, 1).otherwise(0)).alias("n_context"),
            (F.when(again, turns[0]["tokens"]).otherwise(F.lit(0)) + last["tokens_before"] + last["tokens"] - turns[origin]["tokens_before"]).cast("long").alias("tokens"),
        )

    return let(whole, lambda rendered: F.transform(starts, lambda w, k: window(rendered, w, k)))


def format_chats(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokenizer: str | None = None,
) -> DataFrame:
    """(conv_id, windows): each window's text, ``loss`` spans in code points, repeated turns, bound of tokens.

    The first ``n_context`` turns of a window repeat earlier ones. ``tokenizer`` is the path of a byte-level BPE file.
    """
    system = lambda t: t[0]["role"] == "system"
    made = let(
        F.col("turns"),
        lambda t: let(
            _starts(t, system(t), budget, history_turns, history_tokens), lambda s: _windows(t, s, system(t))
        ),
    )
    return _turns(rows, conv_id, turn, role, text, tokenizer).select(F.col("conv").alias(conv_id), made.alias("windows"))


def read_turns(windows: Column) -> Column:
    """(role, text) of each turn once, from the windows' texts."""

    def turns(w: Column) -> Column:
        parts = let(F.split(w["text"], r"<\|im_start\|>"), lambda p: F.slice(p, w["n_context"] + 2, F.size(p)))
        return F.transform(
            parts,
            lambda p: let(
                F.instr(p, "\n"),
                lambda at: F.struct(
                    unescape(F.substring(p, F.lit(1), at - 1)).alias("role"),
                    unescape(F.substring(p, at + 1, F.char_length(p) - at - len(CLOSE) - 1)).alias("text"),
                ),
            ),
        )

    return F.flatten(F.transform(windows, turns))


def read_loss(windows: Column) -> Column:
    """The texts under the loss mask, in order."""
    spans = lambda w: F.transform(w["loss"], lambda s: unescape(F.substring(w["text"], (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.flatten(F.transform(windows, spans))


def read_back(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Counts and digests of a formatted table, read from its windows alone."""
    windows = F.col("windows")
    said = F.transform(read_turns(windows), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    chars = F.aggregate(F.transform(windows, lambda w: F.char_length(w["text"]).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    both = let(
        said,
        lambda t: let(
            F.array_join(read_loss(windows), ""),
            lambda x: F.struct(
                F.size(t).cast("long").alias("n_turns"), F.sha2(F.array_join(t, ""), 256).alias("turns_sha256"),
                F.char_length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256"),
            ),
        ),
    )
    return formatted.select(
        conv_id, F.inline_outer(F.array(both)), chars.alias("formatted_chars"), F.size(windows).cast("long").alias("n_windows")
    )
