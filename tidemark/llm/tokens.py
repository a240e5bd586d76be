"""Token ids by a byte-level BPE vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import tiktoken

#: The split pattern of byte-level BPE (a fixed value of the file format's pre-tokenizer "ByteLevel").
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    """The 50k byte-level vocabulary of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level files spell printable bytes as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The file's vocabulary as ranks; gives the ids that ``tokenizers`` gives, several times as fast.

    Strings of special tokens in a text are ordinary text; see :func:`encode`.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} is no byte-level BPE file without prefix space and normalizer")
    special = {t["content"] for t in spec["added_tokens"]}
    byte = _byte_of_char()
    ranks = {bytes(map(byte.__getitem__, token)): k for token, k in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """What finds the file's added tokens in a text, longest first, and their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} has added tokens that depend on what is around them")
    ids = {t["content"]: t["id"] for t in tokens}
    found = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None
    return found, ids


def encode(text: str | None, path: str, added: bool = False) -> list[int]:
    """``added``: the file's added tokens in a text are their ids, as ``tokenizers`` has it by default."""
    plain, (found, ids) = encoder(path).encode_ordinary, _added(path) if added else (None, {})
    if found is None or not found.search(text or ""):
        return plain(text or "")
    out: list[int] = []
    for k, piece in enumerate(found.split(text)):
        if k % 2:
            out.append(ids[piece])
        else:
            out += plain(piece)
    return out
