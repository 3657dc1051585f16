"""Reading tokenizer files. Nothing here is trained, and no vocabulary is kept in this repository."""

from __future__ import annotations

import json
from functools import lru_cache

#: The pre-tokenizer's pattern of byte-level BPE files with use_regex (fixed value of that format).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself,
    the other bytes have the code points from 256 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def to_bytes(token: str) -> bytes:
    table = byte_chars()
    return bytes(table[c] for c in token)


@lru_cache(2)
def byte_bpe(path: str):
    """(bytes of a token to its id, special strings to their ids) of a byte-level BPE file whose merges come in
    the order of their ids; anything else is refused."""
    data = load(path)
    model, special = data["model"], {t["content"]: t["id"] for t in data["added_tokens"]}
    vocab = {to_bytes(token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab[to_bytes(a + b)] for a, b in merges]
    if made != sorted(set(made)) or {vocab[bytes([b])] for b in range(256)} | set(made) != set(vocab.values()):
        raise ValueError(f"{path}: its merges are not in the order of its ids")
    return vocab, special
