"""Byte-level BPE ids in tasks, through the public vocabulary files."""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import tiktoken

#: The special token that the tokenizer's file recognises in a text.
SPECIAL = {"<|endoftext|>": 50256}
#: White space other than the plain space and newline (the pattern's ``\\s``).
_ODD = "\t\x0b\x0c\r\x85\xa0                　"
_RUNS = ("  ", "\n\n", " \n", "\n ")


@functools.lru_cache(maxsize=2)
def _encodings(ranks_path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    # Without the look-ahead the pattern runs on a plain automaton; it splits alike
    # where no two white-space characters meet.
    plain = pattern.replace(r"\s+(?!\S)|", "")
    make = lambda name, p: tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return make("full", pattern), make("plain", plain)


def byte_bpe(ranks_path: str | None = None):
    """A function from a text to its ids (uint32 array), as the JSON file of the
    same vocabulary gives them without added special tokens."""
    full, plain = _encodings(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            return np.array(full.encode(text, allowed_special="all"), np.uint32)
        simple = not any(x in text for x in _RUNS) and (text.isascii() and not any(x in text for x in _ODD[:4]) or not any(x in text for x in _ODD))
        return (plain if simple else full).encode_to_numpy(text, disallowed_special=())

    return encode


def token_bytes(token: int, ranks_path: str | None = None) -> bytes:
    return _encodings(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))[0].decode_single_token_bytes(token)
