"""Byte-level BPE ids from the contents of a tokenizers file."""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: how byte-level tokenizers cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from 256."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printing]
    return {b: b for b in printing} | {b: 256 + k for k, b in enumerate(others)}


def ranks_of(kind: dict) -> dict[bytes, int]:
    """Bytes and id of every token but the special ones."""
    letters = {chr(c): b for b, c in byte_letters().items()}
    special = {x["content"] for x in kind["added_tokens"]}
    return {bytes(letters[c] for c in token): k for token, k in kind["model"]["vocab"].items() if token not in special}


def is_byte_level(kind: dict) -> bool:
    before = kind["pre_tokenizer"] or {}
    return kind["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]


class ByteLevel:
    """Ids of whole texts, without added special tokens.

    tiktoken merges by the file's vocabulary; it gives up on white space of several hundred thousand
    characters, and such texts go to the tokenizers library. So do texts that hold a special token's
    string, where ``specials`` asks for its id, and all texts where the file is of another kind.
    """

    def __init__(self, content: bytes, specials: bool, pattern: str = PATTERN):
        import tiktoken
        from tokenizers import Tokenizer

        kind = json.loads(content)
        self.slow = Tokenizer.from_str(content.decode())
        self.slow.encode_special_tokens = not specials
        self.special = [x["content"] for x in kind["added_tokens"]] if specials else []
        self.fast = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks_of(kind), special_tokens={}) if is_byte_level(kind) else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(x in text for x in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:  # its pattern ran out of room to look back
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
