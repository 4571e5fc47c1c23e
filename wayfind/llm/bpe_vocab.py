"""A byte-level BPE vocabulary read from its JSON file: ranks, byte strings, split pattern."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken

#: The letters, numbers below U+0250, by which the quick pattern equals the general one there.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: White space below U+0250 as the vocabulary's pattern has it; re's own class also takes U+001C to U+001F.
SPACES = "\t-\r \x85\xa0"
#: All white space of the pattern.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
QUICK = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
BEYOND = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoding, decoding and splitting with one vocabulary.

    The file's merges must be in the order of the ids they make (checked here), so
    that merging by id equals merging by the file's list.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ranks = {as_bytes(t): i for t, i in vocab.items()}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])) or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: merges aren't in the order of ids, or a prefix space is added")
        self.token_bytes = {i: b for b, i in self.ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.engine = tiktoken.Encoding(
            "from-json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special
        )
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> list[int]:
        """The ids of a text; strings of special tokens become their ids."""
        return self.engine.encode(text, allowed_special="all")

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece of the split: exact merges, no special tokens."""
        return self.engine.encode_ordinary(piece)

    def pieces(self, text: str) -> list[str]:
        """The split of a text without special tokens before the merges."""
        return (self.pattern if BEYOND.search(text) else QUICK).findall(text)

    def parts(self, text: str) -> list[str]:
        """The text cut at strings of special tokens, these at odd places."""
        return self.split_special.split(text) if self.split_special else [text]


@lru_cache(maxsize=4)
def load(name_or_path: str) -> Bpe:
    """One vocabulary for each Python worker. A bare name is one of the installed public files."""
    return Bpe(name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path))
