"""Token ids of whole texts by public byte-level BPE vocabularies."""

from __future__ import annotations

import base64
import json
import re
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken

#: The Unicode property White_Space (Python's own class holds a few control characters more), and
#: a white-space run of two or more before a word: its last character belongs to the word, so the text can be cut before it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LOOSE_BLANK = re.compile(f"[{WHITE}](?=[{WHITE}][^{WHITE}])")


class BytePairs:
    """Ids of a byte-level BPE as the ``tokenizers`` file ``name.json`` gives them, without added special tokens.

    The same vocabulary is also published as merge ranks, which encode several times faster. Its pattern has a look-ahead
    that matters only where two or more white-space characters stand before a word. Such texts are cut there first, and
    the rest of the pattern is the plain one, which gives the same ids. Strings of special tokens inside a text
    become the id of the special token, the default of the ``tokenizers`` library.
    """

    def __init__(self, name: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
        added = json.load(open(public_tokenizers.path(f"{name}.json"), encoding="utf-8")).get("added_tokens", [])
        self.special = {x["content"]: x["id"] for x in added}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        plain = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")
        self.encoding = tiktoken.Encoding(name, pat_str=plain, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max([*ranks.values(), *self.special.values()])

    def plain(self, text: str) -> list[int]:
        if LOOSE_BLANK.search(text) is None:
            return self.encoding.encode_ordinary(text)
        ids, at = [], 0
        for found in LOOSE_BLANK.finditer(text):
            ids += self.encoding.encode_ordinary(text[at:found.end()])
            at = found.end()
        return ids + self.encoding.encode_ordinary(text[at:])

    def ids(self, text: str) -> list[int]:
        if self.special_pattern is None or self.special_pattern.search(text) is None:
            return self.plain(text)
        ids = []
        for k, part in enumerate(self.special_pattern.split(text)):
            ids += [self.special[part]] if k % 2 else self.plain(part) if part else []
        return ids

    def array(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), np.uint32)


@cache
def byte_pairs(name: str) -> BytePairs:
    """One per Python worker."""
    return BytePairs(name)
