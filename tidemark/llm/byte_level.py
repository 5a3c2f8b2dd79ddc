"""Ids of texts by a byte-level tokenizer file, and the bytes of its tokens."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np

from tidemark.llm.token_counts import _is_byte_level

#: What the byte-level scheme writes for the bytes that aren't printable: the characters from 256 on, in order.
_PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_level_bytes(token: str) -> bytes:
    """The bytes that a token of a byte-level vocabulary stands for."""
    return bytes(_BYTE_OF[c] for c in token)


_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class ByteLevel:
    """A byte-level tokenizer file of the library's kind.

    Where its ids follow its merges in order, the same merges run in a faster library; texts with special strings, and other kinds
    of tokenizers, go to the library itself. special: whether these strings are special tokens; else they are plain text.
    """

    def __init__(self, path: str, special: bool = True):
        self.library = load_library(path, special)
        kind = json.loads(self.library.to_str())
        self.specials = tuple(t["content"] for t in kind.get("added_tokens", ())) if special else ()
        self.fast = self._merges(kind) if _is_byte_level(path) else None

    def _merges(self, kind: dict):
        import public_tokenizers
        import tiktoken

        model, added = kind["model"], {t["content"] for t in kind.get("added_tokens", ())}
        ranks = {byte_level_bytes(t): i for t, i in model["vocab"].items() if t not in added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        in_order = [model["vocab"][a + b] for a, b in merges] == sorted(model["vocab"][a + b] for a, b in merges)
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not (plain and in_order and len(ranks) == len(merges) + 256):
            return None
        return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, without tokens at their ends."""
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        plain = self.fast.encode_ordinary
        return [self.library.encode(t, add_special_tokens=False).ids if any(s in t for s in self.specials) else plain(t) for t in texts]


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows one behind the other, and their lengths."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum())), sizes


@lru_cache(maxsize=4)
def byte_level(path: str, special: bool = True) -> ByteLevel:
    return ByteLevel(path, special)


def load_library(path: str, special: bool):
    """The tokenizer without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = not special
    return library
