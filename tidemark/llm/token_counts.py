"""Token counts: a tokenizer runs inside Arrow functions that return lengths only.

Batches are balanced by bytes, and long texts are cut where the pre-tokenizer cuts anyway, so that the counts add up; what has no
such place (a long run of letters alone) goes whole. Null counts as the empty text; an empty text has 0 bytes and 0 tokens.
Repeated rows are counted each; an empty table gives no rows. Columns n_bytes, n_tokens and over_limit of the input are replaced;
others may stay (`keep`).
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import byte_texts, extend

#: Pieces of a long text hold about this many characters.
PIECE_CHARS = 16_384
#: A batch that goes to the tokenizer at once holds about this many bytes.
BATCH_BYTES = 1 << 20
#: Where byte-level pre-tokenizers start a new token in any text: before white space, between letters and digits, and before the
#: punctuation of Chinese and Japanese behind a letter.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=[\u3001\u3002\uFF01\uFF0C\uFF1A\uFF1B\uFF1F])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def split_long(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text in pieces of at least `most` characters, each cut at a safe place; whole if there is none."""
    out, at = [], 0
    while len(text) - at > 2 * most:
        found = _SAFE.search(text, at + most)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


@lru_cache(maxsize=4)
def _is_byte_level(path: str) -> bool:
    """Whether the pre-tokenizer is the byte-level one with its pattern, for which _SAFE holds; special strings hold no such place."""
    if not path.endswith(".json"):
        return False
    import json

    kind = json.loads(_load(path).to_str())
    before = kind.get("pre_tokenizer") or {}
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and kind.get("normalizer") is None
    return byte_level and not any(_SAFE.search(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in kind.get("added_tokens", ()))


def count(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    tokenizer, can_split = _load(path), _is_byte_level(path)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        parts = split_long(text) if can_split else [text]
        pieces += parts
        owner += [i] * len(parts)
    lengths = np.zeros(len(pieces), np.int64)
    sizes = [len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in pieces]
    at = 0
    while at < len(pieces):
        end, held = at, 0
        while end < len(pieces) and (end == at or held + sizes[end] <= BATCH_BYTES):
            held += sizes[end]
            end += 1
        if path.endswith(".model"):
            lengths[at:end] = [len(x) for x in tokenizer.encode(pieces[at:end], num_threads=1)]
        else:
            lengths[at:end] = [len(x) for x in tokenizer.encode_batch_fast(pieces[at:end], add_special_tokens=False)]
        at = end
    return np.bincount(np.array(owner, np.int64), lengths, len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str | None = None, limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit (n_tokens > limit); without shuffles, a row for each row."""
    path = tokenizer or default_tokenizer()

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        raw = byte_texts(batch.column(text))
        n = count([b.decode("utf-8", "replace") for b in raw], path)
        return [pa.array([len(b) for b in raw], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())]

    return extend(docs, text, {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}, run, keep)
