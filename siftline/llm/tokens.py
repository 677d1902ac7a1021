"""Token ids of the public byte-level BPE vocabulary, the same on every worker."""

from __future__ import annotations

import base64
import os

import numpy as np

#: Fixed values of the vocabulary: its file names and the id of its one special token.
JSON_NAME = "byte_bpe_50k.json"
RANKS_NAME = "byte_bpe_50k.tiktoken"
END_TEXT = "<|endoftext|>"
END_ID = 50256

_cache: dict = {}


def _encoder(ranks_path: str):
    import public_tokenizers
    import tiktoken

    if ranks_path not in _cache:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _cache[ranks_path] = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _cache[ranks_path]


def _reference(json_path: str):
    from tokenizers import Tokenizer

    if json_path not in _cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _cache[json_path] = Tokenizer.from_file(json_path)
    return _cache[json_path]


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(JSON_NAME), public_tokenizers.path(RANKS_NAME)


def encode(text: str | None, specials: bool, json_path: str, ranks_path: str) -> np.ndarray:
    """uint32 ids of text (None: empty).

    The rank file holds the same vocabulary as the JSON file and encodes several times
    faster to the same ids (tests compare them). specials=True follows the JSON file's
    default and maps the special token's string to its id; that rare text goes through
    the JSON tokenizer itself. specials=False reads that string as ordinary text.
    """
    if not text:
        return np.empty(0, np.uint32)
    if specials and END_TEXT in text:
        return np.array(_reference(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(_encoder(ranks_path).encode_ordinary(text), np.uint32)
