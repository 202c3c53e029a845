"""Token counts and ids of whole texts with public vocabularies."""

from __future__ import annotations

import base64
import json

import tiktoken

from resight.llm.common import worker_store


def load_encoder(ranks_path: str, pattern: str, added_path: str | None = None) -> tiktoken.Encoding:
    """An encoder from a rank file; with `added_path` (a tokenizers file) its added tokens are found in texts as there.

    The rank file and the tokenizers file hold the same vocabulary, and both libraries give the same ids; this one is
    about five times as fast. The tests compare them.
    """
    held = worker_store("tiktoken")
    key = (ranks_path, pattern, added_path)
    if key not in held:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        added = {}
        if added_path is not None:
            with open(added_path, encoding="utf-8") as text:
                added = {t["content"]: t["id"] for t in json.load(text)["added_tokens"]}
        held[key] = tiktoken.Encoding(f"ranks-{len(held)}", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return held[key]
