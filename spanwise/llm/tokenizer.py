"""Token ids by public byte-level BPE vocabularies, which are read, never trained or copied.

Workers read the vocabulary by its path; an encoder is kept per process.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable

import numpy as np

#: Fixed value: the pattern by which byte-level BPE vocabularies of 50k split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Encode = Callable[[str], np.ndarray]
_loaded: dict[str, Encode] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins of bytes in JSON vocabularies: printable bytes are themselves, others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _rank_encoder(ranks: dict[bytes, int]) -> Encode:
    import tiktoken

    bpe = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: bpe.encode_to_numpy(text, disallowed_special=())


def _json_encoder(path: str) -> Encode:
    """The JSON file's own library, or its vocabulary as merge ranks where both give the same ids.

    They do where the ids follow the order of the merges, the text is split by
    ``SPLIT`` and it holds no special token; the ranks are several times faster.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def plain(text: str) -> np.ndarray:
        return np.asarray(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    special = [t["content"] for t in spec.get("added_tokens", [])]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    ordered = all(x < y for x, y in zip(ids, ids[1:])) and bool(ids) and ids[0] >= 0
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not (ordered and byte_level and not spec.get("normalizer") and model.get("type") == "BPE"):
        return plain
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in t): k for t, k in model["vocab"].items() if t not in special}
    fast = _rank_encoder(ranks)
    return lambda text: plain(text) if any(s in text for s in special) else fast(text)


def encoder(path: str) -> Encode:
    """``text -> uint32 ids`` for a ``.json`` or ``.tiktoken`` vocabulary file."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            _loaded[path] = _json_encoder(path)
        else:
            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            _loaded[path] = _rank_encoder(ranks)
    return _loaded[path]
