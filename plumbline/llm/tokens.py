"""Token ids of texts, with the pieces between spaces remembered."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

import numpy as np

MOST_REMEMBERED = 400_000  # pieces of one task, about 100 MB
_vocabularies: dict[str, Callable] = {}

# White space beside a space: there a token may reach across the space.
_CROSSED = re.compile(r"\s \s?| \s|^ | $")
_SEPARATE = re.compile(r"(?<=\S) (?=\S)")


def encoder(path: str | None = None) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit numbers.

    ``path`` is a file of the tokenizers library. Without one it is the public
    byte-level vocabulary of 50k entries, for which a faster way is taken: its
    rank file gives the same ids, and its pre-tokenizer starts a new token at
    every single space between two other characters, so that the pieces between
    such spaces are encoded, and remembered, by themselves. What is remembered
    goes with the function: a worker lives on, and the tasks of later stages need
    its memory. The vocabulary stays, one for each worker process and file.
    """
    if path:
        return _vocabulary(path, lambda: _by_file(path))
    return _by_ranks(_vocabulary("", _rank_file))


def _vocabulary(key: str, load: Callable[[], Callable]) -> Callable:
    if key not in _vocabularies:
        _vocabularies[key] = load()
    return _vocabularies[key]


def _by_file(path: str) -> Callable[[str], bytes]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: _bytes(tokenizer.encode(text, add_special_tokens=False).ids)


def _rank_file() -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def _by_ranks(ordinary: Callable[[str], list[int]]) -> Callable[[str], bytes]:
    import public_tokenizers

    whole: list[Callable[[str], bytes]] = []
    known: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if "<|endoftext|>" in text:  # the vocabulary's only special token
            if not whole:
                whole.append(_by_file(public_tokenizers.path("byte_bpe_50k.json")))
            return whole[0](text)
        pieces = _SEPARATE.split(text) if _CROSSED.search(text) else text.split(" ")
        # Every piece but the first has its space before it.
        rest = pieces[1:]
        missing = [p for p in set(rest) if p not in known]
        found = known
        if missing:
            new = {p: _bytes(ordinary(" " + p)) for p in missing}
            if len(known) < MOST_REMEMBERED:
                known.update(new)
            else:
                found = _Both(known, new)
        return _bytes(ordinary(pieces[0])) + b"".join([found[p] for p in rest])

    return encode


class _Both(dict):
    """The entries of a text that are not to be remembered, and behind them the others."""

    def __init__(self, known: dict[str, bytes], new: dict[str, bytes]) -> None:
        super().__init__(new)
        self.known = known

    def __missing__(self, piece: str) -> bytes:
        return self.known[piece]


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()
