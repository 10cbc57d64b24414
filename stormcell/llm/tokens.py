"""Pre-tokens and ids of a byte-level BPE file, exactly as the tokenizers
library gives them.

The ids of a text are those of its pre-tokens one after the other, so they are
computed once per distinct pre-token.  Latin texts are cut with a compiled
pattern; any other text is cut by the library itself.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

from .common import CACHE_ROWS, LATIN

_NOT_LATIN = re.compile(f"[^\x00-\x7f{re.escape(LATIN)}]")
_L = "A-Za-z" + re.escape(LATIN)
#: The byte-level pre-tokenizer's pattern, its classes spelled out for Latin texts.
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def load(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    import json

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex")
            or spec.get("normalizer")):
        raise ValueError(f"{path}: only byte-level BPE without a normaliser is supported")
    special = [t["content"] for t in spec["added_tokens"]]
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
    return tok, (cut if special else None)


def pretokens(text: str | None, path: str) -> list[str]:
    """The text in pieces that are encoded one by one; special strings are
    pieces of their own."""
    if not text:
        return []
    tok, cut = load(path)
    if cut and cut.search(text):
        parts = cut.split(text)
        return [x for k, p in enumerate(parts) if p for x in ([p] if k % 2 else _plain(p, tok))]
    return _plain(text, tok)


#: White space for Python's pattern but not for the library's.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


#: Characters of a text that is encoded in one call: a pattern's steps back are
#: bounded, and a longer run of white space would pass the bound.
WHOLE = 1 << 18


def _latin(text: str) -> bool:
    """Whether ``_PRE`` cuts the text as the library does."""
    return ((text.isascii() or not _NOT_LATIN.search(text))
            and not any(c in text for c in _SEPARATORS))


def _plain(text: str, tok) -> list[str]:
    if _latin(text):
        return _PRE.findall(text)
    return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoders(path: str):
    """Functions from a pre-token to its ids, and from a whole Latin text without
    special strings to an array of them.

    Merges that come in the order of their ids are ranks, and the tiktoken
    library applies those several times faster; any other file is left to the
    tokenizers library, and has no second function.
    """
    import json

    tok, _ = load(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in made]
    if ids != sorted(set(ids)):
        return lambda piece: tok.encode(piece, add_special_tokens=False).ids, None
    import tiktoken
    byte = _bytes_of_symbols()
    ranks = {bytes(byte[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    known = {s: [model["vocab"].get(s, tok.token_to_id(s))] for s in special}
    latin = tiktoken.Encoding("latin", pat_str=_PRE.pattern, mergeable_ranks=ranks, special_tokens={})
    return (lambda piece: known.get(piece) or fast.encode_ordinary(piece),
            lambda text: latin.encode_to_numpy(text, disallowed_special=()))


@lru_cache(maxsize=2)
def words_stay(path: str) -> bool:
    """Whether no special string could be found inside a word."""
    special = load(path)[0].get_added_tokens_decoder().values()
    return not any(t.content.replace(" ", "").isalpha() for t in special)


def spaced(chunk: str, path: str) -> list[str]:
    """Pre-tokens of a chunk that :func:`parted` gave, and of the space before it."""
    text = " " + chunk
    if chunk.isalpha() and words_stay(path):
        return [text]
    cut = load(path)[1]
    return pretokens(text, path) if cut and cut.search(text) else _PRE.findall(text)


def parted(text: str | None, path: str) -> tuple[list[str], list[str]]:
    """Pre-tokens of the text as far as its first space, and the chunks after it,
    each without the space before it; all pre-tokens of a text without chunks."""
    if not text:
        return [], []
    if not _spaces_cut(text):
        return pretokens(text, path), []
    first, *rest = text.split(" ")
    return pretokens(first, path), rest


_OTHER_SPACE = ("  ", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")


def _spaces_cut(text: str) -> bool:
    """Whether the pre-tokens of a text are those of its chunks, cut before each
    space: not where that could cut a run of white space.  A single space between
    other characters always begins a pre-token."""
    return ((text.isascii() or not _NOT_LATIN.search(text))
            and not any(x in text for x in _OTHER_SPACE))


def chunks(text: str) -> list[str] | None:
    """The text cut before each space, or None where that could cut a run of
    white space."""
    if not _spaces_cut(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + c for c in rest]]


class Ids(dict):
    """Ids of a chunk as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.encode = path, encoders(path)[0]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ROWS:
            self.clear()
        ids = [i for p in pretokens(piece, self.path) for i in self.encode(p)]
        self[piece] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def encode(text: str | None, path: str) -> bytes:
    """All ids of a text, four bytes each."""
    if not text:
        return b""
    whole = encoders(path)[1]
    if whole and len(text) <= WHOLE and _latin(text):
        cut = load(path)[1]
        if not (cut and cut.search(text)):
            return whole(text).astype("<u4", copy=False).tobytes()
    return b"".join(map(_ids(path).__getitem__, chunks(text) or pretokens(text, path)))


def n_pieces(pieces: list[str], path: str) -> list[int]:
    """Number of ids of each pre-token."""
    encode_one, whole = encoders(path)
    if whole:
        return [len(encode_one(p)) for p in pieces]
    tok = load(path)[0]
    return [len(e.ids) for e in tok.encode_batch(pieces, add_special_tokens=False)]

