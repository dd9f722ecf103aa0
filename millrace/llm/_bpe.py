"""Byte-level BPE over the tokenizers library, with pre-tokens as the unit of reuse.

A byte-level BPE encoding is the concatenation of its pre-tokens' encodings, and natural text repeats few pre-tokens
very often. So a worker keeps pre-token -> ids (as little-endian uint32 bytes) and joins bytes; only a pre-token not
seen lately reaches the library's BPE model. Texts with characters on which two regex engines could differ, and
tokenizer files of another kind, take the library's own ``encode`` for the whole text: ids are equal always.
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

# Letters (Latin, Greek, Cyrillic, kana, Han, Hangul) and other characters whose classes all engines agree on.
LETTERS = "A-Za-zµÀ-ÖØ-öø-ʯΑ-Ρα-ωА-яぁ-ゖァ-ヺ一-鿋가-힣"
SAFE = re.compile(rf"[\t\n\r -~¡-©«-®°±´-¸»¿×÷‐-‧‰-⁞€{LETTERS}]*")
# The byte-level pre-token pattern for texts inside SAFE, where LETTERS is \p{L} and \d is \p{N}. Words stand first,
# being commonest; no other branch can match where they do.
PATTERN = re.compile(rf" ?[{LETTERS}]+|'(?:[sdmt]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

#: A match may change by what follows it only if it is one of the last three of its text ("'" + "l" + "l").
UNSURE = 3


class PretokenCache(dict):
    """pre-token -> packed ids; two generations, so memory is bounded and what is in use stays."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.model, self.limit, self.old = model, limit, {}
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the library's own cache would hold the same pieces again
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        self.table = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        v = self.old.get(piece)
        if v is None:
            mapped = "Ġ" + piece[1:] if piece[0] == " " and piece[1:].isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
            v = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = v
        return v


class BpeCoder:
    """Encodes whole texts to packed ids exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str, cache: int = 500_000):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = spec.get("added_tokens") or []
        self.byte_level = (
            spec.get("normalizer") is None
            and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.cache = PretokenCache(self.tok.model, cache)

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bool:
        """Whether the pre-token path is proven for this text."""
        return self.byte_level and SAFE.fullmatch(text) is not None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain(text):
            return self.whole(text)
        return self.by_segment(text, self.segment)

    def segment(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, PATTERN.findall(text)))

    def by_segment(self, text: str, encode) -> bytes:
        """Special strings become their ids; the text between them goes to ``encode``."""
        if self.split is None or not any(s in text for s in self.special):
            return encode(text)
        return b"".join(self.special[s] if k % 2 else encode(s) for k, s in enumerate(self.split.split(text)))


_coders: dict[tuple, BpeCoder] = {}


def coder(path: str, cache: int = 500_000) -> BpeCoder:
    """One coder a worker process."""
    if (key := (path, cache)) not in _coders:
        _coders.clear()
        _coders[key] = BpeCoder(path, cache)
    return _coders[key]
