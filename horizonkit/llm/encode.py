"""Ids of whole texts from the tokenizers library, each word's merges done once.

For texts of ASCII and Latin-1 letters the two vocabularies' splitting rules
are plain patterns; their words then go through the library's model once, for
as long as its ids are remembered. Any other text, or another kind of vocabulary file, goes through
the library whole. A text holding an added token's string gets that token's id there, as in the
library's plain call. Long texts are cut where no rule can join characters, so
that memory stays bounded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np

#: Characters of a text handled at a time.
PART = 1 << 18
#: Words remembered in each of two generations; longer ones are not remembered.
REMEMBERED, LONGEST = 400_000, 64

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(f"[^\\t\\n\\r\\x20-\\x7e{_LETTER}]")
#: A space between two visible ASCII characters: both vocabularies always split before it.
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
#: The splitting rules for such texts, by the pre-tokenizer and normalizer that a file states.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_SPACED = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACELESS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+")
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_letters() -> dict[int, int]:
    """Byte-level vocabularies' letters: visible bytes stand for themselves, the others for 256 and up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: 256 + i for i, b in enumerate(hidden)}


def splitter(rules: dict) -> Callable[[str], list[str]] | None:
    """The words of a plain text under a vocabulary's rules; None for rules other than the two known."""
    pre, norm = rules["pre_tokenizer"], rules["normalizer"]
    if rules["model"]["type"] != "BPE" or rules["model"]["dropout"]:
        return None
    if pre == _BYTE_LEVEL and norm is None:
        return _SPACED.findall
    if norm and norm.get("normalizers") == _LOWER and pre.get("pretokenizers") == [
            {"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True},
            _BYTE_LEVEL | {"use_regex": False}]:
        return lambda text: _SPACELESS.findall(text.lower())
    return None


class Encoder:
    """``encode(text)``: its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items() if t.content}
        #: Added tokens part a text before any rule of the vocabulary; those with rules of their own are left to the library.
        self.own_rules = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.parted = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.split = splitter(json.loads(self.tokenizer.to_str()))
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words = _Remembered(self._word)

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def _parts(self, text: str) -> Iterable[str]:
        at = 0
        while len(text) - at > PART and (m := _CUT.search(text, at + PART)):
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: bytes) -> bytes:
        whole = text.decode()
        if self.own_rules:
            return np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, "<u4").tobytes()
        if any(map(whole.__contains__, self.added)):
            return b"".join(self.added.get(x) or self._ordinary(x) for x in self.parted.split(whole) if x)
        return self._ordinary(whole)

    def _ordinary(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        out = []
        for part in self._parts(text):
            if self.split and not _OTHER.search(part):
                out.append(b"".join(map(self.words.__getitem__, self.split(part))))
                self.words.turn()
            else:
                ids = self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids
                out.append(np.array(ids, "<u4").tobytes())
        return b"".join(out)


class _Remembered(dict):
    """Ids by word: what isn't here comes from the generation before, or from the model."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
