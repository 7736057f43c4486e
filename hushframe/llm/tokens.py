"""Token ids of whole texts, with the public tokenizer files.

The tokenizers cut a text into pre-tokens (words, numbers, punctuation runs) before they
merge anything, so a text's ids are its pre-tokens' ids side by side. Words repeat, so each
Python worker keeps a bounded table from pre-token to ids and asks the tokenizer library's
model only for those it has not seen. That holds for texts in ASCII, Latin letters and
general punctuation, where the patterns below are exact; any other text, and any that holds
the string of an added token, goes through the library whole. The tests compare both ways.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from pathlib import Path

#: Pre-tokens kept per worker, some 90 MB.
MOST_PIECES = 400_000
#: Longer pre-tokens are not kept.
LONGEST = 64
#: The characters for which the patterns are exact, but for those whose lower case is not among them.
EXACT = "\x00-\u024f\u2010-\u2027\u2030-\u205e"
LEAVING = "".join(c for c in map(chr, range(0x250)) if max(c.lower()) > "\u024f")
UNUSUAL = re.compile(f"[^{EXACT}]|[{LEAVING}]")
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: By kind of pre-tokenizer: the pattern of a pre-token, and whether text is lower-cased first.
KINDS = {
    "spaced": (re.compile(f"{ENDINGS}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"), False),
    "words": (re.compile(f"{ENDINGS}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"), True),
}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the
    others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


def exact(text: str) -> bool:
    """Whether the patterns are exact for a text. They are for all of Latin-1, which is quickly told."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not UNUSUAL.search(text)
    return True


class Kept(dict):
    """A table of what ``make`` gives, of at most ``most`` keys: once half of them are new, those that were
    not asked for since the last time go, and the common ones stay. Long keys stay for one text."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.half, self.before, self.long = make, max(1, most // 2), {}, {}

    def __missing__(self, key: str) -> bytes:
        before = self.before if len(key) <= LONGEST else self.long
        got = before.get(key)
        if got is None:
            got = self.make(key)
        if before is self.long:
            before[key] = got
            return got
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """``ids(text)``: the ids that the library's ``encode(text, add_special_tokens=False)``
    gives, as little-endian unsigned 32-bit integers, as bytes."""

    loaded: dict[str, Encoder] = {}

    def __init__(self, path: str, most: int = MOST_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not Path(path).exists():
            raise FileNotFoundError(f"no tokenizer file at {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known = Kept(self.asked, most)
        about = json.loads(Path(path).read_text(encoding="utf-8"))
        self.added = [t["content"] for t in about.get("added_tokens") or []]
        before, normal = about.get("pre_tokenizer") or {}, about.get("normalizer")
        self.kind = None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None:
            self.kind = "spaced"
        elif before.get("type") == "Sequence" and [x["type"] for x in before["pretokenizers"]] == ["Split", "ByteLevel"] and normal and [x["type"] for x in normal["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "words"

    @classmethod
    def get(cls, path: str, most: int = MOST_PIECES) -> Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path, most)
        return cls.loaded[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def asked(self, piece: str) -> bytes:
        """The ids of a pre-token, from the model."""
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", "\u0120")
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def ids(self, text: str) -> bytes:
        if self.kind is None or not exact(text) or any(t in text for t in self.added):
            return self.whole(text)
        pattern, lower = KINDS[self.kind]
        self.known.long.clear()
        return b"".join(map(self.known.__getitem__, pattern.findall(text.lower() if lower else text)))
