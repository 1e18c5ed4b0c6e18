"""Encoding whole texts with a public tokenizer, each distinct unit once."""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

from attesta.llm.common import chunks

#: A space between two characters that are not white space: both tokenizer families start a new piece there.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class UnitEncoder:
    """Ids of a text, exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Byte-level and word-end BPE never join characters over a single space or
    line feed between two others that aren't white space. So a text is cut
    there and each distinct unit is encoded once, letters apart from the marks
    after them; the ids of a unit are kept as
    bytes, and those of a text are joined from them. The cache is bounded: when
    the young generation holds ``limit`` units it becomes the old one, and what
    the old one held without being used again since is let go.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocab = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.limit = limit
        # Many units are encoded in one call, a bar after each; the bar is a piece and an id of its own.
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.bar = ids(" |")
        # Latin letters are put in lower case before they are looked up if the tokenizer does so itself.
        self.lower = ids("A\u00c9 \u00de") == ids("a\u00e9 \u00fe")
        # A unit of ASCII letters is one piece: the same model takes it without normaliser and patterns.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.lead = "\u0120" if (self.tokenizer.id_to_token(ids(" a")[0]) or "").startswith("\u0120") else ""
        if self.plain.encode(f"{self.lead}abcxyz {self.lead}|", add_special_tokens=False).ids != ids(" abcxyz |"):
            self.plain = None
        # A unit that follows a space is kept without it; one at the start of a text is kept after a NUL.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _look_up(self, wanted: set[str]) -> None:
        """Bring all wanted units into the young generation."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        wanted.difference_update(self.young)
        old, young = self.old, self.young
        missing, compound = [], []
        for x in wanted:
            if (known := old.get(x)) is not None:
                young[x] = known
            elif len(base := x.rstrip(_MARKS)) < len(x) and base.isalpha():
                compound.append((x, base, "\0" + x[len(base) :]))
            else:
                missing.append(x)
        if compound:
            parts = {p for _, *pair in compound for p in pair}.difference(young, missing)
            for x in parts:
                if (known := old.get(x)) is not None:
                    young[x] = known
                else:
                    missing.append(x)
        letters, joined, alone = [], [], []
        for x in missing:
            if x[:1] == "\0" or "|" in x:
                alone.append(x)
            elif self.plain is not None and x.isalpha() and x.isascii():
                letters.append(x)
            else:
                joined.append(x)
        if len(self.bar) != 1:
            alone, joined, letters = missing, [], []
        lead, bar = self.lead, f" {self.lead}| "
        self._encode_joined(letters, self.plain, lambda some: lead + f"{bar}{lead}".join(some) + bar, alone)
        self._encode_joined(joined, self.tokenizer, lambda some: "".join([x + " |" if x[:1] == "\n" else f" {x} |" for x in some]), alone)
        plain = [x[1:] if x[:1] == "\0" else x if x[:1] == "\n" else " " + x for x in alone]
        for x, e in zip(alone, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False), strict=True):
            young[x] = array(self.code, e.ids).tobytes()
        for x, base, marks in compound:
            young[x] = young[base] + young[marks]

    def _encode_joined(self, units: list[str], tokenizer, join, alone: list[str]) -> None:
        """Encode units many at once; those whose ends can't be told apart are left to ``alone``."""
        young, width = self.young, self.dtype.itemsize
        for some in chunks(units, 512):
            ids = np.array(tokenizer.encode_batch_fast([join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.bar[0])
            if len(ends) != len(some):
                alone.extend(some)
                continue
            raw = ids.tobytes()
            stops = (ends * width).tolist()
            starts = [0, *((ends[:-1] + 1) * width).tolist()]
            for x, i, j in zip(some, starts, stops, strict=True):
                young[x] = raw[i:j]

    def encode_batch(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """One array of ids for each text, ``end_id`` after them if given."""
        split, wanted = [], set()
        # With as many words as single separators, no white space stands beside another or at an end.
        for text in texts:
            if self.lower and text.isascii() or self.lower and _latin(text):
                text = text.lower()
            if text.count(" ") + text.count("\n") + 1 != len(text.split()) or "\0" in text:
                head, *rest = _CUT.split(text)
                units = ["\0" + head, *(x[1:] for x in rest)]
                if any(x[:1] in "\n\0" for x in units[1:]):
                    units = ["\0" + text]
            else:
                units = text.replace("\n", " \n").split(" ")
                units[0] = "\0" + units[0]
            split.append(units)
            wanted.update(units)
        self._look_up(wanted)
        end = b"" if end_id is None else array(self.code, [end_id]).tobytes()
        get = self.young.__getitem__
        return [np.frombuffer(b"".join(map(get, units)) + end, self.dtype) for units in split]


#: Marks that are a piece apart from the letters before them in either family.
_MARKS = ".,;:!?*&%$#|()[]{}\"-_/+="

assert sys.byteorder == "little"

_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The process's encoder of a tokenizer file; workers that are reused keep its cache."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Let go of the process's encoders: other work in a worker that is reused shall have their memory."""
    _ENCODERS.clear()
