"""Token ids of whole texts, by the tokenizers library, through pieces that repeat.

Both kinds of tokenizer used here treat the text between two white-space
boundaries on its own, so the ids of a text are the ids of its pieces joined.
A worker encodes a piece once and keeps a bounded table of pieces; a run of
Latin letters goes straight to the tokenizer's model, which its other steps
would hand it unchanged, and the marks and digits between such runs, which are
few, are kept in a table of their own.  Tokenizers whose rules are unknown to this module
encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from operator import attrgetter

import numpy as np

#: pieces in the younger of two generations; what is used again moves from the older one
CACHED_PIECES = 250_000
LONGEST_CACHED = 64
#: runs between letters that are kept
CACHED_MARKS = 20_000
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: letters, ASCII marks but the apostrophe, digits and single line ends inside: both kinds part them where letters begin and end
_SIMPLE = re.compile(rf"(?!\n)(?:[{_LATIN}!-&(-@\[-`{{-~]|\n(?!\n))+")
_RUNS = re.compile(rf"[{_LATIN}]+|[^{_LATIN}]+")
_ID = attrgetter("id")
_TWO_SPACES = re.compile(r"\s\s")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    before, normal = rules.get("pre_tokenizer") or {}, rules.get("normalizer") or {}
    if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not normal:
        return "space-led"
    steps = [s.get("type") for s in before.get("pretokenizers", [])]
    if before.get("type") == "Sequence" and steps[:1] == ["Split"] and before["pretokenizers"][0].get("invert") \
            and before["pretokenizers"][0].get("behavior") == "Removed" \
            and {s["type"] for s in normal.get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}:
        return "space-free"
    return "whole"


class Encoder:
    """``encoder(texts)`` gives one array of ids per text; the ids fit ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(path)
        self.lead = " " if self.kind == "space-led" else ""
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(32, 256) if chr(c) == " " or chr(c).isalpha()]
        self.spelled = str.maketrans({c: byte_level.pre_tokenize_str(c)[0][0] for c in letters})
        self.spelled_lead = self.lead.translate(self.spelled)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        added = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values() if t.content}
        self.may_be_added = re.compile("[" + re.escape("".join(sorted(added))) + "]") if added else re.compile(r"(?!)")
        self.known: dict[str, bytes] = {}  # word: ids of the word with its leading space, where the kind has one

    def _alone(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _letters(self, word: str, lead: str) -> bytes:
        """Ids of a run of Latin letters: the model's own, since no other step of the tokenizer changes it."""
        if self.kind == "space-free":
            word = word.lower()
        spelled = lead + (word if word.isascii() else word.translate(self.spelled))
        return array(self.code, map(_ID, self.tokenizer.model.tokenize(spelled))).tobytes()

    def _marks(self, run: str) -> bytes:
        ids = self.marks.get(run)
        if ids is None:
            if len(self.marks) >= CACHED_MARKS:
                self.marks.clear()
            ids = self.marks[run] = self._alone(run)
        return ids

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        known, older = self.known, self.older
        for word in words:
            ids = older.get(word)
            if ids is None:
                if word.isalpha() and _SIMPLE.fullmatch(word):
                    ids = found.get(word) or self._letters(word, self.spelled_lead)
                elif _SIMPLE.fullmatch(word) and not self.may_be_added.search(word):
                    first, *rest = _RUNS.findall(word)
                    if first.isalpha():
                        ids = known.get(first) or found.get(first) or older.get(first)
                        if ids is None:
                            ids = found[first] = self._letters(first, self.spelled_lead)
                    else:
                        ids = self._marks(self.lead + first)
                    for run in rest:
                        if not run.isalpha():
                            ids += self._marks(run)
                            continue
                        inner = run + " "  # no piece ends in a space that follows a letter
                        own = known.get(inner) or found.get(inner) or older.get(inner)
                        if own is None:
                            own = found[inner] = self._letters(run, "")
                        ids += own
                else:
                    ids = self._alone(self.lead + word)
            found[word] = ids
        return found

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.kind == "whole":
            return [np.frombuffer(self._alone(t), dtype=self.dtype) for t in texts]
        if len(self.known) > CACHED_PIECES:
            self.known, self.older = {}, self.known
        known, split, missing = self.known, [], set()
        for text in texts:
            first = b""
            if self.kind == "space-free":
                words = text.replace("\n", " ").split(" ")
            elif _TWO_SPACES.search(text):
                head, *rest = _BEFORE_SPACE.split(text)
                first, words = self._alone(head), [p[1:] for p in rest]
            else:
                head, *words = text.split(" ")
                first = self._alone(head)
            missing.update(words)
            split.append((first, words))
        missing = missing.difference(known)
        new = self._learn(missing)
        known.update(new)
        out = [np.frombuffer(first + b"".join(map(known.__getitem__, words)), dtype=self.dtype) for first, words in split]
        for word in missing:
            if len(word) > LONGEST_CACHED or "\n" in word:
                del known[word]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """One encoder per worker and file; it outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
