"""Words and byte-pair merging of the public word-end BPE vocabulary (tokenizers .json files).

The text rules are those of the file: special strings are cut out of the raw text first, then NFC, white
space runs to one space, lower case, and a split into contractions, letter runs, single digits and
symbol runs. No piece spans white space, so a white-space word's result depends on the word alone and
can be kept.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata

import regex

#: Characters of the quick path; others go through the library's own normaliser.
_CLOSING = frozenset(".,;:!?")
_UNUSUAL = re.compile("[\x1c-\x1fɐ-\U0010ffff]")


def _latin(text: str) -> bool:
    """Whether a text is Latin-1 (so composed already) and without the separators that only Python takes for space."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """Byte-level BPE's printable stand-in for each byte: itself if printable, else the next code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordText:
    """Cuts a text into white-space words as the vocabulary file's normaliser leaves them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in self.spec.get("added_tokens") or ()}
        names = sorted(map(re.escape, self.specials), key=len, reverse=True)
        self._special = re.compile("|".join(names)) if names else None
        self._path, self._library = path, None

        self.letters = _byte_letters()
        self._byte = {c: b for b, c in enumerate(self.letters)}
        self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def pieces(self, word: str) -> list[bytes]:
        """A word's pieces in UTF-8; for unusual characters the library's own tables decide what is a letter."""
        if _UNUSUAL.search(word):
            return [bytes(map(self._byte.__getitem__, piece)) for piece, _ in self.library().pre_tokenizer.pre_tokenize_str(word)]
        return [p.encode() for p in self._pieces.findall(word)]

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def words(self, text: str) -> list[str]:
        if _latin(text):
            return text.lower().split()
        if not _UNUSUAL.search(text):
            return unicodedata.normalize("NFC", text).lower().split()
        return self.library().normalizer.normalize_str(text).split(" ")

    def segments(self, text: str):
        """Yields ("text", words) and ("special", id) in order."""
        if self._special is None or "<" not in text:
            yield "text", self.words(text)
            return
        at = 0
        for m in self._special.finditer(text):
            if m.start() > at:
                yield "text", self.words(text[at : m.start()])
            yield "special", self.specials[m.group()]
            at = m.end()
        if at < len(text):
            yield "text", self.words(text[at:])


class Kept(dict):
    """What `piece` gives for each word's pieces, added up; starts anew once it holds `most` words.

    Most words are letters, or letters and one closing mark, which are two pieces; both parts are looked up.
    """

    def __init__(self, text: WordText, piece, most: int, nothing):
        super().__init__()
        self._text, self._piece, self._most, self._nothing = text, piece, most, nothing

    def __missing__(self, word):
        if word.isascii() and word.isalpha():
            value = self._piece(word.encode())
        elif word[-1:] in _CLOSING and word[:-1].isalpha() and not _UNUSUAL.search(word) and len(word) > 1:
            value = self[word[:-1]] + self[word[-1]]
        else:
            value = self._nothing
            for raw in self._text.pieces(word):
                value += self._piece(raw)
        if len(self) >= self._most:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


class TokenCounter:
    """Counts tokens by heap-and-linked-list merging, without making identifiers.

    The symbols of a piece form a doubly linked list; a heap holds (rank, position) of adjacent pairs. The
    lowest pair is popped, checked to be still there, and merged; the count is the first number of symbols
    less the merges. O(n log n) for a piece of n bytes.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        self.text = WordText(path)
        model = self.text.spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self._inner = [vocab[c] for c in self.text.letters]
        self._last = [vocab[c + end] for c in self.text.letters]
        self._merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.kept = Kept(self.text, self.count_piece, most, 0)

    def count_piece(self, raw: bytes) -> int:
        n = len(raw)
        symbol = [self._inner[b] for b in raw]
        symbol[-1] = self._last[raw[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, count = self._merges, n
        heap = [(m[0], i, m[1], symbol[i], symbol[i + 1]) for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if m := merges.get((new, symbol[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, symbol[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbol[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], symbol[h], new))
        return count

    def count(self, text: str) -> int:
        return sum(1 if kind == "special" else sum(map(self.kept.__getitem__, part)) for kind, part in self.text.segments(text))


class TokenBytes:
    """Identifiers of a text as little-endian 32-bit bytes, by the library's model, kept word by word."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.text = WordText(path)
        self._tokenize = self.text.library().model.tokenize
        self.kept = Kept(self.text, self._ids, most, b"")

    def _ids(self, raw: bytes) -> bytes:
        piece = raw.decode() if raw.isalnum() else "".join(map(self.text.letters.__getitem__, raw))
        ids = [t.id for t in self._tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        out = []
        for kind, part in self.text.segments(text):
            if kind == "special":
                out.append(part.to_bytes(4, "little"))
            else:
                out.extend(map(self.kept.__getitem__, part))
        return b"".join(out)
