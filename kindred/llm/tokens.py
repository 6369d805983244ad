"""Operator 1, edit-aware token counts, and the byte-pair encoder that packing shares.

Byte-level BPE splits a text by a pattern in which a white-space character that follows a non-space character always begins
a new pre-token, whatever stands before or after. So a text may be cut at such places and its parts encoded one by one:
the ids of the parts, joined, are the ids of the whole. The encoder caches the ids of the parts, and the count trees keep
sums over them and re-encode only the leaves that an edit touches.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary that ids refer to, as the `tokenizers` library reads it, and the same one as ranks.
VOCAB, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Where a pre-token ends whatever else the text holds: before white space after a character that is none, between letters and
#: digits, and between either and a mark. Only characters that are letters in every version of Unicode count, and a bar never
#: begins a part, as it may stand within the special string.
_SAFE = re.compile(r"(?<=[^\s\x85\u180e\u200b])[ \n\t]|(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])[!-/:-@\[-`{}~，。、！？；：]|(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]")
#: A string that the vocabulary encodes as one id of its own.
SPECIAL = "<|endoftext|>"


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder(dict):
    """Maps a unit (a part of a text between two safe cuts, without its leading space) to its ids as little-endian uint32
    bytes, or to None if the unit ends in white space, where a cut is not safe. Grows as units come up; ``room`` bounds it.
    """

    def __init__(self, vocab: str, ranks: str, room: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.room = room
        self.exact = Tokenizer.from_file(vocab)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.comma, self.stop = self.whole(","), self.whole(".")

    def whole(self, text: str) -> bytes:
        """The ids of any text. Texts of Latin letters take the faster library with the same vocabulary; the two may read
        newer Unicode letters differently, so others take the library that defines the ids."""
        if SPECIAL not in text and (text.isascii() or max(text) < "ɐ"):
            return packed(self.quick.encode_ordinary(text))
        return packed(self.exact.encode(text, add_special_tokens=False).ids)

    def __missing__(self, unit: str) -> bytes | None:
        if len(self) >= self.room:
            self.clear()
        if not unit or unit[-1].isspace():
            ids = None
        elif unit[-1] in ",." and unit[-2:-1].isalnum():  # between a letter or digit and a stop or comma lies a cut
            ids = self[unit[:-1]] + (self.comma if unit[-1] == "," else self.stop)
        else:
            ids = self.whole(unit if unit[0] == "\n" else " " + unit)
        self[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian uint32 bytes."""
        if not text:
            return b""
        first, *units = text.replace("\n", " \n").split(" ")
        if not first or first[-1].isspace():
            return self.whole(text)
        found = list(map(self.__getitem__, units))
        return self.whole(text) if None in found else self.whole(first) + b"".join(found)

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


@cache
def encoder(vocab: str, ranks: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocab, ranks)


class CountTree:
    """Token count of one document under edits.

    Leaves are stretches of about ``leaf`` characters that begin at safe cuts, whether or not the text has spaces; two binary
    trees hold sums of their tokens
    and characters. ``replace`` finds the touched leaves by descent, takes one character of context on each side so that
    the outer cuts stay safe, re-encodes that stretch alone, and updates the sums above it.
    """

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = 512):
        self.count, self.leaf, self.encoded = count, leaf, 0
        self._build(list(self._cut(text)))

    def _cut(self, text: str) -> Iterator[str]:
        start, n = 0, len(text)
        while start < n:
            found = _SAFE.search(text, start + self.leaf)
            end = found.start() if found else n
            yield text[start:end]
            start = end

    def _build(self, texts: list[str]) -> None:
        self.size = 1 << max(0, len(texts) - 1).bit_length()
        self.texts = texts + [""] * (self.size - len(texts))
        self.tokens = [0] * (2 * self.size)
        self.chars = [0] * (2 * self.size)
        for i, t in enumerate(texts):
            self.tokens[self.size + i], self.chars[self.size + i] = self.count(t), len(t)
        for i in range(self.size - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def _set(self, i: int, text: str) -> None:
        self.texts[i] = text
        k = self.size + i
        self.tokens[k], self.chars[k] = self.count(text), len(text)
        self.encoded += len(text)
        while k := k // 2:
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at ``at``, and where the leaf starts."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``start`` to ``end``; both are clipped to the text."""
        n = self.n_chars
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if start == end and not new:
            return
        first, at = self._find(max(start - 1, 0)) if n else (0, 0)
        last, last_at = self._find(min(end, n - 1)) if n else (0, 0)
        held = "".join(self.texts[first : last + 1])
        held = held[: start - at] + new + held[end - at :]
        pieces = list(self._cut(held))
        room = last - first + 1
        if len(pieces) <= room:
            for i in range(room):
                old, now = self.texts[first + i], pieces[i] if i < len(pieces) else ""
                if old != now:
                    self._set(first + i, now)
        else:  # no slots left between the neighbours: the tree is laid out anew, and only changed leaves are encoded
            self._relay(first, last, pieces)

    def _relay(self, first: int, last: int, pieces: list[str]) -> None:
        kept = {t: self.tokens[self.size + i] for i, t in enumerate(self.texts) if t and not first <= i <= last}
        texts = [t for t in [*self.texts[:first], *pieces, *self.texts[last + 1 :]] if t]
        count = self.count

        def known(t: str) -> int:
            if t in kept:
                return kept[t]
            self.encoded += len(t)
            return count(t)

        self.count = known
        self._build(texts)
        self.count = count


Edit = tuple[int, int, str]


def edited(text: str, edits: Sequence[Edit]) -> str:
    """``text`` after the edits, applied one after the other."""
    for start, end, new in edits:
        start = min(max(start, 0), len(text))
        text = text[:start] + new + text[min(max(end, start), len(text)) :]
    return text


def default_edits(text: str) -> list[Edit]:
    """The edits of the registered query: drop 40 characters a third of the way in, then put a notice in the middle."""
    n = len(text)
    at = n // 3
    rest = n - min(40, n - at)
    return [(at, at + 40, ""), (rest // 2, rest // 2, " [passage revised by the editor] ")]


def count_with_edits(
    docs: DataFrame,
    edits: Callable[[str], Iterable[Edit]] = default_edits,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    vocab: str | None = None,
    ranks: str | None = None,
    leaf: int = 512,
) -> DataFrame:
    """Token counts of every whole text before and after its edits.

    Returns ``doc_id``, ``n_chars``, ``n_tokens``, ``n_tokens_edited`` and ``n_chars_encoded_again`` (characters that the
    edits made the tree encode), a row for each input row. A null text counts as empty: zero tokens, and its edits apply to
    the empty text. Ids may be of any type, null or repeated, and rows that repeat get equal counts. A very long text is one
    tree. An empty table gives no rows. Other columns are ignored, whatever their names. No shuffle.
    """
    vocab, ranks = vocab or public_tokenizers.path(VOCAB), ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab, ranks)
        for batch in batches:
            rows: list[list[int]] = []
            for t in batch.column(1):
                t = t.as_py() or ""
                tree = CountTree(t, encode.count, leaf)
                before = tree.n_tokens
                for start, end, new in edits(t):
                    tree.replace(start, end, new)
                rows.append([len(t), before, tree.n_tokens, tree.encoded])
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], names=names)

    names = ["doc_id", "n_chars", "n_tokens", "n_tokens_edited", "n_chars_encoded_again"]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, ", ".join([f"doc_id {own.schema['doc_id'].dataType.simpleString()}", *(f"{n} long" for n in names[1:])]))
