"""Public tokenizers with a memo of words: the ids of a whole text at a fraction of the time."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_OPEN: dict[str, Encoder] = {}
MARKS = frozenset(".,;:!?")
#: The mark below, white space for Python that a tokenizer may take for a sign, and all white space but spaces and newlines.
DOUBTFUL = "\x01\x1c\x1d\x1e\x1f\x85"
OTHER_SPACE = DOUBTFUL + "\t\v\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What keeps spaces and newlines from standing alone between words.
RUNS = ("  ", "\n\n", " \n", "\n ")
#: Marks a sign that follows a word without a space, once it stands apart.
APART = "\x01"
MARKED = r"(\pL)([.,;:!?])( |\n|$)"
IRREGULAR = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x01\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SLICE_BYTES = 6 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_BYTES``; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + SLICE_BYTES, side="right")))
        yield at, end
        at = end


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


class _Memo(dict):
    """Ids by word, as bytes. Words not met while ``limit`` new ones came are forgotten: memory is bounded, results are not touched."""

    def __init__(self, owner: Encoder, space: str, limit: int) -> None:
        super().__init__()
        self.owner, self.space, self.limit = owner, space, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if word and word[0] == "\n":
            return self.owner.line + self.owner.bare[word[1:]]
        if word and word[0] == APART:
            return self.owner.bare[word[1:]]
        if word and word[-1] in MARKS and word[:-1].isalpha():
            return self[word[:-1]] + self.owner.bare[word[-1]]
        ids = self.older.get(word)
        if ids is None:
            ids = self.owner.split(word, self.space)
        if len(word) <= 32:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Token ids, as little-endian 32-bit bytes, exactly as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Both kinds of file supported split at white space before merging: one keeps a single space with the word
    after it, the other drops white space. With the latter, and with the former in a text whose white space is single
    spaces and single newlines, words are therefore encoded apart; any other text goes through the library whole. Words of Latin-1 letters, with
    at most one mark at their end, go straight to the library's model, others through its steps one by one. The
    strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, limit: int = 300_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.normalizer, self.parts = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare, self.spaced = _Memo(self, "", limit), _Memo(self, " ", limit)
        self.line = self._whole("\n")
        self.spaces = bool(self.line) and self._whole("a b\nc") == self._whole("a") + self._whole(" b") + self.line + self._whole("c")
        self.drops = not self.line and self._whole("a b") == self._whole("a") + self._whole("b")
        self.lower = self._whole("AÉ") == self._whole("aé")
        #: The model's character for each byte of a Latin-1 letter in UTF-8, and for a space.
        self.marks = {b: m for c in map(chr, range(0x80, 0x100)) if c.isalpha() for b, m in zip(c.encode(), self._mapped(c), strict=True)}
        self.gap = {" ": self._mapped(" a")[:-1] if self.spaces else "", "": ""}

    def _mapped(self, text: str) -> str:
        return "".join(p for p, _ in self.parts.pre_tokenize_str(text))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def split(self, word: str, space: str) -> bytes:
        """Ids of a word without white space, after a space or not."""
        if word.isalpha():
            letters = word.lower() if self.lower else word
            if letters.isascii():
                return self._merge(self.gap[space] + letters)
            if max(word) < "Ā":
                return self._merge(self.gap[space] + letters.encode().decode("latin-1").translate(self.marks))
        text = space + word
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return b"".join([self._merge(p) for p, _ in self.parts.pre_tokenize_str(text)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        has = text.__contains__
        if self.drops and not any(map(has, DOUBTFUL)):
            return b"".join(map(self.bare.__getitem__, text.split()))
        if self.spaces and text[0] not in " \n" and text[-1] not in " \n" and not any(map(has, RUNS)) and not any(map(has, OTHER_SPACE)):
            first, *rest = text.replace("\n", " \n").split(" ")
            return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))
        return self._whole(text)

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a column of texts, each followed by ``end_id``; a null is an empty text.

        Texts with plain white space are split together, and each distinct word among them is looked up once.
        """
        n = len(texts)
        texts = pc.fill_null(texts, "")
        plain = np.zeros(n, bool)
        if self.spaces or self.drops:
            odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False).astype(bool)
            plain = ~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        rows = np.flatnonzero(plain)
        others = np.flatnonzero(~plain)
        ids, ends = self._encode_plain(texts.take(pa.array(rows))) if len(rows) else (np.zeros(0, "<u4"), np.zeros(1, "i8"))
        apart = [np.frombuffer(self.encode(t), "<u4") for t in texts.take(pa.array(others)).to_pylist()]
        counts = np.empty(n, "i8")
        counts[rows] = np.diff(ends)
        counts[others] = [len(a) for a in apart]
        offsets = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(offsets[-1], end_id, "<u4")
        if len(rows) == n:
            out[np.delete(np.arange(len(out), dtype="i4"), offsets[1:] - 1)] = ids
        else:
            out[np.repeat(offsets[rows] - ends[:-1], counts[rows]) + np.arange(len(ids))] = ids
        for row, a in zip(others.tolist(), apart, strict=True):
            out[offsets[row] : offsets[row] + len(a)] = a
        return offsets, out

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring_regex(texts, MARKED, r"\1 " + APART + r"\2\3")
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.spaces else " "), " ")
        starts = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = coded.indices.to_numpy().copy()
        memo = self.spaced if self.spaces else self.bare
        parts = [memo[w] for w in names]
        if self.spaces:
            first, code[starts[:-1]] = np.unique(code[starts[:-1]], return_inverse=True)
            code[starts[:-1]] += len(names)
            parts += [self.bare[names[k]] for k in first.tolist()]
        size = np.fromiter(map(len, parts), "i4", len(parts)) >> 2
        table = np.frombuffer(b"".join(parts), "<u4")
        begin = np.cumsum(size, dtype="i4") - size
        lengths = size[code]
        total = np.concatenate([np.zeros(1, "i4"), np.cumsum(lengths, dtype="i4")])
        at = np.repeat(begin[code] - total[:-1], lengths)
        at += np.arange(total[-1], dtype="i4")
        return table[at], total[starts].astype("i8")
