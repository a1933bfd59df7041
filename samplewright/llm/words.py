"""Whole-text encoding by words: Arrow splits and numbers the words of a batch, and only words not met before are encoded.

Text is Zipfian: a batch of millions of words has far fewer different ones, and most of those were met in the batch before.
What a word stands for (its ids, its token count) is remembered in two generations, so memory stays bounded and frequent
words stay known.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words longer than this are not remembered.
LONG_WORD = 64
#: Texts are worked on in portions of about so many bytes.
PORTION = 8 << 20


class Memory:
    """Remembers `size` to twice `size` values; what was not used for a whole generation is forgotten."""

    def __init__(self, make: Callable[[list[str]], list], size: int = 200_000):
        self.make, self.size = make, size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, words: list[str]) -> list:
        """The value of every word; unknown ones are made together."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        got = list(map(self.young.get, words))
        lost = [i for i, v in enumerate(got) if v is None]
        unknown = []
        for i in lost:
            got[i] = v = self.old.get(words[i])
            if v is None:
                unknown.append(i)
            elif len(words[i]) <= LONG_WORD:
                self.young[words[i]] = v
        if unknown:
            for i, v in zip(unknown, self.make([words[i] for i in unknown]), strict=True):
                got[i] = v
                if len(words[i]) <= LONG_WORD:
                    self.young[words[i]] = v
        return got


def portions(batches: Iterator[pa.RecordBatch], column: str, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `size` bytes of text, so that one batch of long texts is not held several times over."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def split(texts: pa.Array, breaks: str = "\n") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, the words of all texts as indices into them, and where each text's words begin (n + 1 values).

    Words are what stands between single spaces. A break character starts a word of its own and stays at its front; without
    `breaks` nothing but the space separates. An empty text has one empty word.
    """
    texts = texts.cast(pa.large_string())
    if breaks:
        texts = pc.replace_substring(texts, breaks, " " + breaks)
    parts = pc.split_pattern(texts, " ")
    numbered = parts.flatten().dictionary_encode()
    starts = parts.offsets.to_numpy()
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(zero_copy_only=False), starts - starts[0]


def gather(values: list[bytes], words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array, and where each text's ids begin (n + 1 values). A word's value is its ids as u32 bytes."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    pool = np.frombuffer(b"".join(values), "<u4")
    begin = np.cumsum(sizes) - sizes
    each = sizes[words]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(begin[words] - (ends - each), each)
    at += np.arange(total)
    bounds = np.concatenate(([0], ends))[starts]
    return pool[at], bounds


_LETTER, _DIGIT, _OTHER, _GAP, _RARE = range(5)
#: What `pieces` does by itself: lower case, white space dropped, runs of letters, single digits, runs of other signs.
_PIECES = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}


def _kinds(added: list[str]) -> np.ndarray | None:
    """Kind of every byte; signs that an added token begins with are rare. None if such a token begins like a word."""
    kind = np.full(256, _RARE, np.uint8)
    kind[33:127] = _OTHER
    kind[[ord("'"), *[t.encode()[0] for t in added]]] = _RARE
    if any(t[0].isalnum() for t in added):
        return None
    kind[48:58] = _DIGIT
    kind[65:91] = kind[97:123] = _LETTER
    kind[[9, 10, 11, 12, 13, 32]] = _GAP
    return kind


def pieces(texts: pa.Array, kinds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As `split`, but words of plain signs are cut into lower-case pieces, of which there are far fewer different ones. A word with
    a rare byte (other than ASCII, an apostrophe, the begin of an added token) is one piece, as it is."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    kind = kinds[data]
    solid = kind != _GAP
    begins = np.zeros(len(data), bool)
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    word = solid.copy()
    word[1:] &= ~solid[:-1] | begins[1:]
    cut = word | (kind == _DIGIT)
    cut[1:] |= solid[1:] & (kind[1:] != kind[:-1])
    rare = np.flatnonzero(kind == _RARE)
    low = data | (kind == _LETTER).view(np.uint8) << 5
    if len(rare):
        heads = np.flatnonzero(word)
        odd = np.unique(np.searchsorted(heads, rare, side="right") - 1)
        size = np.append(heads[1:], len(data))[odd] - heads[odd]
        at = np.repeat(heads[odd] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cut[at] = word[at]
        low[at] = data[at]
    start = np.flatnonzero(cut)
    length = np.add.reduceat(solid, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(length)))
    letters = low[solid]
    units = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    numbered = units.dictionary_encode()
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(zero_copy_only=False), np.searchsorted(start, bounds)


class LibraryEncoder:
    """Ids as a `tokenizers` file whose pre-tokenizer drops white space gives them, without added tokens.

    Nothing in such a file reaches over a space or a line break, so a text's ids are its words' ids in a row. Where the file says
    that words are cut as `pieces` does, plain pieces are given to the library's model directly; other unknown words are given to
    the library together, parted by a sign that is one token of its own.
    """

    SIGN = "\0"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        sign = self.library.encode(self.SIGN, add_special_tokens=False).ids
        around = self.library.encode(f"a {self.SIGN} a", add_special_tokens=False).ids
        if len(sign) != 1 or around.count(sign[0]) != 1 or self.library.encode("a b", add_special_tokens=False).ids != [
                *self.library.encode("a", add_special_tokens=False).ids, *self.library.encode("b", add_special_tokens=False).ids]:
            raise ValueError("this file's tokens may reach over spaces")
        self.sign = sign[0]
        self.kinds = self._plain_kinds(path)
        self.memory = Memory(self._make)

    def _plain_kinds(self, path: str) -> np.ndarray | None:
        """Kinds of bytes for `pieces`, or None if the file cuts words in another way."""
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        normal, cutting, model = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}, said["model"]
        if normal.get("normalizers") != _PIECES["normalizers"] or cutting.get("pretokenizers") != _PIECES["pretokenizers"] or model["type"] != "BPE" or (
                model.get("dropout") or said.get("post_processor")):
            return None
        kinds = _kinds([t["content"] for t in said.get("added_tokens", [])])
        if kinds is not None:
            self.plain = re.compile("[" + "".join(re.escape(chr(i)) for i in range(128) if kinds[i] in (_LETTER, _DIGIT, _OTHER)) + "]+")
        return kinds

    def _alone(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _make(self, words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        plain = []
        for i, word in enumerate(words):
            if self.kinds is not None and self.plain.fullmatch(word):
                out[i] = np.array([t.id for t in self.library.model.tokenize(word)], "<u4").tobytes()
            elif self.SIGN in word or "<|" in word or len(word) > LONG_WORD:
                out[i] = self._alone(word)
            else:
                plain.append(i)
        for k in range(0, len(plain), 500):
            some = plain[k:k + 500]
            ids = np.array(self.library.encode(f" {self.SIGN} ".join([words[i] for i in some]), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.sign), len(ids))
            if len(ends) != len(some):
                for i in some:
                    out[i] = self._alone(words[i])
                continue
            at = 0
            for i, end in zip(some, ends.tolist(), strict=True):
                out[i] = ids[at:end].tobytes()
                at = end + 1
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and where each text's ids begin (n + 1 values)."""
        words, index, starts = split(texts) if self.kinds is None else pieces(texts, self.kinds)
        return gather(self.memory.get(words), index, starts)


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One per file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]
