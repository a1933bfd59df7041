"""Token counts of whole texts by byte-pair merging, without making ids.

A symbol list is a linked list, the adjacent pairs that form a piece wait in a heap, and the pair of lowest rank (of equal ranks
the leftmost) is merged until none is left: the count is the initial symbols less the merges. Characters without a piece count
their bytes. A space stands for a word's start and every text begins with one, as the model file asks.

Pairs of neighbouring characters that stand in no piece can never be merged, and no piece holds a space after another
character, so a text falls apart into stretches that are counted once and remembered.

Defined cases: a null text is empty and counts nothing; a very long text is counted whole, and a stretch of any length by one heap;
rows that repeat are counted each time; an empty table gives no rows; pairs of equal rank merge from the left.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from samplewright.llm import words
from samplewright.llm.common import texts

SPACE = "▁"


class PieceCounter:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        form, train = model.normalizer_spec, model.trainer_spec
        if (form.name, form.add_dummy_prefix, form.remove_extra_whitespaces, form.escape_whitespaces) != ("identity", True, False, True):
            raise ValueError("only models that leave the text as it is are counted")
        if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models with byte fallback are counted")
        library = SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(library.vocab_size()):
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i)):
                self.rank[library.id_to_piece(i)] = -library.get_score(i)
        self.pairs = {piece[i:i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces reach over spaces")
        self.stretches = words.Memory(lambda some: [self.merge(s) for s in some])
        self.known = words.Memory(lambda some: [self.word(w) for w in some])

    def merge(self, text: str) -> int:
        """Symbols left of `text` when no pair can be merged any more."""
        rank = self.rank
        symbols: list[str | None] = list(text)
        n = len(symbols)
        count = sum(1 if s in rank else len(s.encode()) for s in symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(text[i:i + 2])
            if r is not None:
                heap.append((r, i, text[i:i + 2]))
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = piece, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(piece + symbols[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, piece + symbols[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] + piece)
                if r is not None:
                    heapq.heappush(heap, (r, h, symbols[h] + piece))
        return count

    def stretch(self, text: str) -> int:
        """Like `merge`, cut where two neighbours stand in no piece."""
        pairs, parts, at = self.pairs, [], 0
        for i in range(1, len(text)):
            if text[i - 1:i + 1] not in pairs:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        return sum(self.stretches.get(parts))

    def word(self, word: str) -> int:
        """A word of `words.split`: a line break at its front takes the place of the space."""
        return self.stretch(word if word[:1] == "\n" else SPACE + word)

    def whole(self, text: str) -> int:
        """Any text, without use of the batch's words."""
        if not text:
            return 0
        return sum(self.stretch(part) for part in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE)))

    def counts(self, column: pa.Array) -> np.ndarray:
        different, index, starts = words.split(column)
        each = np.array(self.known.get(different), np.int64)
        odd = np.fromiter((not w or SPACE in w for w in different), bool, len(different))
        sums = np.concatenate(([0], np.cumsum(each[index])))
        odds = np.concatenate(([0], np.cumsum(odd[index])))
        out = sums[starts[1:]] - sums[starts[:-1]]
        for i in np.flatnonzero(odds[starts[1:]] > odds[starts[:-1]]).tolist():
            out[i] = self.whole(column[i].as_py())  # several spaces in a row, or none at all
        return out


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One per file and worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _counted(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = counter(path)
        for batch in words.portions(batches, "text"):
            text = batch.column("text")
            n = mine.counts(text)
            size = pc.binary_length(text.cast(pa.large_string())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit. A null text is empty and has no tokens.

    Rows are worked on where they lie; nothing is shuffled. A worker remembers a bounded number of words.
    """
    return texts(docs).mapInArrow(_counted(model, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
