"""Byte-level BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

The corpus's frequent words are compiled, with their ids as outputs, into an automaton whose equal suffixes are shared. An
edge carries a number; the sum along a word's path is the word's index in a table of ids. The automaton is one file of flat
arrays that every worker maps into memory. Words it does not hold are merged exactly, pair by pair, in the order of the
file's merges.

Defined cases: a null text is empty and has no ids; texts of any length are encoded whole; rows that repeat are encoded each time;
an empty table, or one without frequent words, gives an empty lexicon and every word is merged; which of equally frequent words enter the
lexicon decides speed only.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import mmap
import os
import re
import shutil
import tempfile
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm import words
from samplewright.llm.common import texts

#: The characters with the Unicode property White_Space.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pre-tokenizer's pattern for byte-level files.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
_EDGE = re.compile(f"^(?:$|[{BLANK}])|[{BLANK}]$")
LONG = 64
#: Groups of partitions whose word sketches are merged before all are.
SKETCHES = 256


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level files: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lexicon:
    """A minimal acyclic transducer from byte strings to id lists, in one buffer; see `compile` for the layout."""

    MAGIC = b"SWL1"

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:4]) != self.MAGIC:
            raise ValueError("not a lexicon")
        states, edges, entries, ids = view[4:20].cast("I")
        parts, at = [], 20
        for n in (states + 1, edges, edges, entries + 1, ids):
            parts.append(view[at:at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.target, self.skip, self.bound, self.ids = parts
        self.final = view[at:at + states]
        self.label = bytes(view[at + states:at + states + edges])
        self.states, self.entries = states, entries

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> bytes:
        """States are made from sorted words; a state that equals an earlier one (final mark and edges) is that one.

        Layout: magic, four counts (u32), then u32 arrays: first edge of each state, edge targets, edge numbers, bounds of the
        id lists, ids; then a final mark per state and a label byte per edge. The last state is the start.
        """
        order = sorted(entries)
        made: dict[tuple, int] = {}
        rows: list[tuple] = []
        size: list[int] = []  # words below a state

        def seal(state: list) -> int:
            key = (state[0], tuple(state[1]))
            if key not in made:
                made[key] = len(rows)
                rows.append(key)
                size.append(state[0] + sum(size[t] for _, t in state[1]))
            return made[key]

        path: list[list] = [[0, []]]  # open states along the last word: final mark, sealed edges
        last = b""
        for word in order:
            same = len(os.path.commonprefix([word, last]))
            while len(path) > same + 1:
                state = path.pop()
                path[-1][1].append((last[len(path) - 1], seal(state)))
            path += [[0, []] for _ in range(len(word) - same)]
            path[-1][0] = 1
            last = word
        while len(path) > 1:
            state = path.pop()
            path[-1][1].append((last[len(path) - 1], seal(state)))
        rows.append((path[0][0], tuple(path[0][1])))  # the start is never shared
        first, target, skip, label = [0], [], [], []
        for final, edges in rows:
            at = final
            for letter, to in edges:
                label.append(letter)
                target.append(to)
                skip.append(at)
                at += size[to]
            first.append(len(target))
        lists = [entries[w] for w in order]
        bound = np.cumsum([0, *map(len, lists)])
        head = array("I", [len(rows), len(target), len(order), int(bound[-1])]).tobytes()
        body = b"".join(np.array(a, "<u4").tobytes() for a in (first, target, skip, bound, [i for x in lists for i in x]))
        return cls.MAGIC + head + body + bytes(final for final, _ in rows) + bytes(label)

    def get(self, word: bytes) -> list[int] | None:
        state, index = self.states - 1, 0
        first, target, skip, label = self.first, self.target, self.skip, self.label
        for letter in word:
            edge = label.find(letter, first[state], first[state + 1])
            if edge < 0:
                return None
            index += skip[edge]
            state = target[edge]
        return self.ids[self.bound[index]:self.bound[index + 1]].tolist() if self.final[state] else None


class ByteBpe:
    """Encoding and decoding by a byte-level `tokenizers` file, with its added tokens recognised in texts."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["type"] != "BPE":
            raise ValueError("only plain byte-level files are read")
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        vocab = {token: i for i, token in self.bytes_of.items() if i not in self.added.values()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.lexicon = lexicon
        self.pattern = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.tokens = words.Memory(lambda some: [array("I", self._token(t.encode())).tobytes() for t in some], 100_000)
        self.chunks = words.Memory(self._chunks, 100_000)

    def merge(self, word: bytes) -> list[int]:
        """Exact ids of one pre-token."""
        ids = [self.single[b] for b in word]
        return self._merge_long(ids) if len(ids) > LONG else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, (1 << 60, 0)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap and a linked list, for words without end."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def _token(self, token: bytes) -> list[int]:
        found = self.lexicon.get(token) if self.lexicon else None
        return self.merge(token) if found is None else found

    def _plain(self, text: str) -> bytes:
        return b"".join(self.tokens.get(self.pattern.findall(text)))

    def text(self, text: str) -> bytes:
        """Ids of any text, as u32 bytes."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at:m.start()]), array("I", [self.added[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _chunks(self, some: list[str]) -> list[bytes]:
        """Ids of words, their pre-tokens looked up together."""
        chunks = [self._chunk(w) for w in some]
        plain = [not self.special or not self.special.search(c) for c in chunks]
        parts = [self.pattern.findall(c) if p else () for c, p in zip(chunks, plain, strict=True)]
        got, out, at = self.tokens.get([t for part in parts for t in part]), [], 0
        for chunk, p, part in zip(chunks, plain, parts, strict=True):
            out.append(b"".join(got[at:at + len(part)]) if p else self.text(chunk))
            at += len(part)
        return out

    @staticmethod
    def _chunk(word: str) -> str:
        """A word of `words.split` that another word precedes: its space belongs to it, unless a line break took its place."""
        return word if word[:1] == "\n" else " " + word

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every text. A single space between two other characters always begins a pre-token, and so does a single line
        break, so texts without other white space at words' ends are encoded word by word; the rest as a whole."""
        different, index, starts = words.split(column)
        odd = np.fromiter((_EDGE.search(w[1:] if w[:1] == "\n" else w) is not None for w in different), bool, len(different))
        ids, bounds = words.gather(self.chunks.get(different), index, starts)
        odds = np.concatenate(([0], np.cumsum(odd[index])))
        out = []
        for i in range(len(column)):
            a, b = int(starts[i]), int(starts[i + 1])
            if odds[b] > odds[a]:
                out.append(np.frombuffer(self.text(column[i].as_py()), "<u4"))
                continue
            mine, head = ids[bounds[i]:bounds[i + 1]], different[index[a]]
            if head[:1] != "\n":  # nothing precedes the first word
                skip = len(self.chunks.get([head])[0]) // 4
                mine = np.concatenate((np.frombuffer(self.text(head), "<u4"), mine[skip:]))
            out.append(mine)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, most: int = 20_000) -> list[str]:
    """The words that take up most of the corpus, by a sketch over all whole texts; at most `most` words reach the driver.

    The sketch is approximate, which the lexicon may be: a word that it lacks is merged instead, to the same ids.
    """
    every = docs.select(F.explode(F.split("text", "[ \n]")).alias("word")).where("word <> '' and char_length(word) <= 64")
    # Two steps, so that no task merges the sketches of all others. Grouped by a constant, no sketches give no row.
    part = F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("part")
    sketches = every.groupBy(part).agg(F.expr(f"approx_top_k_accumulate(word, {4 * most})").alias("sketch"))
    one = sketches.groupBy(F.lit("all").alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {4 * most})").alias("sketch"))
    top = (one.select(F.expr(f"approx_top_k_estimate(sketch, {most})").alias("top")).first() or {"top": None})["top"]
    return [item["item"] for item in (top or []) if item["count"] > 1]


def build_lexicon(tokenizer: str, frequent: list[str]) -> bytes:
    """The transducer of the pre-tokens of the words, alone and after a space."""
    bpe = ByteBpe(tokenizer)
    tokens = {t for w in frequent for form in (w, " " + w) for t in bpe.pattern.findall(form)}
    return Lexicon.compile({t.encode(): bpe.merge(t.encode()) for t in tokens})


def share(spark, data: bytes) -> str:
    """Hand a file to every executor, also to those that start later; returns its name."""
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}")
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


_READY: dict[tuple[str, str], ByteBpe] = {}


def _ready(tokenizer: str, name: str) -> ByteBpe:
    if (tokenizer, name) not in _READY:
        with open(SparkFiles.get(name), "rb") as f:
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        _READY.clear()
        _READY[tokenizer, name] = ByteBpe(tokenizer, Lexicon(mapped))
    return _READY[tokenizer, name]


def _round_trip(tokenizer: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(tokenizer, name)
        for batch in words.portions(batches, "text"):
            n, coded, decoded = [], [], []
            for ids in bpe.encode(batch.column("text")):
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _coded(tokenizer: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(tokenizer, name)
        for batch in words.portions(batches, "text"):
            ids = pa.array([x.tolist() for x in bpe.encode(batch.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])
    return run


def _lexicon_file(docs: DataFrame, tokenizer: str) -> str:
    return share(docs.sparkSession, build_lexicon(tokenizer, frequent_words(docs)))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text; a null text is empty and has an empty array."""
    docs = texts(docs)
    return docs.mapInArrow(_coded(tokenizer, _lexicon_file(docs, tokenizer)), "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    docs = texts(docs)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(_round_trip(tokenizer, _lexicon_file(docs, tokenizer)), schema)
