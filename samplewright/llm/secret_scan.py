"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its surroundings.

A candidate is what a pattern found, or a run of 16 or more key-like characters with both letters and digits; where a pattern
found a part of a run, each remainder and the whole run. The network sees
24 characters before it, the candidate and 8 after; a candidate above 48 characters is seen in pieces of 48 that begin every
24 characters, each with its own surroundings, and its score is the largest of theirs. It is trained with numpy
on a bounded sample of labelled findings: candidates that a pattern found are secrets, the others are not, and both are joined
by made-up examples of key formats and of harmless look-alikes set into the sample's surroundings. Scores are calibrated on
held-out examples, and the threshold is the highest one that still finds the wanted share of held-out made-up keys of every
format, which no pattern finds. What the network adds are spans of kind `model`; spans of the patterns always stay.

Spans count code points, end exclusive. A null or empty text has no spans. The same rows always give the same network.

Defined cases: a null or empty text has no span; texts are scanned whole, a very long candidate by as many windows as it takes; rows that
repeat are scanned each time; an empty table gives no rows, and a table without findings
learns from the made-up examples alone; spans that begin together come in the order of their kinds.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm import words
from samplewright.llm.common import texts
from samplewright.session import cut

# The patterns of the base findings, in the order in which they are listed, and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

_STEMS = ("passw", "secret", "token", "api")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
BEFORE, INSIDE, AFTER = 24, 48, 8
WINDOW = BEFORE + INSIDE + AFTER
#: Candidates of each label that training reads at most.
SAMPLE = 1500
RECALL = 0.98
#: Formats of made-up keys.
FORMATS = 9
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, start and end of the value) of all base findings, by start and kind."""
    out = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= LEAST_ASSIGN:
                out.append((m.start(), 0, m.end(), m.start(1), m.end(1)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out)


def window(text: str, start: int, end: int) -> str:
    """The fixed-length cut around a piece of at most INSIDE characters; NUL fills what is not there."""
    value = text[start:end]
    return text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + value.ljust(INSIDE, "\0") + text[end:end + AFTER].ljust(AFTER, "\0")


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """The candidate itself, or if it is long its overlapping pieces, of which the last ends where it ends."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(s, s + INSIDE) for s in [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]]


def windows(text: str, start: int, end: int) -> list[str]:
    return [window(text, s, e) for s, e in pieces(start, end)]


def _keylike(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The run without trailing signs, if it is long enough and has both letters and digits."""
    value = text[start:end].rstrip(".-")
    if len(value) >= 16 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
        return start, start + len(value)
    return None


def candidates(text: str) -> tuple[list, list[tuple[int, int, bool | None, list[str]]]]:
    """Base findings, and (start, end, found by a pattern, windows) of every candidate.

    Of a run that a base finding covers in part, each remainder is a candidate, and so is the whole run; both are neither
    found by a pattern nor an example of a harmless run, so that field is None.
    """
    base = base_spans(text)
    out = [(a, b, True, windows(text, a, b)) for _, _, _, a, b in base]
    taken = sorted((s, e) for s, _, e, _, _ in base)
    at = 0  # the first base span that may reach into this run or a later one; few spans lie inside each other
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        bases = []
        i = at
        while i < len(taken) and taken[i][0] < end:
            if taken[i][1] > start:
                bases.append((max(taken[i][0], start), min(taken[i][1], end)))
            i += 1
        if not bases:
            if found := _keylike(text, start, end):
                out.append((*found, False, windows(text, *found)))
            continue
        rest, last = [], start
        for s, e in [*bases, (end, end)]:
            if s > last:
                rest.append((last, s))
            last = max(last, e)
        if any(c.isalnum() for s, e in rest for c in text[s:e]):
            for found in dict.fromkeys(_keylike(text, s, e) for s, e in [(start, end), *rest]):
                if found:
                    out.append((*found, None, windows(text, *found)))
    return base, out


_SIGNS = "+/_=.-:\"' \n@<>()\0"
_CLASSES = {c: i for i, c in enumerate(string.ascii_letters + string.digits + _SIGNS)}
OTHER = len(_CLASSES)
CHARS = OTHER + 1


def classes(windows: list[str]) -> np.ndarray:
    """A class per character; characters of the candidate have classes of their own."""
    get = _CLASSES.get
    out = np.array([[get(c, OTHER) for c in w] for w in windows], np.int64).reshape(len(windows), WINDOW)
    out[:, BEFORE:BEFORE + INSIDE] += CHARS
    return out


@dataclass
class Network:
    """Convolution of width 5 over one-hot characters, ReLU, largest value around and inside, mean inside, logistic output."""

    kernel: np.ndarray  # 5 x 2 CHARS x filters
    shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    WIDTH = 5

    def forward(self, x: np.ndarray):
        n = x.shape[1] - self.WIDTH + 1
        y = self.shift + sum(self.kernel[k][x[:, k:k + n]] for k in range(self.WIDTH))
        y = np.maximum(y, 0)
        inside = slice(BEFORE - 2, BEFORE + INSIDE - 2)
        around = np.concatenate((y[:, :BEFORE - 2], y[:, BEFORE + INSIDE - 2:]), 1)
        pooled = np.concatenate((around.max(1), y[:, inside].max(1), y[:, inside].mean(1)), 1)
        return y, pooled, pooled @ self.out + self.bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i:i + 256])[2] for i in range(0, len(x), 256)]) if len(x) else np.empty(0)

    def scores(self, windows: list[str]) -> np.ndarray:
        """Calibrated probabilities."""
        parts = [self.logits(classes(windows[i:i + 4096])) for i in range(0, len(windows), 4096)]
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate([np.empty(0), *parts]) + self.offset, -35, 35)))

    def passed(self, candidates: list[list[str]]) -> list[bool]:
        """Whether the largest score of each candidate's windows reaches the threshold."""
        if not candidates:
            return []
        first = np.cumsum([0, *(len(c) for c in candidates)])[:-1]
        return (np.maximum.reduceat(self.scores([w for c in candidates for w in c]), first) >= self.threshold).tolist()


def learn(x: np.ndarray, y: np.ndarray, filters: int = 16, epochs: int = 6, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the logistic loss, both labels with equal weight in total."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (Network.WIDTH, 2 * CHARS, filters)), np.zeros(filters), rng.normal(0, 0.1, 3 * filters), 0.0)
    weight = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum()))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.kernel, net.shift, net.out, np.zeros(1))]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            a, pooled, logit = net.forward(x[part])
            d = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - y[part]) * weight[part] / len(part)
            back = d[:, None] * net.out
            grad = np.zeros_like(a)
            rows, cols = np.arange(len(part))[:, None], np.arange(filters)[None]
            f, low, high = filters, BEFORE - 2, BEFORE + INSIDE - 2
            outer = np.concatenate((np.arange(low), np.arange(high, a.shape[1])))
            np.add.at(grad, (rows, outer[a[:, outer].argmax(1)], cols), back[:, :f])
            np.add.at(grad, (rows, low + a[:, low:high].argmax(1), cols), back[:, f:2 * f])
            grad[:, low:high] += back[:, None, 2 * f:] / (high - low)
            grad *= a > 0
            flat, n = grad.reshape(-1, filters), a.shape[1]
            kernel = np.zeros_like(net.kernel)
            for k in range(Network.WIDTH):
                kind = x[part, k:k + n].ravel()
                order = np.argsort(kind, kind="stable")
                first = np.flatnonzero(np.diff(kind[order], prepend=-1))
                kernel[k][kind[order][first]] = np.add.reduceat(flat[order], first)
            step += 1
            for p, g, m in zip((net.kernel, net.shift, net.out, None), (kernel, flat.sum(0), pooled.T @ d, np.array([d.sum()])), moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                change = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                if p is None:
                    net.bias -= float(change[0])
                else:
                    p -= change
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray, keys: list[list[list[str]]], recall: float = RECALL) -> Network:
    """Fit slope and offset on held-out examples by Newton steps, then take the highest threshold with the wanted recall of
    every kind of `keys`: held-out secrets that no pattern covers, each as its windows."""
    if len(set(y.tolist())) == 2:
        _fit_slope(net, x, y)
    net.threshold = min(_quantile(np.array([net.scores(w).max() for w in kind]), recall) for kind in keys)
    return net


def _quantile(scores: np.ndarray, recall: float) -> float:
    """The score that may be a threshold: a share `recall` of all such keys reaches it, with a margin of 1.65 standard errors."""
    misses = len(scores) * (1 - recall)
    return float(np.sort(scores)[max(0, int(misses - 1.65 * (misses * recall) ** 0.5))])


def _fit_slope(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    z = net.logits(x)
    t = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    a = np.array([1.0, 0.0])
    design = np.stack((z, np.ones_like(z)), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -35, 35)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        a -= np.linalg.solve(hess, design.T @ (p - t) + 1e-3 * (a - [1.0, 0.0]))
    net.slope, net.offset = max(float(a[0]), 1e-3), float(a[1])


def made_up(around: list[str], n: int = 400, seed: int = 9) -> list[tuple[str, int]]:
    """Windows of made-up keys (1) and look-alikes (0), set into surroundings taken from other windows."""
    return [(w, label) for text, start, end, label, _ in _invented(around, n, seed) for w in windows(text, start, end)]


def _inside_runs(invented: list[tuple[str, int, int, int, int]], seed: int) -> list[tuple[str, int, int, int, int, int, int]]:
    """The made-up values set into the middle of long harmless runs; the ends of the run come last."""
    rng = random.Random(seed)
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    parts = [lambda: some(string.ascii_lowercase, rng.randint(2, 10)), lambda: some(string.ascii_lowercase, rng.randint(2, 10)),
             lambda: some(string.ascii_lowercase, rng.randint(3, 7)).title(), lambda: str(rng.randint(1, 2030)),
             lambda: some(string.ascii_lowercase, rng.randint(2, 6)) + str(rng.randint(0, 99))]

    def run(sign: str) -> str:
        out = ""
        while len(out) < length:
            out += rng.choice(parts)() + (sign if rng.random() < 0.8 else rng.choice("/.=_-"))
        return out

    out = []
    for text, start, end, label, form in invented:
        length, sign = rng.randint(25, 120), rng.choice("//.=")
        before, after = run(sign), sign + run(sign)
        at = start + len(before)
        out.append((text[:start] + before + text[start:end] + after + text[end:], at, at + end - start, label, form, start, at + end - start + len(after)))
    return out


def made_up_inside(around: list[str], n: int = 400, seed: int = 11) -> list[tuple[str, int]]:
    """Windows of long runs with a made-up key (1, if they hold half a window of it or all of it; 0, if nothing) or a look-alike (0) inside."""
    out = []
    for text, start, end, label, _, first, last in _inside_runs(_invented(around, n, seed), seed):
        for s, e in pieces(first, last):
            shared = min(e, end) - max(s, start)
            if not label or shared <= 0 or shared >= min(INSIDE // 2, end - start):
                out.append((window(text, s, e), int(label and shared > 0)))
    return out


def held_out(around: list[str], n: int = 400, seed: int = 10, inside: bool = False) -> list[list[list[str]]]:
    """The windows of `n` made-up keys of every format, per format and key, without keys that a pattern finds or that are no candidates.
    With `inside` the keys are in the middle of long runs."""
    out: list[list[list[str]]] = [[] for _ in range(FORMATS)]
    invented = _invented(around, n * FORMATS, seed)
    for text, start, end, label, form, *_ in _inside_runs(invented, seed) if inside else invented:
        if label and not any(s < end and start < e for s, _, e, _, _ in base_spans(text)):
            near = [w for s, e, _, c in candidates(text)[1] if s < end and start < e for w in c]
            if near:
                out[form].append(near)
    return out


def _invented(around: list[str], n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, label, format) of `n` made-up keys and `n` look-alikes."""
    rng = random.Random(seed)
    alnum, url, digits = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", string.digits
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: some(string.ascii_lowercase, rng.randint(3, 9))
    # Public formats of keys.
    keys = [
        lambda: "ghp_" + some(alnum, 36), lambda: "sk_live_" + some(alnum, 24), lambda: "AIza" + some(url, 35), lambda: "glpat-" + some(url, 20),
        lambda: f"xoxb-{some(digits, 11)}-{some(digits, 11)}-{some(alnum, 24)}", lambda: f"eyJ{some(url, 24)}.eyJ{some(url, 40)}.{some(url, 43)}",
        lambda: some(alnum + "+/", rng.randint(32, 64)), lambda: some(alnum, rng.randint(20, 44)), lambda: some("0123456789ABCDEF", rng.choice([32, 40, 64])),
    ]
    alike = [
        lambda: f"{word()}{rng.randint(1, 99)}.{word()}.{word()}", lambda: f"{word()}-{word()}-{rng.randint(1, 2030)}-{word()}", lambda: f"/{word()}/{word()}/{rng.randint(1, 999)}/{word()}.html",
        lambda: f"{word()}_{word()}_{word()}_v{rng.randint(1, 30)}", lambda: f"20{some(digits, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}:00"[:16] + word(),
        lambda: f"{word()}{word()}{word()}{rng.randint(0, 9)}", lambda: f"{word()}={word()}{rng.randint(0, 99)}.{word()}", lambda: f"www.{word()}{word()}.example.{word()}{rng.randint(1, 9)}",
    ]
    leads = ["", "", "Bearer ", "key: ", "credential=", "auth: ", "pwd: "]
    out = []
    for label, forms in ((1, keys), (0, alike)):
        for i in range(n):
            w = around[rng.randrange(len(around))] if around else "".rjust(BEFORE) + "\0" * INSIDE + " ".ljust(AFTER)
            value = forms[i % len(forms)]()
            lead = rng.choice(leads) if label else ""
            text = (w[:BEFORE].replace("\0", " ") + lead)[-BEFORE:] if lead else w[:BEFORE].replace("\0", " ")[:-1] + " "
            out.append((text + value + w[BEFORE + INSIDE:].replace("\0", " "), BEFORE, BEFORE + len(value), label, i % len(forms)))
    return out


_FOUND = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base array<string>, "
          "near array<struct<start: int, end: int, base: boolean, windows: array<string>>>")
_NEAR = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("windows", pa.list_(pa.string()))]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.portions(batches, "text"):
        text = batch.column("text")
        # A text with none of these has no candidate.
        maybe = pc.match_substring_regex(text, "[0-9]|[0-9a-f]{16}|AKIA|(?i:passw|secret|token|api)").to_pylist()
        counts, base, near = [[], [], []], [], []
        for i, likely in enumerate(maybe):
            spans, around = candidates(text[i].as_py()) if likely else ([], [])
            for k in range(3):
                counts[k].append(sum(1 for s in spans if s[1] == k))
            base.append([f"{KINDS[k]}:{s}:{e}" for s, k, e, _, _ in spans])
            near.append([dict(zip(("start", "end", "base", "windows"), c, strict=True)) for c in around])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.list_(pa.string())), pa.array(near, _NEAR)],
            ["doc_id", "n_assign", "n_access", "n_hex", "base", "near"])


def fit(found: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on at most `sample` different windows of each label, the first in the order of a hash; a fifth is held out."""
    seen = found.select(F.explode("near").alias("c")).select(F.explode("c.windows").alias("window"), "c.base").groupBy("window").agg(F.max("base").alias("base"))
    # A key that no pattern covers is no example of a harmless run; such runs stay out where a long run mixes all three kinds.
    value = F.regexp_replace(F.substring("window", BEFORE + 1, INSIDE), "\\x00", "")
    part = "[A-Za-z0-9+_=]"
    keylike = value.rlike(f"(?={part}*[A-Z])(?={part}*[a-z])(?={part}*[0-9]{part}*[0-9]{part}*[0-9]){part}{{20}}")
    pick = lambda rows: [r["window"] for r in rows.orderBy(F.xxhash64("window"), "window").limit(sample).collect()]
    good, bad = pick(seen.where("base")), pick(seen.where(~F.col("base") & ~keylike))
    examples = [(w, 1) for w in good] + [(w, 0) for w in bad] + made_up(bad + good) + made_up_inside(bad + good)
    x, y = classes([w for w, _ in examples]), np.array([label for _, label in examples])
    held = np.array([hashlib.md5(w.encode()).digest()[0] % 5 == 0 for w, _ in examples])
    return calibrate(learn(x[~held], y[~held]), x[held], y[held], held_out(bad + good) + held_out(bad + good, inside=True))


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            near = batch.column("near").to_pylist()
            passed = iter(net.passed([c["windows"] for row in near for c in row]))
            sums, spans, extra, sure = [], [], [], []
            for base, row in zip(batch.column("base").to_pylist(), near, strict=True):
                ok = [next(passed) for _ in row]
                added = [f"model:{c['start']}:{c['end']}" for c, p in zip(row, ok, strict=True) if p and not c["base"]]
                every = sorted((int(s.split(":")[1]), (*KINDS, "model").index(s.split(":")[0]), s) for s in base + added)
                sums.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                spans.append(",".join(s for _, _, s in every))
                extra.append(len(added))
                sure.append(sum(1 for c, p in zip(row, ok, strict=True) if p and c["base"]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")), pa.array(sums, pa.string()), pa.array(spans, pa.string()),
                 pa.array(extra, pa.int64()), pa.array(sure, pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "n_base_sure"])
    return run


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model (spans that the network adds)
    and n_base_sure (base findings that the network also takes for secrets).

    Texts are read once; candidates, a small part of them, are written and both the training sample and the scores come from
    that copy.
    """
    found = cut(texts(docs).mapInArrow(_found, _FOUND))
    shared = docs.sparkSession.sparkContext.broadcast(fit(found, sample))
    schema = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint, n_base_sure bigint")
    return found.mapInArrow(_judged(shared), schema)


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` with every span masked and n_chars, if there is such a column, counted anew where the text changed.
    Other texts and columns stay as they are, nulls too."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(cut(texts(docs).mapInArrow(_found, _FOUND).select("near").where(F.size("near") > 0)), sample))
    columns = docs.columns
    at, count = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            for batch in words.portions([whole], whole.schema.names[at]):
                text = batch.column(at).to_pylist()
                size = batch.column(count).to_pylist() if count is not None else None
                for i, t in enumerate(text):
                    base, near = candidates(t) if t else ([], [])
                    if near:
                        ok = net.passed([c[3] for c in near])
                        spans = [(s, e) for s, _, e, _, _ in base] + [(c[0], c[1]) for c, p in zip(near, ok, strict=True) if p and not c[2]]
                        if spans:
                            text[i] = masked(t, spans)
                            if size is not None:
                                size[i] = len(text[i])
                arrays = list(batch.columns)
                arrays[at] = pa.array(text, arrays[at].type)
                if size is not None:
                    arrays[count] = pa.array(size, arrays[count].type)
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
