"""Operator 7: secrets, by fixed patterns and by a character convolutional network in numpy.

Base: assign, access and hex patterns, leftmost and non-overlapping for each kind.
Method: candidates are the base findings, every run of LONG token characters or more, and every run of SHORT or more with
a letter and a digit in it; shorter or plainer ones are words. The network reads each candidate whole, in windows, with the text
around it; it is trained on labelled findings (`labelled_findings`), its output is calibrated (Platt
scaling) on a held-out part. A candidate counts by its highest window, in calibration as in use. Each kind has a threshold of its own:
the highest at which the lower bound (Wilson, SURE standard deviations) of the recall of held-out secrets of that kind is RECALL.
A candidate at or above its threshold that touches no base span is added as kind `other`; base spans stay.

The labelled findings are made from templates; a few labelled by hand are in the tests.

Nulls: a null text is empty; a null doc_id is kept. Repeated rows are returned as often as they come.
An empty table gives an empty result. Extra columns are ignored (redaction keeps them).
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "other")
RECALL, SURE, LEFT, BODY, RIGHT = 0.98, 2.58, 24, 40, 12
LONG, SHORT = 16, 8
Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OTHER = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORT},}}+")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def other_candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _OTHER.finditer(text) if m.end() - m.start() >= LONG or (_DIGIT.search(m[0]) and _LETTER.search(m[0]))]


# --- labelled findings --------------------------------------------------------------------------

_B62 = string.ascii_letters + string.digits
_TALK = "the of and was in on with from this that see also file page report section using value list data name".split()


_CUES = ["key ", "Bearer ", "auth=", "secret: ", "credential ", "password is ", "passphrase ", "login with ", "pw: ", "the token "]


def kind_of(text: str) -> str:
    """A finding's kind, by the base pattern that takes all of it, or other."""
    own = [k for k, a, b in base_spans(text) if (a, b) == (0, len(text))]
    return own[0] if own else "other"


def labelled_findings(rows: int = 9000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, secret 0/1) from templates: keys, hashes used as keys and passphrases against paths, names, dates, serials and words.

    What could be either (words with hyphens, letters alone) is a secret where the words before it say so.
    """
    r, out = random.Random(seed), []
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda a=3, b=9: some(string.ascii_lowercase, a, b)
    spoken = lambda a, b: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "t", "ch", "ng", "st"]) for _ in range(r.randint(a, b)))
    secret = [
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16), lambda: some("0123456789abcdef", 24, 64), lambda: r.choice(["sk_live_", "sk-", "ghp_", "xoxb-", "glpat-", "AIza"]) + some(_B62, 20, 40), lambda: some(_B62 + "+/", 32, 60) + r.choice(["", "=", "=="]),
        lambda: "eyJ" + some(_B62 + "-_", 20, 60), lambda: r.choice(["xoxb-", "sk-", "pk-", "key-"]) + some(string.digits, 8, 14), lambda: word(3, 6) + some(string.digits, 2, 5) + word(2, 4), lambda: some(string.ascii_letters, 20, 40),
        lambda: "-".join(word(4, 8) for _ in range(r.randint(3, 4))), lambda: some(_B62 + "-_", 10, 15) + str(r.randint(0, 9)) + "Q", lambda: r.choice(["password", "token", "secret", "api_key"]) + r.choice([" = ", ": ", "="]) + r.choice(['"', "", "'"]) + some(_B62, 8, 40), lambda: some(_B62, 24, 48),
    ]
    plain = [
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(1, 99)), lambda: "/" + "/".join(r.choice([spoken(1, 3), word(3, 6) + str(r.randint(1, 9)), f"{spoken(1, 3)}-{spoken(1, 4)}"]) for _ in range(r.randint(3, 6))),
        lambda: "/" + "/".join(r.choice([word(2, 6), spoken(1, 3), spoken(1, 3) + str(r.randint(1, 9))]) for _ in range(r.randint(2, 5))) + f"/{spoken(1, 2)}-{spoken(2, 4)}", lambda: f"/{word(3, 4)}/{spoken(2, 3)}/{word(3, 4)}/{spoken(2, 3)}{r.randint(1, 9)}/{spoken(1, 2)}-{spoken(2, 4)}", lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 99)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}-{word(5, 8)}", lambda: "-".join(word() for _ in range(r.randint(3, 5))) + f"-v{r.randint(1, 9)}",
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + str(r.randint(1, 999)), lambda: r.choice(["-", "=", "_"]) * r.randint(10, 30) + word() + str(r.randint(1, 9)), lambda: r.choice("abx01") * r.randint(10, 20) + r.choice("abx01") * r.randint(6, 20), lambda: f"{word()}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}",
        lambda: f"ISBN-978-{r.randint(0, 9)}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}", lambda: f"image_{r.randint(19900101, 20301231)}_{r.randint(1, 9999)}_{word(2, 4)}", lambda: f"chapter{r.randint(1, 40)}/section{r.randint(1, 40)}/{word()}", lambda: f"{word(8, 14)}{r.randint(1, 99)}{word(4, 8)}", lambda: f"password = {word(4, 5)}", lambda: f"{word(6, 12)}{word(6, 12)}{r.randint(1, 9)}",
        lambda: spoken(6, 10), lambda: spoken(6, 9).capitalize(), lambda: spoken(6, 9).upper(), lambda: spoken(6, 9), lambda: spoken(6, 9), lambda: some(string.digits, 16, 19), lambda: word(16, 26), lambda: word(16, 22).capitalize(), lambda: word(8, 14).upper() + word(4, 9).upper(), lambda: "-".join(word(4, 9) for _ in range(r.randint(2, 4))), lambda: f"{word(4, 8)}{r.randint(1, 2030)}", lambda: some(string.digits, 16, 24), lambda: f"{r.randint(1, 999)}{word(2, 4)}-{word(4, 8)}", lambda: "=".join([word(4, 9), word(4, 9)]),
    ]
    for _ in range(rows):
        good = r.random() < 0.5
        left = " ".join(r.choice(_TALK) if r.random() < 0.4 else spoken(1, 4) if r.random() < 0.6 else word() for _ in range(r.randint(0, 6)))
        left += r.choice([" ", "\n", ' "', " (", ": ", " = ", ""]) if left else ""
        if r.random() < 0.2:  # another finding shortly before says nothing about this one
            left += f"{r.choice(secret + plain)()} {r.choice(_TALK)} "
        own = r.choice(secret if good else plain)()
        if good and (r.random() < 0.3 or not re.search("[A-Z].*[0-9]|[0-9].*[A-Z]|[0-9a-f]{24}|[:=]", own)):
            left += r.choice(_CUES)
        right = r.choice([" ", '" ', "\n", ") ", ", "]) + " ".join(r.choice(_TALK) for _ in range(r.randint(0, 4)))
        out.append((left + own + right, len(left), len(left) + len(own), int(good)))
    return out


# --- network ------------------------------------------------------------------------------------

_CODE = np.full(128, 1, np.int64)  # 0: no character, 1: any other
_CODE[32:127] = np.arange(2, 97)
WIDTH, CHANNELS, EMBED, CODES = 5, 24, 10, 97
LENGTH = LEFT + BODY + RIGHT


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """The candidate in windows of BODY characters, each with what stands before and after it."""
    out = []
    for a in range(start, end, BODY):
        b = min(a + BODY, end)
        piece = [text[max(0, a - LEFT) : a].rjust(LEFT, "\0"), text[a:b].ljust(BODY, "\0"), text[b : b + RIGHT].ljust(RIGHT, "\0")]
        points = np.frombuffer("".join(piece).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(points == 0, 0, _CODE[np.minimum(points, 127)] * (points < 127) + (points >= 127))
        out.append(codes)
    return out


_INSIDE = np.zeros((LENGTH, 1))
_INSIDE[LEFT : LEFT + BODY] = 1.0


class CharCnn:
    """Embedding, one convolution with ReLU, maximum and mean over places, logistic output; Platt scaling."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.3, (CODES, EMBED)), "conv": r.normal(0, 0.15, (WIDTH * (EMBED + 1), CHANNELS)), "bias": np.zeros(CHANNELS), "out": r.normal(0, 0.1, 2 * CHANNELS), "b": np.zeros(1)}
        self.p["embed"][0] = 0
        self.scale, self.shift = 1.0, 0.0
        self.thresholds = dict.fromkeys(KINDS, 0.5)

    def _forward(self, x: np.ndarray):
        e = np.concatenate([self.p["embed"][x], np.broadcast_to(_INSIDE, (*x.shape, 1))], axis=2)
        n, length, d = e.shape
        cols = np.stack([e[:, k : length - WIDTH + 1 + k] for k in range(WIDTH)], axis=2).reshape(n, length - WIDTH + 1, WIDTH * d)
        z = cols @ self.p["conv"] + self.p["bias"]
        h = np.maximum(z, 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return cols, z, top, pooled, pooled @ self.p["out"] + self.p["b"][0]

    def logits(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + batch])[-1] for i in range(0, len(x), batch)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 5) -> None:
        r, step = np.random.default_rng(seed), 0
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                own = order[i : i + batch]
                cols, z, top, pooled, logit = self._forward(x[own])
                n, places, _ = cols.shape
                d_logit = (1 / (1 + np.exp(-logit)) - y[own]) / n
                d_pool = d_logit[:, None] * self.p["out"]
                d_h = np.broadcast_to(d_pool[:, None, CHANNELS:] / places, z.shape).copy()
                rows, channels = np.arange(n)[:, None], np.arange(CHANNELS)[None]
                d_h[rows, top, channels] += d_pool[:, :CHANNELS]
                d_z = d_h * (z > 0)
                d_cols = (d_z @ self.p["conv"].T).reshape(n, places, WIDTH, EMBED + 1)
                d_e = np.zeros((n, LENGTH, EMBED))
                for k in range(WIDTH):
                    d_e[:, k : k + places] += d_cols[:, :, k, :EMBED]
                d_embed = np.zeros_like(self.p["embed"])
                np.add.at(d_embed, x[own], d_e)
                d_embed[0] = 0
                grads = {"embed": d_embed, "conv": cols.reshape(-1, cols.shape[2]).T @ d_z.reshape(-1, CHANNELS), "bias": d_z.sum(axis=(0, 1)), "out": pooled.T @ d_logit, "b": np.array([d_logit.sum()])}
                step += 1
                for k, g in grads.items():
                    a, b = state[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, kinds: list[str], recall: float = RECALL) -> None:
        """Platt scaling by Newton steps on held-out findings (windows one after the other, `sizes` of each); then each kind's threshold."""
        s = highest(self.logits(x), sizes)
        design, w = np.stack([s, np.ones_like(s)], axis=1), np.array([1.0, 0.0])
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
            w = w - np.linalg.solve(hess, design.T @ (p - target))
        self.scale, self.shift = map(float, w)
        found, kinds_of = highest(self.probability(x), sizes), np.array(kinds)
        for kind in KINDS:
            own = np.sort(found[(y == 1) & (kinds_of == kind)])
            if len(own):
                self.thresholds[kind] = float(own[most_missed(len(own), recall)])


def most_missed(n: int, recall: float, sure: float = SURE) -> int:
    """Of n secrets, how many may be missed so that the Wilson lower bound of the recall is still `recall`; 0 if not even none will do."""
    for missed in range(n, 0, -1):
        p = 1 - missed / n
        low = (p + sure**2 / (2 * n) - sure * np.sqrt(p * (1 - p) / n + sure**2 / (4 * n * n))) / (1 + sure**2 / n)
        if low >= recall:
            return missed
    return 0


def highest(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The highest score of each candidate's windows, which stand one after the other."""
    return np.maximum.reduceat(scores, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def _examples(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Windows of all findings, how many each has, its label and its kind."""
    cut = [windows(text, a, b) for text, a, b, _ in table]
    return np.array([w for own in cut for w in own]), np.array([len(own) for own in cut]), np.array([label for *_, label in table], float), [kind_of(text[a:b]) for text, a, b, _ in table]


@lru_cache(1)
def default_model() -> CharCnn:
    table = labelled_findings()
    part = len(table) * 6 // 10
    model = CharCnn()
    x, sizes, y, _ = _examples(table[:part])
    model.fit(x, np.repeat(y, sizes))
    model.calibrate(*_examples(table[part:]))
    return model


def find_all(texts: list[str], model: CharCnn) -> list[tuple[list[Span], list[Span], int]]:
    """For each text: base spans, all spans, and how many base spans the network confirms."""
    cases, inputs, bases = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        bases.append(base)
        taken, i, reach = sorted((a, b) for _, a, b in base), 0, 0
        own = [(s, True) for s in base]
        for a, b in other_candidates(text):
            while i < len(taken) and taken[i][0] < b:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= a:
                own.append((("other", a, b), False))
        for span, is_base in own:
            parts = windows(text, span[1], span[2])
            cases.append((k, span, is_base, len(parts)))
            inputs += parts
    scores = np.concatenate([model.probability(np.array(inputs[i : i + 4096])) for i in range(0, len(inputs), 4096)]) if inputs else np.zeros(0)
    found: list[list[Span]] = [list(b) for b in bases]
    confirmed, at = [0] * len(texts), 0
    for k, span, is_base, n in cases:
        hit = scores[at : at + n].max() >= model.thresholds[span[0]]
        at += n
        if is_base:
            confirmed[k] += int(hit)
        elif hit:
            found[k].append(span)
    order = lambda s: (s[1], KINDS.index(s[0]))
    return [(b, sorted(f, key=order), c) for b, f, c in zip(bases, found, confirmed)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, model: CharCnn | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_all(batch.column(1).to_pylist(), model)
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _, _ in found], pa.int64()) for kind in KINDS[:3]]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(f) for _, f, _ in found], pa.string()), pa.array([c for _, _, c in found], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    return common.map_arrow(own, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redact_text(text: str, spans: list[Span], mark: str = "<secret>") -> str:
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, model: CharCnn | None = None, text_col: str = "text") -> DataFrame:
    """docs with every secret in text_col replaced; a null text stays null; all columns are kept."""
    model = model or default_model()
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        given = texts.tolist()
        found = find_all([t or "" for t in given], model)
        return pd.Series([t if t is None else redact_text(t, spans) for t, (_, spans, _) in zip(given, found)], dtype=object)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.documents(spark, sf_dir))
