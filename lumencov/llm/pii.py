"""Operator 1: personal data, by fixed patterns and by a linear-chain conditional random field.

Base: email, ip, card and phone patterns with their checks, leftmost and non-overlapping for each kind.
Method: a CRF over the word-shape features of each word, trained by gradient descent on a small
labelled table (`labelled_table`), with labels O and B-/I- of the four kinds. A word without a digit
or an @ can only be O, in training and in decoding; so the best path of a whole text passes
through O there, and the text is decoded exactly by Viterbi over the runs of other words
between, many runs at a time in numpy. Spans of the CRF that touch no base span are added; base spans stay.

Memory: features exist for BLOCK_WORDS words at a time. A longer run advances in blocks that hand on their Viterbi
row, and keeps 25 bytes for each word (its bounds and back pointers). Time grows in proportion to a text's length.

The labelled table, and the rows held out from it, are made from templates; a few texts labelled by hand are in the tests.

Nulls: a null text is empty (no spans); a null doc_id is kept. Repeated rows are returned as often as
they come. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive where nothing follows that could take a character back: no memory for each repetition
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An @ ends every local part, so each match is found from its @ outwards, in linear time."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    if not _ANY.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the labelled table -------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_FILLER = "the of and was in on with from this that her his call at to for is by table figure page line see order about since until near".split()
_LEAD = {"email": "email mail contact write address".split(), "ip": "ip host server address from".split(), "card": "card visa paid number charge".split(), "phone": "phone tel call mobile fax".split()}


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _name(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, 14)
    return next(body + d for d in "0123456789" if luhn(body + d))


def _entity(r: random.Random, kind: str) -> str:
    a, b, c = r.choice("23456789") + _digits(r, 2), r.choice("23456789") + _digits(r, 2), _digits(r, 4)
    octets = [str(r.randint(0, 255)) for _ in range(4)]
    card = _card(r)
    return {
        "email": lambda: r.choice([f"{_name(r)}@{_name(r)}.com", f"{_name(r)}.{_digits(r, 2)}@{_name(r)}.example.org", f"{_name(r)} @ {_name(r)}.net", f"{_name(r)}{_digits(r, 2)}@ {_name(r)}.com", f"{_name(r)} @{_name(r)}.org"]),
        "ip": lambda: r.choice([".".join(octets), ".".join(octets), f"2001:db8:{_digits(r, 2)}::{_digits(r, 1)}", f"fe80:0:0:0:{_digits(r, 3)}:5eff:fe{_digits(r, 2)}:{_digits(r, 4)}"]),
        "card": lambda: r.choice([card, " ".join(card[i : i + 4] for i in (0, 4, 8, 12)), "-".join(card[i : i + 4] for i in (0, 4, 8, 12)), ".".join(card[i : i + 4] for i in (0, 4, 8, 12))]),
        "phone": lambda: r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(20, 99)} {a} {b} {c}", f"({a}) {b} {c}"]),
    }[kind]()


def _decoy(r: random.Random) -> str:
    n = r.randint
    return r.choice([
        f"{n(1900, 2039)}", f"{n(1, 9)}.{n(0, 9)}", f"{n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 99)}", f"{n(1, 999)},{n(100, 999)}", f"{n(1900, 2039)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(0, 23)}:{n(0, 59):02d}", f"#{n(1, 99999)}",
        f"{n(1, 99)}%", f"${n(1, 999)}.{n(0, 99):02d}", f"v{n(1, 9)}.{n(0, 9)}", f"{n(1, 12)}/{n(1, 31)}/{n(1990, 2030)}", f"978-{n(0, 9)}-{n(1000, 9999)}-{n(1000, 9999)}-{n(0, 9)}", f"@{_name(r)}", "@", f"{_name(r)}{n(1, 99)}", f"[{n(1, 99)}]",
        f"{n(256, 999)}.{n(256, 999)}.{n(0, 255)}.{n(0, 255)}", _digits(r, n(5, 15)), _digits(r, n(20, 40)), f"{n(10, 99)}-{n(10, 99)}", f"({n(1, 99)})", f"{n(1, 20)}-{n(21, 60)}", "".join(r.choice("0123456789abcdef") for _ in range(n(8, 40))),
        f"{n(1, 9)}e-{n(1, 9)}", f"{n(100, 999)} {n(100, 999)}", f"{n(1, 9)} {n(10, 99)} {n(100, 999)}", f"{n(1900, 2039)} {n(1900, 2039)}", f"token={_digits(r, 6)}", f"{_digits(r, 3)}_{_digits(r, 4)}", f"{n(1, 9)}x{n(1, 9)}",
    ])


def labelled_table(rows: int = 1500, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts with the spans of personal data in them, made from templates; cards that fail their check digit and addresses out of range are among the decoys."""
    r, table = random.Random(seed), []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.randint(2, 5)):
            text += " ".join(r.choice(_FILLER) if r.random() < 0.5 else _name(r) for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                if r.random() < 0.5:
                    text += r.choice(_LEAD[kind]) + r.choice([" ", ": "])
                open_, close = r.choice([("", ""), ("", ""), ("", ","), ("", "."), ("(", ")"), ("", "$$$")])
                text += open_
                own = _entity(r, kind)
                spans.append((kind, len(text), len(text) + len(own)))
                text += own + close + " "
                if r.random() < 0.25:  # another one right after it
                    kind = r.choice(KINDS)
                    own = _entity(r, kind)
                    spans.append((kind, len(text), len(text) + len(own)))
                    text += own + " "
            else:
                text += _decoy(r) + r.choice(["", "", ",", ".", "###"]) + " "
                if r.random() < 0.3:
                    text += _decoy(r) + " "
        table.append((text, spans))
    return table


# --- words, features, runs ----------------------------------------------------------------------

BLOCK_WORDS = 20_000
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NEXT = re.compile(r"[^\S\n]+(\S+)")
_FIRST = re.compile("[A-Za-z0-9(+@]")
_LAST = re.compile("[A-Za-z0-9)@]")
_SHAPE = str.maketrans({c: s for own, s in ((string.ascii_uppercase, "X"), (string.ascii_lowercase, "x"), (string.digits, "d")) for c in own})
_DIGIT = str.maketrans(dict.fromkeys(string.digits, "d"))
_AGAIN = re.compile(r"(.)\1+", re.S)


class Run:
    """Adjacent words, as offsets in their text."""

    def __init__(self):
        self.start, self.end = array("q"), array("q")

    def add(self, start: int, end: int) -> None:
        self.start.append(start)
        self.end.append(end)

    def __len__(self) -> int:
        return len(self.start)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return zip(self.start, self.end)


def _begin(text: str, since: int, a: int, b: int) -> Run:
    """A run from the word at a; a plain word before an @ that stands alone or begins a word belongs to it."""
    run = Run()
    if text[a] == "@":
        gap = text[since:a]
        body = gap.rstrip()
        if body and len(body) < len(gap) and "\n" not in gap[len(body) :]:
            run.add(since + len(body) - len(body.rsplit(None, 1)[-1]), since + len(body))
    run.add(a, b)
    return run


def _close(text: str, run: Run) -> Run:
    """A plain word after an @ that ends a word belongs to the run."""
    if text[run.end[-1] - 1] == "@" and (m := _NEXT.match(text, run.end[-1])):
        run.add(*m.span(1))
    return run


def iter_runs(text: str) -> Iterator[Run]:
    """Runs of adjacent words that hold a digit or an @, one after the other."""
    run, since = None, 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        if run is not None:
            if (gap := text[run.end[-1] : a]).isspace() and "\n" not in gap:
                run.add(a, b)
                continue
            yield _close(text, run)
            since = run.end[-1]
        run = _begin(text, since, a, b)
    if run is not None:
        yield _close(text, run)


def runs_of(text: str) -> list[Run]:
    return list(iter_runs(text))


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    """The word without punctuation around it."""
    first = _FIRST.search(text, a, b)
    last = _LAST.search(text[a:b][::-1])
    if not first or not last or b - last.end() < first.start():
        return a, b
    a, b = first.start(), b - last.start()
    opened, closed = text.count("(", a, b), text.count(")", a, b)
    while b - a > 1 and text[a] == "(" and (opened > closed or (text[b - 1] == ")" and b - a > 7 and closed == 1)):
        both = text[b - 1] == ")" and opened <= closed
        a, b, opened, closed = a + 1, b - both, opened - 1, closed - both
    while b - a > 1 and text[b - 1] == ")" and closed > opened:
        b, closed = b - 1, closed - 1
    return a, b


def _short(word: str, most: int) -> str:
    return word if len(word) <= most else "long"


def _clean(word: str) -> str:
    return _short("".join(c for c in word.lower() if "a" <= c <= "z"), 12)


def _own_features(exact: str, word: str) -> list[str]:
    """Of a word alone; `exact` is its shape, letter by letter."""
    digits = exact.count("d")
    own = [
        "bias", f"shape={_AGAIN.sub(chr(92) + '1', exact)}", f"exact={exact if len(exact) <= 20 else ''}", f"digits={min(digits, 20)}", f"dots={min(exact.count('.'), 4)}", f"colons={min(exact.count(':'), 3)}", f"first={exact[:1]}", f"last={exact[-1:]}", f"at={'@' in exact}",
    ]
    return own + _value_features(exact, word)


def _value_features(exact: str, word: str) -> list[str]:
    """What the shape doesn't tell: check digits and ranges."""
    out, digits = [], exact.count("d")
    if digits >= 16:
        out.append(f"luhn={digits <= 19 and luhn(''.join(c for c in word if c in string.digits))}")
    if exact.count(".") == 3 and all(p and len(p) < 5 and p == "d" * len(p) for p in exact.split(".")):
        out.append(f"octets={all(int(p) < 256 for p in word.split('.'))}")
    return out


class Block:
    """Words i to j of a run, with what their features need of the words around."""

    def __init__(self, text: str, run: Run, i: int, j: int):
        low, high = max(0, i - 4), min(len(run), j + 1)
        cores = [_core(text, run.start[k], run.end[k]) for k in range(low, high)]
        words = [text[a:b] for a, b in cores]
        self.words = words[i - low : j - low]
        self.exact = [w.translate(_SHAPE) for w in words]
        neighbours = [_short(w, 14).translate(_DIGIT) for w in words]
        closes = [text[b : min(run.end[low + k], b + 2)] for k, (_, b) in enumerate(cores)]
        fours, n = [], 0  # words of four digits that stand right before, up to four; -1 for another word
        for e in self.exact:
            fours.append(min(n, 4) if e == "dddd" else -1)
            n = n + 1 if e == "dddd" else 0
        self.context = []
        for k in range(i - low, j - low):
            at = low + k
            before = after = ""
            if at == 0:
                before = _clean(_word_before(text, run.start[0])) if run.start[0] else "^"
            if at == len(run) - 1:
                after = _clean(_word_after(text, run.end[-1]))
            self.context.append((
                f"closed={closes[k - 1] if at else ''}", f"closes={closes[k]}", f"opened={cores[k][0] > run.start[at]}", f"four={fours[k]}",
                f"before={before}", f"after={after}", f"left={neighbours[k - 1] if at else ''}", f"right={neighbours[k + 1] if at + 1 < len(run) else ''}",
            ))
        self.exact = self.exact[i - low : j - low]


_BACK = 64  # characters of a look to either side, doubled until a whole word is there


def _word_before(text: str, at: int) -> str:
    """The word that ends before `at`, '^' if there is none but white space; whole, and within its line or a line before."""
    size = _BACK
    while True:
        part = text[max(0, at - size) : at].rstrip()
        words = part.rsplit(None, 1)
        if at <= size or len(words) > 1 or (part and part[0].isspace()):
            return words[-1] if words else "^"
        size *= 2


def _word_after(text: str, at: int) -> str:
    size = _BACK
    while True:
        part = text[at : at + size].lstrip()
        words = part.split(None, 1)
        if at + size >= len(text) or len(words) > 1 or (part and part[-1].isspace()):
            return words[0] if words else "$"
        size *= 2


def features(text: str, run: Run) -> list[list[str]]:
    block = Block(text, run, 0, len(run))
    return [_own_features(e, w) + list(c) for e, w, c in zip(block.exact, block.words, block.context)]


class Crf:
    """Weights of features by label, and of transitions; a run stands between two O."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self.padded = np.vstack([emit, np.zeros((1, emit.shape[1]))])  # a row for features without a weight
        self.known: dict[tuple, np.ndarray] = {}

    def __reduce__(self):
        return Crf, (self.index, self.emit, self.move)

    def scores(self, runs: list[list[list[str]]]) -> list[np.ndarray]:
        get = self.index.get
        return [np.array([self.emit[[k for f in word if (k := get(f)) is not None]].sum(axis=0) for word in run]) for run in runs]

    def _own(self, exact: str, word: str) -> np.ndarray:
        """Score of a word's own features; those of short shapes are kept, KNOWN of them at most."""
        key = (exact, *_value_features(exact, word)) if len(exact) <= 32 else None
        found = self.known.get(key)
        if found is None:
            found = self.scores([[_own_features(exact, word)]])[0][0]
            if key is not None:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[key] = found
        return found

    def emissions(self, blocks: list[Block]) -> np.ndarray:
        """Scores by label of the words of blocks, one after the other."""
        none, get = len(self.emit), self.index.get
        own = [self._own(e, w) for b in blocks for e, w in zip(b.exact, b.words)]
        around = np.array([[get(f, none) for f in c] for b in blocks for c in b.context], np.int64)
        return np.array(own) + self.padded[around].sum(axis=1)

    def viterbi(self, runs: list[list[list[str]]]) -> list[list[int]]:
        """Best labels of each run of feature lists."""
        given = self.scores(runs)
        return [p.tolist() for p in self.decode(np.concatenate(given), [len(g) for g in given])] if runs else []

    def decode(self, scores: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
        """Best labels of runs that stand one after the other; they advance together, longest first, one word at a time."""
        sizes = np.array(lengths)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[order], sizes[order]
        best = scores[begin] + self.move[0]
        back = []
        for t in range(1, int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t, side="left"))
            both = best[:n, :, None] + self.move[None]
            back.append(both.argmax(axis=1).astype(np.int8))
            best[:n] = both.max(axis=1) + scores[begin[:n] + t]
        label = (best + self.move[:, 0]).argmax(axis=1)
        paths = np.zeros(len(scores), np.int8)
        for t in range(int(sizes[0]) - 1, -1, -1):
            n = int(np.searchsorted(-sizes, -t, side="left"))
            paths[begin[:n] + t] = label[:n]
            if t:
                label[:n] = back[t - 1][np.arange(n), label[:n]]
        return np.split(paths, np.cumsum(np.array(lengths))[:-1])

    def decode_long(self, text: str, run: Run) -> np.ndarray:
        """Best labels of one long run, in blocks."""
        back, best = np.zeros((len(run), len(LABELS)), np.int8), None
        for i in range(0, len(run), BLOCK_WORDS):
            scores = self.emissions([Block(text, run, i, min(i + BLOCK_WORDS, len(run)))])
            for t in range(len(scores)):
                if best is None:
                    best = scores[0] + self.move[0]
                else:
                    both = best[:, None] + self.move
                    back[i + t] = both.argmax(axis=0)
                    best = both.max(axis=0) + scores[t]
        path = np.zeros(len(run), np.int8)
        label = int((best + self.move[:, 0]).argmax())
        for t in range(len(run) - 1, -1, -1):
            path[t] = label
            label = int(back[t, label])
        return path


#: Scores of shapes that a worker keeps.
KNOWN = 50_000


def _spans_of(text: str, run: Run, path: np.ndarray) -> list[Span]:
    out: list[list] = []
    for k in np.flatnonzero(np.asarray(path)).tolist():
        kind, begins = KINDS[(int(path[k]) - 1) // 2], int(path[k]) % 2 == 1
        a, b = _core(text, run.start[k], run.end[k])
        if begins or not out or out[-1][0] != kind:
            out.append([kind, a, b])
        else:
            out[-1][2] = b
    return [tuple(s) for s in out]


def _allowed() -> np.ndarray:
    move = np.zeros((len(LABELS), len(LABELS)))
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y.startswith("I-") and x[2:] != y[2:]:
                move[a, b] = -30.0  # an I follows its own kind alone
    return move


def train(table: list[tuple[str, list[Span]]], rounds: int = 60, decay: float = 1e-3, rate: float = 0.15) -> Crf:
    """Maximum likelihood with L2 decay by Adam; gradients from forward-backward over all runs at once."""
    runs, gold = [], []
    for text, spans in table:
        for run in runs_of(text):
            path, seen = [], None
            for a, b in run:
                a, b = _core(text, a, b)
                own = next((s for s in spans if s[1] < b and a < s[2]), None)
                path.append(0 if own is None else 1 + 2 * KINDS.index(own[0]) + (own == seen))
                seen = own
            runs.append(features(text, run))
            gold.append(path)
    order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))  # longest first: at each place the runs that reach it come first
    runs, gold = [runs[k] for k in order], [gold[k] for k in order]
    counts: dict[str, int] = {}
    for run in runs:
        for word in run:
            for f in word:
                counts[f] = counts.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 3))}
    n_f, n_l, n, t_max = len(index), len(LABELS), len(runs), len(runs[0])
    rows = [(i, t, index[f]) for i, run in enumerate(runs) for t, word in enumerate(run) for f in word if f in index]
    at = np.array([i * t_max + t for i, t, _ in rows])
    which = np.array([f for _, _, f in rows])
    by_feature = np.argsort(which, kind="stable")
    cells, edges = np.unique(which[by_feature], return_index=True)
    by_cell = np.argsort(at, kind="stable")
    used, cell_edges = np.unique(at[by_cell], return_index=True)
    lengths = np.array([len(r) for r in runs])
    reach = [int((lengths > t).sum()) for t in range(t_max)] + [0]  # runs that have a word t
    mask = np.arange(t_max)[None] < lengths[:, None]
    y = np.zeros((n, t_max), np.int64)
    for i, path in enumerate(gold):
        y[i, : len(path)] = path
    fixed = _allowed()
    emit, move = np.zeros((n_f, n_l)), np.zeros((n_l, n_l))
    state = [np.zeros_like(v) for v in (emit, emit, move, move)]
    truth = np.eye(n_l)[y] * mask[:, :, None]
    truth_move = np.zeros((n_l, n_l))
    np.add.at(truth_move, (0, y[:, 0]), 1)
    np.add.at(truth_move, (y[np.arange(n), lengths - 1], 0), 1)
    for t in range(1, t_max):
        on = mask[:, t]
        np.add.at(truth_move, (y[on, t - 1], y[on, t]), 1)
    for step in range(1, rounds + 1):
        e = np.zeros((n * t_max, n_l))
        e[used] = np.add.reduceat(emit[which[by_cell]], cell_edges, axis=0)
        e = e.reshape(n, t_max, n_l)
        m = move + fixed
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = m[0] + e[:, 0]
        for t in range(1, t_max):
            k = reach[t]
            forward[:k, t] = _lse(forward[:k, t - 1][:, :, None] + m[None], 1) + e[:k, t]
        end = m[:, 0]
        log_z = _lse(forward[np.arange(n), lengths - 1] + end, 1)
        for t in range(t_max - 1, -1, -1):
            k = reach[t + 1]
            backward[k : reach[t], t] = end
            if k:
                backward[:k, t] = _lse(m[None] + (e[:k, t + 1] + backward[:k, t + 1])[:, None, :], 2)
        p = np.where(mask[:, :, None], np.exp(np.minimum(forward + backward - log_z[:, None, None], 0)), 0)
        expected = np.zeros((n_l, n_l))
        expected[0] += p[:, 0].sum(axis=0)
        expected[:, 0] += p[np.arange(n), lengths - 1].sum(axis=0)
        for t in range(1, t_max):
            k = reach[t]
            pair = forward[:k, t - 1][:, :, None] + m[None] + (e[:k, t] + backward[:k, t])[:, None, :] - log_z[:k, None, None]
            expected += np.exp(pair).sum(axis=0)
        by_word = (truth - p).reshape(-1, n_l)
        grad = np.zeros((n_f, n_l))
        grad[cells] = np.add.reduceat(by_word[at[by_feature]], edges, axis=0)
        grads = (grad / n - decay * emit, (truth_move - expected) / n - decay * move)
        for k, (value, g) in enumerate(zip((emit, move), grads)):
            first, second = state[2 * k], state[2 * k + 1]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Crf(index, np.round(emit, 6), np.round(move, 6) + fixed)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@lru_cache(1)
def default_model() -> Crf:
    return train(labelled_table())


def find_all(texts: list[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans, by kind as listed, then start."""
    out = [base_spans(text) for text in texts]
    extra: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, Run]] = []
    words = 0

    def decode() -> None:
        scores = model.emissions([Block(texts[k], run, 0, len(run)) for k, run in held])
        for (k, run), path in zip(held, model.decode(scores, [len(run) for _, run in held])):
            if path.any():
                extra[k].extend(_spans_of(texts[k], run, path))
        held.clear()

    for k, text in enumerate(texts):
        if not _ANY.search(text):
            continue
        for run in iter_runs(text):
            if len(run) > BLOCK_WORDS // 4:
                path = model.decode_long(text, run)
                extra[k] += _spans_of(text, run, path)
                continue
            held.append((k, run))
            words += len(run)
            if words >= BLOCK_WORDS:
                decode()
                words = 0
    if held:
        decode()
    done = []
    for base, more in zip(out, extra):
        taken = sorted((a, b) for _, a, b in base)
        free, i, reach = [], 0, 0
        for s in sorted(more, key=lambda s: s[1]):
            while i < len(taken) and taken[i][0] < s[2]:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= s[1]:
                free.append(s)
        done.append((base, sorted([*base, *free], key=lambda s: (KINDS.index(s[0]), s[1]))))
    return done


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of base and method)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_all(batch.column(1).to_pylist(), model)
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(all_) for _, all_ in found], pa.string()), pa.array([len(all_) for _, all_ in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    return common.map_arrow(own, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(common.documents(spark, sf_dir))
