"""Personal data: base patterns plus a character-level bidirectional LSTM with CRF transitions, in numpy.

The net learns from a bounded sample of windows of the documents: spans that the base patterns label, values written in
other ways, and numbers that are no personal data. Some forms speak for themselves (a spelled-out address, an area code
in brackets); plain groups of digits are taken as a telephone number only where a word such as "call" stands shortly
before them, as nothing else tells them from years, parts or scores. At run time the emissions of overlapping
windows around digits, at signs and spelled-out addresses are averaged, and each whole stretch is decoded at once by the
CRF, so its tags agree with each other wherever windows meet.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Span, materialise, span_digest, span_text

KINDS = ("email", "ip", "card", "phone")
#: Spans that only the net found have the kind with this suffix.
ADDED = tuple(f"{k}_net" for k in KINDS)
ALL_KINDS = (*KINDS, *ADDED)
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

WINDOW = 64
STRIDE = 32
MARGIN = 24
HIDDEN = 20
#: Windows of one document in the sample, at most.
DOC_WINDOWS = 6
#: Windows used for training, at most; documents looked at for them, at most about (by hash of doc_id).
TRAIN_WINDOWS = 1600
TRAIN_DOCS = 20_000
EPOCHS = 22
SEED = 11
#: Windows decoded at once.
BATCH = 2048

IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: A chain that is too short cannot match from a later start either, so the least length is in the pattern.
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: What a text needs for a base span, and for one that the net may add.
TRIGGER = re.compile(r"[0-9@]")
SPELLED = r"(?i:[\[( ]at[\]) ][^\n]{1,40}?[\[( ]dot[\]) ]|[\[(] ?at ?[\])])"
ANY_TRIGGER = re.compile(rf"[0-9@]|{SPELLED}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches from each at sign outwards: linear, where a pattern would rescan long words."""
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return spans


def base_spans(text: str) -> list[Span]:
    """The fixed patterns: leftmost, non-overlapping within a kind, failing matches dropped."""
    if not TRIGGER.search(text):
        return []
    spans = emails(text)
    spans += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if len(d := digits_of(m[0])) <= 19 and luhn(d)]
    return spans + [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]


_CLASSES = "0 1 2 abcdefghijklmnopqrstuvwxyz @ . - _ + % ( ) [ ] , : / = ' \" | # $ & * !".replace("abcdefghijklmnopqrstuvwxyz", " ".join("abcdefghijklmnopqrstuvwxyz")).split()
CLASSES = len(_CLASSES) + 5
_table: list[np.ndarray] = []


def char_classes(text: str) -> np.ndarray:
    """Class of each character: 0, 1 and other digits, letters without case, marks, blanks, line ends, the rest; 0 pads."""
    if not _table:
        table = np.full(129, CLASSES - 1, dtype=np.int8)
        for i in range(128):
            c = chr(i)
            key = "2" if c in "3456789" else c.lower()
            table[i] = 1 + _CLASSES.index(key) if key in _CLASSES else CLASSES - 4 if c == " " else CLASSES - 3 if c.isspace() else CLASSES - 2
        _table.append(table)
    return _table[0][np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32), 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """Weights: input (by class) and recurrent ones of both directions, output, transitions, start scores."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, rng: np.random.Generator) -> Net:
        k, h = len(TAGS), HIDDEN
        p = {"x": rng.normal(0, 0.3, (2, CLASSES, 4 * h)), "h": rng.normal(0, 0.3, (2, h, 4 * h))}
        p["x"][:, :, h : 2 * h] += 1.0  # forget gates start open
        p |= {"o": rng.normal(0, 0.3, (2 * h, k)), "b": np.zeros(k), "t": np.zeros((k, k)), "s": np.zeros(k)}
        return cls({name: v.astype(np.float32) for name, v in p.items()})

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Tag scores (T, N, tags) of windows (N, T). Both directions go side by side, the second from the end."""
        (n, steps), h = x.shape, HIDDEN
        wx, wh = self.p["x"], self.p["h"]
        both = np.stack([x, x[:, ::-1]])
        inputs = np.stack([wx[d][both[d].T] for d in range(2)], axis=1)  # (T, 2, N, 4H)
        hs, state, cell, kept = np.zeros((steps, 2, n, h), wx.dtype), np.zeros((2, n, h), wx.dtype), np.zeros((2, n, h), wx.dtype), []
        for t in range(steps):
            z = inputs[t] + state @ wh
            gates = _sigmoid(z[..., : 3 * h])
            new, before = np.tanh(z[..., 3 * h :]), cell
            cell = gates[..., h : 2 * h] * cell + gates[..., :h] * new
            tanh = np.tanh(cell)
            if keep:
                kept.append((state, before, gates, new, tanh))
            state = gates[..., 2 * h :] * tanh
            hs[t] = state
        joined = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)
        return joined @ self.p["o"] + self.p["b"], (joined, both, kept)

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each sequence of emissions (T, tags), by Viterbi; sequences of any length go together."""
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
        for at in range(0, len(order), BATCH):
            part = [i for i in order[at : at + BATCH] if len(scores[i])]
            if not part:
                continue
            sizes = np.array([len(scores[i]) for i in part])
            best, back = self.p["s"] + np.stack([scores[i][0] for i in part]), []
            for t in range(1, sizes[0]):
                n = int(np.searchsorted(-sizes, -t, side="left"))  # those longer than t, which come first
                paths = best[:n, :, None] + self.p["t"]
                back.append(paths.argmax(axis=1).astype(np.int8))
                best[:n] = np.take_along_axis(paths, back[-1][:, None, :].astype(np.int64), axis=1)[:, 0] + np.stack([scores[i][t] for i in part[:n]])
            for row, i in enumerate(part):
                tags = [int(best[row].argmax())]
                for step in reversed(back[: sizes[row] - 1]):
                    tags.append(int(step[row, tags[-1]]))
                out[i] = np.array(tags[::-1])
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood per character and its gradient: CRF forward-backward, then through time."""
        e, (joined, both, kept) = self.emissions(x, keep=True)
        steps, n, k = e.shape
        trans = self.p["t"]

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = self.p["s"] + e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        pairs = np.exp(alpha[:-1, :, :, None] + trans + (e + beta)[1:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
        gold = self.p["s"][y[:, 0]] + sum(e[t][np.arange(n), y[:, t]] for t in range(steps)) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        loss = float((z - gold).mean() / steps)
        np.subtract.at(pairs, (y[:, :-1], y[:, 1:]), 1)
        de[np.arange(steps)[:, None], np.arange(n)[None, :], y.T] -= 1
        de /= n
        grad = {"t": pairs / n, "s": de[0].sum(axis=0), "o": np.einsum("tnh,tnk->hk", joined, de), "b": de.sum(axis=(0, 1))}
        h, wh = HIDDEN, self.p["h"]
        back = de @ self.p["o"].T
        dh = np.stack([back[..., :h], back[::-1, :, h:]], axis=1)  # (T, 2, N, H), each in its own direction's order
        dzs = np.zeros((steps, 2, n, 4 * h), e.dtype)
        dstate, dcell = np.zeros((2, n, h), e.dtype), np.zeros((2, n, h), e.dtype)
        turned = wh.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            state, before, gates, new, tanh = kept[t]
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            up = dh[t] + dstate
            dcell = dcell + up * o * (1 - tanh * tanh)
            dz = np.concatenate([dcell * new * i * (1 - i), dcell * before * f * (1 - f), up * tanh * o * (1 - o), dcell * i * (1 - new * new)], axis=2)
            dzs[t] = dz
            dstate, dcell = dz @ turned, dcell * f
        onehot = np.eye(CLASSES, dtype=e.dtype)
        states = np.stack([k[0] for k in kept])
        flat = [dzs[:, d].reshape(-1, 4 * h) for d in range(2)]
        grad["x"] = np.stack([onehot[both[d].T.reshape(-1)].T @ flat[d] for d in range(2)])
        grad["h"] = np.stack([states[:, d].reshape(-1, h).T @ flat[d] for d in range(2)])
        return loss, grad


def train(windows: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = SEED, batch: int = 64) -> Net | None:
    """A net from (window text, spans in it), by Adam. Digits' values and cases do not matter, only their classes."""
    if not windows:
        return None
    rng = np.random.default_rng(seed)
    x = np.zeros((len(windows), WINDOW), dtype=np.int64)
    y = np.zeros((len(windows), WINDOW), dtype=np.int64)
    for n, (text, spans) in enumerate(windows):
        codes = char_classes(text[:WINDOW])
        x[n, : len(codes)] = codes
        for s, e, kind in spans:
            tag = TAGS.index(f"B-{kind}")
            y[n, s:e] = tag + 1
            y[n, s] = tag
    net, step, steps = Net.new(rng), 0, epochs * -(-len(x) // batch)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            _, grad = net.gradient(x[rows], y[rows])
            step += 1
            for name, g in grad.items():
                g = np.clip(g, -1, 1).astype(np.float32)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                rate = 0.02 * min(1.0, 2.5 * (1 - step / steps) + 0.02)  # falls over the last two fifths
                net.p[name] = (net.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: np.random.Generator, words: Sequence[str] = ()) -> str:
    """A name: one of ``words``, some syllables, or any letters, so that no look of a word counts."""
    roll = rng.random()
    if words and roll < 0.4:
        return words[int(rng.integers(len(words)))]
    if roll < 0.75:
        return "".join("bcdfghjklmnprstvwz"[rng.integers(18)] + "aeiou"[rng.integers(5)] + ("", "", "n", "r", "s")[rng.integers(5)] for _ in range(rng.integers(1, 4)))
    return "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(0, 26, rng.integers(2, 9)))


def card_number(rng: np.random.Generator) -> str:
    """16 digits whose last makes them pass the check."""
    head = "4" + _digits(rng, 14)
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


#: Phrases before a telephone number, and endings of addresses, in generated windows.
CALLS = ("call", "call me at", "tel", "tel.", "phone", "phone:", "telephone", "fax", "Fax:", "mobile", "cell", "ring", "text me at", "Telefon", "Tel.:", "Handy", "anrufen unter", "téléphone", "appelez le", "teléfono", "llame al", "contact")
ENDINGS = ("com", "org", "net", "de", "fr", "es", "io", "edu", "info", "co.uk")


def written_otherwise(kind: str, rng: np.random.Generator, words: Sequence[str] = ()) -> str:
    """A value of a kind, written in a way that the base patterns do not know and that speaks for itself."""
    while base_spans(value := _otherwise(kind, rng, words)):
        pass  # a telephone number may pass for a card number
    return value


def _otherwise(kind: str, rng: np.random.Generator, words: Sequence[str]) -> str:
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    if kind == "email":
        at, dot = pick((" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), (" [at] ", "."), ("(at)", "."), (" (at) ", "."), ("[at]", "."))
        name = _word(rng, words) + pick("", "", "", dot + _word(rng, words), _digits(rng, 2), "_" + _word(rng, words), "." + _word(rng, words))
        return name + at + _word(rng, words) + pick("", "", pick(dot, ".", "-") + _word(rng, words)) + dot + pick(*ENDINGS)
    if kind == "ip":
        return pick(" . ", "[.]", " dot ", "(.)").join(str(x) for x in rng.integers(1, 256, 4))
    if kind == "card":
        n, mark = card_number(rng), pick(".", "/", " - ", "_")
        return mark.join(n[i : i + 4] for i in range(0, 16, 4))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    code = pick("49", "33", "34", "44")
    return pick(f"({a}) {b}-{c}", f"({a}){b}-{c}", f"({a}) {b} {c}", f"({a}) {b}.{c}", f"({a}) {b}{c}", f"00{code} {a} {b}{c}", f"0{a}/{b} {c}", f"0{a}-{b}{c}", f"0{a}/{b}{c}", f"1-{a}-{b}-{c}", f"1-8{pick('00', '88', '77')}-{b}-{c}")


def plain_groups(rng: np.random.Generator) -> str:
    """Groups of digits that may be a telephone number or anything else."""
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    mark = (" ", ".", "-")[int(rng.integers(3))]
    return mark.join((a, b, c)) if rng.random() < 0.8 else mark.join(_digits(rng, 4) for _ in range(3))


def written_plainly(kind: str, rng: np.random.Generator, words: Sequence[str] = ()) -> str:
    """A value of a kind as the base patterns know it."""
    n = lambda k: _digits(rng, k)
    if kind == "email":
        return f"{_word(rng, words)}{['', '.' + _word(rng, words), n(2)][int(rng.integers(3))]}@{_word(rng, words)}{['', n(1) + '.' + _word(rng, words)][int(rng.integers(2))]}.{['com', 'org', 'net', 'de'][int(rng.integers(4))]}"
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        number = card_number(rng)
        return ["", "", " ", "-"][int(rng.integers(4))].join(number[i : i + 4] for i in range(0, 16, 4))
    return f"+{n(int(rng.integers(1, 3)))} {[f'({n(3)}) {n(3)}-{n(4)}', f'{n(3)} {n(7)}', f'{n(2)} {n(4)} {n(4)}'][int(rng.integers(3))]}"


def harmless(rng: np.random.Generator, words: Sequence[str] = ()) -> str:
    """Numbers that are no personal data."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    n = lambda k: _digits(rng, k)
    return pick(
        f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.20{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"v{n(1)}.{n(2)}.{n(1)}", f"{n(3)},{n(3)}.{n(2)}", f"${n(4)}.{n(2)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}",
        f"pp. {n(3)}-{n(3)}", f"{n(pick(5, 6, 7, 8, 9, 11, 12, 20, 22))}", f"{n(2)} x {n(3)} x {n(2)}", f"id {n(6)}-{n(6)}-{n(6)}", f"{n(4)} {n(4)}", f"{n(1)}.{n(1)}.{n(1)}", f"{_word(rng, words)} at {_word(rng, words)} a dot {_word(rng, words)}", f"{_word(rng, words)} (at) {_word(rng, words)}", f"{n(3)} {n(3)}", f"{n(2)} {n(2)} {n(2)} {n(2)}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(4)}-{n(4)}-{n(4)}",
    )


def generated(rng: np.random.Generator, words: Sequence[str] = ()) -> tuple[str, str, str | None]:
    """(words before, value, kind or None)."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    roll = rng.random()
    if roll < 0.12:
        return f"{pick(CALLS)}{pick((' ', ': ', ' is ', ' '))}", plain_groups(rng), "phone"
    if roll < 0.30:
        return "", harmless(rng, words), None
    kind = pick(("email", "email", "ip", "card", "phone", "phone"))
    before = "" if rng.random() < 0.7 else f"{pick(CALLS)} " if kind == "phone" else f"{pick(('mail', 'write to', 'please reach', 'from', 'host', 'paid by', 'e-mail:'))} "
    return before, (written_plainly if rng.random() < 0.35 else written_otherwise)(kind, rng, words), kind


def training_windows(text: str, rng: np.random.Generator) -> Iterator[tuple[str, list[Span], bool]]:
    """(window, spans, whether the value is the document's own). Up to DOC_WINDOWS windows of a document: round labelled
    spans, each at a random place in its window, round other numbers, and round generated values or harmless numbers."""
    spans, last = [], 0
    for x in sorted((s, e, k) for s, e, k in base_spans(text) if e - s <= WINDOW - 8):
        if x[0] >= last:  # overlapping spans teach nothing clear
            spans.append(x)
            last = x[1]
    starts = [s for s, _, _ in spans]
    others = [m.span() for m in re.finditer(r"[0-9]{3,}", text) if not ((i := bisect_right(starts, m.start())) and spans[i - 1][1] > m.start())]
    centres = [(s, e) for s, e, _ in spans] + [others[i] for i in rng.permutation(len(others))[:2]]
    for i in rng.permutation(len(centres))[: DOC_WINDOWS - 3]:
        s, e = centres[i]
        at = max(0, s - int(rng.integers(0, max(1, WINDOW - (e - s)))))
        near = spans[max(0, bisect_right(starts, at) - 1) : bisect_right(starts, at + WINDOW)]
        if not any((a < at < b) or (a < at + WINDOW < b) for a, b, _ in near):
            yield text[at : at + WINDOW], [(a - at, b - at, k) for a, b, k in near if at <= a and b <= at + WINDOW], True
    for _ in range(3):
        at = int(rng.integers(0, max(1, len(text))))
        at += 1 if not (space := re.compile(r"\s").search(text, at)) else space.start() - at
        before, after = text[max(0, at - WINDOW) : at], text[at : at + WINDOW]
        lead, value, kind = generated(rng, re.findall(r"\b[a-z]{2,10}\b", f"{before} {after}".lower()))
        opened, closed = (("", ""), ("", ""), ("", ""), ("", ","), ("", "."), ("(", ")"), ("<", ">"))[int(rng.integers(7))]
        if base_spans(f"{before} {after}"):
            continue
        room = max(1, WINDOW - len(lead) - len(value) - 4)
        # Some stand at the start or the end of a text, or are all of it.
        alone = rng.random(2) < 0.15
        head = ("" if alone[0] else f"{before} "[-int(rng.integers(1, room + 1)) :]) + lead + opened
        window = f"{head}{value}{closed}{'' if alone[1] else ' ' + after.lstrip()}"[:WINDOW]
        if len(head) + len(value) <= WINDOW:
            yield window, [(len(head), len(head) + len(value), kind)] if kind else [], False


def sample_windows(docs: DataFrame, limit: int = TRAIN_WINDOWS, most_docs: int = TRAIN_DOCS) -> list[tuple[str, list[Span]]]:
    """A bounded sample of labelled windows: documents by hash of the id, windows by hash of their text, up to a third of
    them round the documents' own values and numbers."""
    share = min(1.0, most_docs / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text").where("text is not null")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                rng = np.random.default_rng(len(text))
                rows += [(w, [{"s": s, "e": e, "kind": k} for s, e, k in spans], own) for w, spans, own in training_windows(text, rng)]
            if rows:
                yield pd.DataFrame(rows, columns=["window", "spans", "own"])

    made = materialise(some.mapInPandas(cut, "window string, spans array<struct<s:int,e:int,kind:string>>, own boolean"), "windows")
    order = [F.xxhash64("window"), "window"]
    own = made.where("own").orderBy(F.size("spans") == 0, *order).limit(limit // 3).collect()
    other = made.where("not own").orderBy(*order).limit(limit - len(own)).collect()
    return [(r["window"], [tuple(x) for x in r["spans"]]) for r in own + other]


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within MARGIN of a digit, an at sign or a spelled-out address."""
    out: list[list[int]] = []
    for m in ANY_TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def plausible(kind: str, text: str) -> bool:
    """What an added span has to have whatever the net says: numbers that can be of the kind, for an address a word on
    both sides of what stands for the at sign and one after the last dot."""
    digits = digits_of(text)
    if kind == "email":
        return re.fullmatch(r"(?is).*\w\W*(?:@|\bat\b)\W*\w.*(?:\.|\bdot\b)\W*[a-z]{2,}", text) is not None
    if kind == "ip":
        return len(parts := re.findall(r"[0-9]+", text)) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if re.search(r"[A-Za-z]", text):
        return False
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and len(set(re.findall(r"[^0-9]+", text))) <= 1
    return 10 <= len(digits) <= 15 and len(digits) < len(text)


#: What makes a number a telephone number by itself, and words that do so within CONTACT_CHARS before it.
EVIDENT = re.compile(r"[(/+]|00[1-9]|1-[0-9]{3}-|0[0-9]{2,5}-[0-9]{5,}$")
CONTACT_CHARS = 32
CONTACT = re.compile(r"(?i)\b(?:call(?:s|ed|ing)?|tel|telephone|phones?|fax|mob|mobile|cell|cellphone|ring|dial|hotline|text|sms|whatsapp|contact|reach|telefon|handy|mobil|anruf\w*|rufnummer|téléphon\w*|appel\w*|portable|teléfono|móvil|llam\w*)\b[^0-9\n]*$")


#: What stands for an at sign, and the name before it: a word, or words joined by spelled-out dots.
_AT = re.compile(r"(?i)\s?[\[(] ?at ?[\])]| at |@")
_NAME = re.compile(r"(?i)[\w.%+-]+(?:(?: dot | ?[\[(] ?dot ?[\])] ?)[\w.%+-]+)*$")


def name_start(text: str, start: int, end: int) -> int:
    """Where the address in a span begins: the net may take in a word before the name."""
    sign = _AT.search(text, start, end)
    name = _NAME.search(text[start : sign.start()]) if sign else None
    return start + name.start() if name else start


def told(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a telephone number shows by its form or by the words before it; other kinds always do."""
    return kind != "phone" or EVIDENT.match(text, start, end) is not None or re.search(r"[(/]", text[start:end]) is not None or CONTACT.search(text, max(0, start - CONTACT_CHARS), start) is not None


def _whole(text: str, start: int, end: int) -> bool:
    """Whether a span neither starts nor ends inside a word or number."""
    inside = lambda a, b: a.isalnum() and b.isalnum()
    return not (start > 0 and inside(text[start - 1], text[start])) and not (end < len(text) and inside(text[end - 1], text[end]))


def decoded_spans(net: Net, texts: list[str]) -> list[list[Span]]:
    """The net's spans in each text: the emissions of overlapping windows are averaged, then each stretch is decoded."""
    found: list[list[Span]] = []
    for text in texts:
        found.append([])
        stretches = regions(text)
        if not stretches:
            continue
        codes = np.concatenate([char_classes(text).astype(np.int64), np.zeros(WINDOW, np.int64)])
        places = [(i, s) for i, (a, b) in enumerate(stretches) for s in range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)]
        scores = [np.zeros((b - a, len(TAGS)), np.float32) for a, b in stretches]
        times = [np.zeros((b - a, 1), np.float32) for a, b in stretches]
        for at in range(0, len(places), BATCH):
            part = places[at : at + BATCH]
            emissions, _ = net.emissions(np.stack([codes[s : s + WINDOW] for _, s in part]))
            for n, (i, s) in enumerate(part):
                a, b = stretches[i]
                size = min(WINDOW, b - s)
                scores[i][s - a : s - a + size] += emissions[:size, n]
                times[i][s - a : s - a + size] += 1
        for (a, _), tags in zip(stretches, net.decode([x / np.maximum(t, 1) for x, t in zip(scores, times, strict=True)]), strict=True):
            start, kind = None, 0
            for i, t in enumerate([*tags.tolist(), 0]):
                which = (t + 1) // 2
                if start is not None and (which != kind or t % 2):
                    s, e = a + start, a + i
                    while s < e and text[s] in " \n":
                        s += 1
                    while e > s and text[e - 1] in " \n.,":
                        e -= 1
                    if KINDS[kind - 1] == "email":
                        s = name_start(text, s, e)
                    if e > s and _whole(text, s, e) and plausible(KINDS[kind - 1], text[s:e]) and told(KINDS[kind - 1], text, s, e):
                        found[-1].append((s, e, ADDED[kind - 1]))
                    start = None
                if which and start is None:
                    start, kind = i, which
    return found


def scan_texts(net: Net | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, spans the net adds) of each text; added spans never overlap base ones or each other."""
    base = [base_spans(t) for t in texts]
    out = []
    for b, more in zip(base, decoded_spans(net, texts) if net else [[]] * len(texts), strict=True):
        kept: list[Span] = []
        last = at = reach = 0
        order = sorted(b)
        for x in sorted(more):
            while at < len(order) and order[at][0] < x[1]:  # base spans that start before x ends
                reach = max(reach, order[at][1])
                at += 1
            if x[0] >= max(last, reach):
                kept.append(x)
                last = x[1]
        out.append((b, kept))
    return out


def find_personal_data(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """One row per document: counts by kind, base digest, span string and the array of spans.

    Null and empty texts have no spans, repeated rows give repeated results, other columns are not read. Without
    a net given one is trained on a bounded sample of ``docs``; if that has no labelled span there is none.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if net is None:
        net = train(sample_windows(docs))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch["text"]]
            for key, (base, more) in zip(batch["doc_id"], scan_texts(net, texts), strict=True):
                kinds = Counter(k for *_, k in base)
                every = sorted([*base, *more], key=lambda x: (x[0], ALL_KINDS.index(x[2])))
                rows.append((key, *(kinds[k] for k in KINDS), len(more), span_digest(base, KINDS), span_text(every, ALL_KINDS), [{"kind": k, "start": s, "end": e} for s, e, k in every]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans", "found"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"
    return docs.mapInPandas(scan, schema)


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    out, last = [], 0
    for s, e, kind in sorted(spans):
        if s >= last:
            out += [text[last:s], f"<{kind.removesuffix('_net')}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars`` counted again; all other columns kept."""
    net = train(sample_windows(docs.select("doc_id", "text")))

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        found = scan_texts(net, [t or "" for t in texts])
        return pd.Series([mask(t, [*b, *m]) for t, (b, m) in zip(texts, found, strict=True)], dtype=object)

    text = F.when(F.col("text").rlike(ANY_TRIGGER.pattern), masked("text")).otherwise(F.col("text"))
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
