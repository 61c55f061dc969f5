"""Operator 10, personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The base kinds are found by pattern. The model is trained in numpy from labelled spans: windows around
the base spans and elsewhere in a bounded sample of rows (``SAMPLE_ROWS``, chosen by a hash), and variants
of personal data set into windows of the same rows: plain, local, written out ("jane dot doe at example dot com", numbers in
words), and look-alikes that are none (dates, versions, counts). It runs over all overlapping windows of
each whole text. The windows' scores are reconciled globally: where two windows overlap, a character's score for each
tag is the mean of both, weighed by how far it is from the windows' edges, and one Viterbi path is taken over each text,
which stands between two outside characters, so a span never depends on where a window begins. A span that the path
finds is added if its mean tag probability is at least ``SURE``, it overlaps no base span, and what it
spells out passes its kind's check (``spelled``): a host with a dot, four parts up to 255, a check digit, 9 to 15 digits.

The path is made in pieces: where no run of other tags can outweigh "outside" (``_open``), every best path
is outside, so what lies between is decoded on its own. A piece of more than ``PIECE`` characters is decoded in
stretches of that length that overlap by ``MARGIN``; a span counts in the stretch in whose part it begins. The
probability of its tags is taken from the span and ``NEAR`` characters to both sides.

The activation of the network is x / (1 + |x|) in the place of tanh, which is most of the time otherwise.

Edge cases: a null text counts as empty: zeros, the digest of "", no spans. Repeated rows are each
returned. An empty table gives no rows; without any row to train from, the model is trained on the variants
in an empty context. Extra columns are ignored. Texts are run in portions of about a million bytes; a longer text is
one portion, of which about 30 bytes a character are held: scores are made a few hundred windows at a time, once for the lead
of "outside", and once more for the windows that hold a piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

#: Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # a match can only begin where its digits begin; saying so keeps long runs of digits linear
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WINDOW, STRIDE, LEARN, HIDDEN, STEPS, BATCH, SAMPLE_ROWS, SEED = 256, 224, 96, 12, 1000, 32, 400, 11
SURE, NEAR, PIECE, MARGIN, ROW = 0.5, 24, 768, 128, 256
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_OUTSIDE = np.array([0.0] + [-1e4] * (len(TAGS) - 1), np.float32)  # scores of a place that is surely outside


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    digits = re.sub("[^0-9]", "", s) if kind in ("card", "phone") else ""
    return kind == "email" or (12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)


_SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the contract's spans, by start, then kind."""
    if not (_DIGIT.search(text) or "@" in text):
        return []
    out = []
    for k, kind in enumerate(KINDS):
        if _SIGN[kind] in text:
            found = _emails(text) if kind == "email" else PATTERNS[kind].finditer(text)
            out += [(m.start(), k, m.end()) for m in found if _valid(kind, m.group())]
    return sorted(out)


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[re.Match]:
    """What finditer finds, looking only around each "@": a long run without one would be tried from each of its characters."""
    at, i = 0, text.find("@")
    while i >= 0:
        s = i
        while s > at and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = PATTERNS["email"].match(text, s) if s < i else None
        if m:
            yield m
            at = m.end()
        i = text.find("@", max(i + 1, at))


# ---- the model

_CLASS = np.full(128, 15, np.uint8)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "@", ".", "-", "+", "(", ")", " ", "\n\t\r", "_%", ",;:", "/=#&")):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
for _i in range(26):  # written-out data is told by its letters
    _CLASS[97 + _i], _CLASS[65 + _i] = 17 + _i, 43 + _i
CLASSES = 69  # 14 is the padding, 15 other ASCII, 16 beyond


def _classes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(x < 128, _CLASS[np.minimum(x, 127)], 16).astype(np.uint8)


class Model:
    """Embedding with input weights (one row a class), recurrent weights, tag scores, transitions. f forward, b backward."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        h, t = HIDDEN, len(TAGS)
        self.w = {"out": r.normal(0, 0.3, (2 * h, t)), "bias": np.zeros(t), "trans": r.normal(0, 0.1, (t, t)), "first": np.zeros(t)}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 0.4, (CLASSES, 4 * h))
            self.w[f"x{d}"][:, h : 2 * h] += 1.0  # forget gates open
            self.w[f"u{d}"] = r.normal(0, 0.3, (h, 4 * h))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def states(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Hidden states (2, T, N, H) of classes x (N, T), each direction in its own order, and what the gradients need."""
        (n, t), h = x.shape, HIDDEN
        half = np.repeat([0.5, 1.0], [3 * h, h]).astype(self.w["out"].dtype)  # a sigmoid is the activation of half its argument
        xs = np.stack([x.T, x.T[::-1]])
        inputs = np.stack([self.w[f"x{d}"][xs[k]] for k, d in enumerate("fb")])
        u = np.stack([self.w["uf"], self.w["ub"]])
        g, a, c, hs = (np.zeros(z, half.dtype) for z in ((t, 2, n, 4 * h), (t, 2, n, 4 * h), (t + 1, 2, n, h), (t + 1, 2, n, h)))
        for i in range(t):
            g[i] = (inputs[:, i] + hs[i] @ u) * half
            a[i] = _act(g[i])
            a[i, ..., : 3 * h] = 0.5 + 0.5 * a[i, ..., : 3 * h]
            c[i + 1] = a[i, ..., h : 2 * h] * c[i] + a[i, ..., :h] * a[i, ..., 3 * h :]
            hs[i + 1] = a[i, ..., 2 * h : 3 * h] * _act(c[i + 1])
        return hs[1:].transpose(1, 0, 2, 3), {"g": g, "a": a, "c": c, "h": hs, "xs": xs, "u": u, "half": half}

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (T, K, N) of classes x (N, T): from ``states``, in single precision and without keeping them."""
        (n, t), h = x.shape, HIDDEN
        half = np.repeat([0.5, 1.0], [3 * h, h])[:, None]
        wx = [np.ascontiguousarray(self.w[f"x{d}"].T * half, np.float32) for d in "fb"]
        u = np.stack([self.w[f"u{d}"].T * half for d in "fb"]).astype(np.float32)
        out = np.stack([self.w["out"][:h].T, self.w["out"][h:].T]).astype(np.float32)
        xs, cs, hs = np.ascontiguousarray(x.T, np.intp), np.zeros((2, h, n), np.float32), np.zeros((2, h, n), np.float32)
        g, q, got, tc, said = (np.empty(z, np.float32) for z in ((2, 4 * h, n), (2, 4 * h, n), (4 * h, n), (2, h, n), (2, len(TAGS), n)))
        e = np.empty((t, len(TAGS), n), np.float32)
        e[:] = self.w["bias"][:, None]
        for i in range(t):
            np.matmul(u, hs, out=g)
            g[0] += np.take(wx[0], xs[i], axis=1, out=got, mode="clip")
            g[1] += np.take(wx[1], xs[t - 1 - i], axis=1, out=got, mode="clip")
            _act_into(g, q)
            gates = g[:, : 3 * h]
            gates *= 0.5
            gates += 0.5
            cs *= g[:, h : 2 * h]
            np.multiply(g[:, :h], g[:, 3 * h :], out=tc)
            cs += tc
            np.copyto(tc, cs)
            _act_into(tc, q[:, :h])
            np.multiply(tc, g[:, 2 * h : 3 * h], out=hs)
            np.matmul(out, hs, out=said)
            e[i] += said[0]
            e[t - 1 - i] += said[1]
        return e

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y under the CRF, and its gradients."""
        (n, t), h = x.shape, HIDDEN
        hs, memo = self.states(x)
        both = np.concatenate([hs[0], hs[1][::-1]], -1).transpose(1, 0, 2)
        e = both @ self.w["out"] + self.w["bias"]
        tr, first, k = self.w["trans"], self.w["first"], len(TAGS)
        alpha = np.empty((n, t, k), e.dtype)
        alpha[:, 0] = first + e[:, 0]
        for i in range(1, t):
            alpha[:, i] = _lse(alpha[:, i - 1, :, None] + tr, 1) + e[:, i]
        z = _lse(alpha[:, -1], 1)
        beta = np.zeros((n, t, k), e.dtype)
        for i in range(t - 2, -1, -1):
            beta[:, i] = _lse(tr + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        p = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + tr + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        rows = np.arange(n)
        gold = first[y[:, 0]] + e[rows[:, None], np.arange(t), y].sum(1) + tr[y[:, :-1], y[:, 1:]].sum(1)
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
        de = p.copy()
        de[rows[:, None], np.arange(t), y] -= 1.0
        out = {"trans": pair / n, "first": de[:, 0].sum(0) / n, "out": np.tensordot(both, de, ((0, 1), (0, 1))) / n, "bias": de.sum((0, 1)) / n}
        back = (de @ self.w["out"].T / n).transpose(1, 0, 2)
        back = np.stack([back[:, :, :h], back[::-1, :, h:]])
        a, c, ut = memo["a"], memo["c"], memo["u"].transpose(0, 2, 1)
        dg, dh, dc = np.empty_like(a), np.zeros_like(c[0]), np.zeros_like(c[0])
        slope, slope_c, act_c = _slope(memo["g"]) * memo["half"] ** 2, _slope(c[1:]), _act(c[1:])
        for i in range(t - 1, -1, -1):
            dh = dh + back[:, i]
            dc = dc + dh * a[i, ..., 2 * h : 3 * h] * slope_c[i]
            dg[i, ..., :h], dg[i, ..., h : 2 * h], dg[i, ..., 2 * h : 3 * h], dg[i, ..., 3 * h :] = dc * a[i, ..., 3 * h :], dc * c[i], dh * act_c[i], dc * a[i, ..., :h]
            dg[i] *= slope[i]
            dh, dc = dg[i] @ ut, dc * a[i, ..., h : 2 * h]
        eye = np.eye(CLASSES, dtype=dg.dtype)
        for j, d in enumerate("fb"):
            each = dg[:, j].reshape(-1, 4 * h)
            out[f"u{d}"] = memo["h"][:-1, j].reshape(-1, h).T @ each
            out[f"x{d}"] = eye[memo["xs"][j].ravel()].T @ each
        return float((z - gold).mean()), out

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Model:
        """Adam over random batches."""
        r = np.random.default_rng(seed + 1)
        m, v = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}
        for i in range(1, steps + 1):
            b = r.choice(len(x), min(BATCH, len(x)), replace=False)
            _, g = self.gradients(x[b], y[b])
            rate = 0.04 * min(1.0, i / 20) * (1 - 0.9 * i / steps)
            for k in self.w:
                gk = np.clip(g[k], -5, 5) + (1e-3 * self.w[k] if k == "trans" else 0)  # what transitions gain bounds what must be decoded
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.998 * v[k] + 0.002 * gk * gk
                self.w[k] -= np.float32(rate) * m[k] / (1 - 0.9**i) / (np.sqrt(v[k] / (1 - 0.998**i)) + 1e-8)
        return self

    def moves(self) -> np.ndarray:
        """The transitions, of which those that no spans have are ruled out: to inside but from its own begin or inside, and from kind to kind."""
        own = np.eye(len(TAGS), dtype=bool)
        own[:, 0] = True
        for k in range(len(KINDS)):
            own[0, 1 + 2 * k] = own[1 + 2 * k, 2 + 2 * k] = True
            own[1 + 2 * k, 1 + 2 * k] = False
        return np.where(own, self.w["trans"], _OUTSIDE[1])

    def path(self, e: np.ndarray) -> np.ndarray:
        """The best path alone, of emissions (N, T, K)."""
        n, t, k = e.shape
        tr, rows = self.moves(), np.arange(n)
        back, score, out = np.empty((t, n, k), np.int8), self.w["first"] + e[:, 0], np.empty((n, t), np.int8)
        for i in range(1, t):
            each = score[:, :, None] + tr
            back[i] = each.argmax(1)
            score = each.max(1) + e[:, i]
        out[:, -1] = score.argmax(1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[i, rows, out[:, i]]
        return out

    def sure(self, e: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The probability of each of the tags (N, T) of emissions (N, T, K) under the CRF."""
        tr, t = self.moves(), e.shape[1]
        alpha, beta = np.empty(e.shape), np.zeros(e.shape)
        alpha[:, 0] = self.w["first"] + e[:, 0]
        for i in range(1, t):
            alpha[:, i] = _lse(alpha[:, i - 1, :, None] + tr, 1) + e[:, i]
        for i in range(t - 2, -1, -1):
            beta[:, i] = _lse(tr + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        return np.exp(np.take_along_axis(alpha + beta, tags[:, :, None], 2)[:, :, 0] - z[:, None])


def _act(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _act_into(x: np.ndarray, q: np.ndarray) -> None:
    """``_act`` of x in its place; q is for use within."""
    np.abs(x, out=q)
    q += 1
    x /= q


def _slope(x: np.ndarray) -> np.ndarray:
    return 1 / np.square(1 + np.abs(x))


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of a text from (start, kind, end); of overlapping spans the first counts."""
    y, free = np.zeros(length, np.int64), 0
    for s, k, e in spans:
        if s >= free:
            y[s:e] = 2 + 2 * k
            y[s] = 1 + 2 * k
            free = e
    return y


def _variant(r: np.random.Generator) -> tuple[int, str]:
    """A kind and a piece of personal data of it."""
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    name = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    kind = int(r.integers(0, 4))
    if kind == 0:
        return 0, f"{name(r.integers(2, 9))}{r.choice(['.', '_', ''])}{digits(r.integers(0, 3))}{name(2)}@{name(r.integers(2, 9))}{r.choice(['', digits(1)])}.{r.choice(['example.com', 'com', 'org', 'de', 'co.uk', 'net'])}"
    if kind == 1:
        return 1, ".".join(map(str, r.integers(0, 256, 4)))
    if kind == 2:
        body = f"{r.integers(3, 7)}{digits(int(r.choice([14, 14, 14, 13])))}"
        number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = str(r.choice(["", "", " ", "-"]))
        return 2, sep.join(number[i : i + 4] for i in range(0, len(number), 4))
    a, b, c = digits(3), digits(3), digits(4)
    return 3, f"+{r.integers(1, 99)} {r.choice([f'({a}) {b}-{c}', f'{a} {b} {c}', f'{a}-{b}-{c}', f'{a}{b}{c}', f'{a}.{b}.{c}'])}"


NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _written(r: np.random.Generator) -> tuple[int, str]:
    """A kind and a piece of personal data of it that no pattern finds: written out, obfuscated or local."""
    name = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    pick = lambda *x: x[int(r.integers(0, len(x)))]
    kind = int(r.integers(0, 4))
    if kind == 0:
        at, dot = pick((" at ", " dot "), ("(at)", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", "."), (" @ ", "."), ("@", " dot "))
        first = pick(name(r.integers(2, 9)), name(r.integers(2, 6)) + dot + name(r.integers(2, 7)))
        out = first + at + pick(name(r.integers(2, 9)), "example", "mail") + dot + pick("com", "org", "de", "net", "info")
    elif kind == 1:
        out = pick(" dot ", "[.]", " (dot) ", "[dot]", " . ").join(map(str, r.integers(0, 256, 4)))
    else:
        plain = next(v for k, v in iter(lambda: _variant(r), None) if k == kind)
        digits, form = re.sub("[^0-9]", "", plain), int(r.integers(0, 3))
        if form:
            out = ("plus " if kind == 3 else "") + " ".join(NUMBERS[int(c)] for c in digits)
        elif kind == 2:
            out = pick("  ", " - ", ".", "/", ", ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            d = "0" + digits[:10].ljust(9, "7")
            out = pick(f"({d[:3]}) {d[3:6]}-{d[6:]}", f"({d[:4]}) {d[4:]}", f"{d[:4]}/{d[4:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}")
    return kind, out.upper() if r.random() < 0.1 else out


def _alike(r: np.random.Generator) -> str:
    """What looks like personal data and is none."""
    n = lambda a, b: int(r.integers(a, b))
    words = " ".join(NUMBERS[n(0, 10)] for _ in range(n(1, 6)))
    return [f"{n(1900, 2030)}-{n(10, 13)}-{n(10, 29)} {n(10, 24)}:{n(10, 60)}", f"version {n(0, 20)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 999)},{n(100, 999)}.00", words, f"at {n(1, 12)} dot {n(1, 60)}", "look at the dot", f"item {n(1000, 99999)}", f"{n(1, 99)} at {n(1, 99)}", f"no {n(1, 999)}-{n(100, 9999)}", f"at {words} of", f"({n(1, 100)}) {n(1, 100)}", f"{n(0, 10**6)}/{n(0, 10**4)}"][n(0, 12)]


_DOT, _AT = r"\s*[(\[]\s*(?:dot|\.)\s*[)\]]\s*|\s+dot\s+|\s+\.\s+", r"\s*[(\[]\s*(?:at|@)\s*[)\]]\s*|\s+at\s+|\s*@\s*"


def spelled(kind: str, s: str) -> bool:
    """Whether s, with dots, signs and numbers that are written out read as such, is personal data of the kind."""
    s = s.lower()
    if kind in ("email", "ip"):
        plain = re.sub(_AT, "@", re.sub(_DOT, ".", s))
        return PATTERNS[kind].fullmatch(plain) is not None and _valid(kind, plain)
    digits = re.sub("|".join(NUMBERS), lambda m: str(NUMBERS.index(m.group())), s)
    digits = re.sub(r"plus|[\s()+.,/-]", "", digits)
    return digits.isascii() and digits.isdigit() and _valid(kind, digits)


def examples(texts: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows (classes, tags) around base spans, around other digits, around variants, plain and written out, set into the texts, and elsewhere."""
    r, xs, ys = np.random.default_rng(seed), [], []

    def add(text: str, spans: list[tuple[int, int, int]], at: int) -> None:
        lo = max(0, at - int(r.integers(0, LEARN)))
        x, y = _classes(text[lo : lo + LEARN]), tags_of(len(text), spans)[lo : lo + LEARN]
        xs.append(np.pad(x, (0, LEARN - len(x)), constant_values=14))
        ys.append(np.pad(y, (0, LEARN - len(y))))

    for t in texts or [""]:
        spans = base_spans(t)
        for s, _, e in spans[:4]:
            add(t, spans, (s + e) // 2)
        for m in list(_DIGIT.finditer(t))[:: max(1, len(t) // 400)][:3]:
            add(t, spans, m.start())
        gaps = [m.start() for m in re.finditer(" ", t)] or [0, len(t)]
        for k, v in (_variant(r), _variant(r), *(_written(r) for _ in range(10)), *((-1, _alike(r)) for _ in range(6))):
            i = gaps[int(r.integers(0, len(gaps)))]
            if any(s < i < e for s, _, e in spans):
                continue
            put = t[:i] + " " + v + t[i:]
            moved = [(s + (s >= i) * (len(v) + 1), q, e + (s >= i) * (len(v) + 1)) for s, q, e in spans]
            add(put, sorted([(i + 1, k, i + 1 + len(v))] * (k >= 0) + moved), i + 1 + int(r.integers(0, len(v))))
        for i in r.integers(0, len(t) + 1, 16):
            add(t, spans, int(i))
    return np.stack(xs), np.stack(ys)


_OVER = WINDOW - STRIDE
_NEAR = (np.arange(1, _OVER + 1, dtype=np.float32) / (_OVER + 1))[:, None, None]  # a window's weight where it begins; the one before has the rest


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows (a row each) of all texts, text after text, each followed by at least one place that is outside, and which rows begin a text."""
    parts = [np.pad(_classes(t), (0, STRIDE - len(t) % STRIDE), constant_values=14) for t in texts]
    rows = np.cumsum([0, *(len(p) // STRIDE for p in parts)])
    x = np.full((rows[-1], WINDOW), 14, np.uint8)
    x[:, :STRIDE] = np.concatenate(parts).reshape(-1, STRIDE)
    x[:-1, STRIDE:] = x[1:, :_OVER]
    x[rows[1:] - 1, STRIDE:] = 14
    head = np.zeros(len(x), bool)
    head[rows[:-1]] = True
    return x, head


def _scores(model: Model, x: np.ndarray, head: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Scores (STRIDE, K, len(some)) of the places that the windows ``some`` (ascending) begin with, reconciled with the windows before them."""
    after = some[~head[some]]
    used = np.union1d(some, after - 1)
    e = model.emissions(x[used])
    at = np.searchsorted(used, some)
    out = e[:STRIDE] if len(at) == len(used) else e[:STRIDE, :, at]
    joined = np.flatnonzero(~head[some])
    out[:_OVER, :, joined] = out[:_OVER, :, joined] * _NEAR + e[STRIDE:, :, np.searchsorted(used, after - 1)] * (1 - _NEAR)
    return out


def _gain(trans: np.ndarray, kind: int) -> tuple[float, float]:
    """(each, once): a run of n tags of a kind between two outside places gains at most n * each + once by its transitions over staying outside."""
    t, b, i = trans.astype(float) - float(trans[0, 0]), 1 + 2 * kind, 2 + 2 * kind
    each = float(t[i, i])  # n - 2 times in a run of 2 or more, which is begin, inside, inside, ...
    return each, float(t[0, b] + max(t[b, 0] - each, t[b, i] + t[i, 0] - 2 * each))


def _open(lead: np.ndarray, gain: tuple[float, float], block: int = 1 << 16) -> np.ndarray:
    """Where a best path can have tags of a kind, over which "outside" is ahead by ``lead``: the places of runs whose transitions
    can gain (``_gain``) what the run loses by the lead. No other place is on a best path with these tags."""
    parts = [slice(i, i + block) for i in range(0, len(lead), block)]
    run = lambda p: np.cumsum(gain[0] + 1e-3 - lead[p].astype(float))
    ends = [(t[-1], t.max(), min(0.0, t.min())) for t in map(run, parts)]
    base = np.cumsum([0.0, *(e[0] for e in ends)])
    most = np.maximum.accumulate([*(b + e[1] for b, e in zip(base, ends, strict=False)), -np.inf][::-1])[::-1]
    least = np.minimum.accumulate([0.0, *(b + e[2] for b, e in zip(base, ends, strict=False))])
    out = np.empty(len(lead), bool)
    for k, p in enumerate(parts):
        t = base[k] + run(p)
        after = np.maximum(np.maximum.accumulate(t[::-1])[::-1], most[k + 1])
        out[p] = after - np.minimum(np.minimum.accumulate(np.append(base[k], t[:-1])), least[k]) >= -gain[1] - 1e-3
    return out


def _stretches(keep: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, and the places whose spans count: from, to) of the runs of places, long ones in overlapping parts."""
    for run in np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1) if len(keep) else ():
        lo, hi = int(run[0]), int(run[-1]) + 1
        for a in range(lo, hi, PIECE - MARGIN):
            yield max(lo, a - MARGIN), min(hi, a + PIECE), a, min(hi, a + PIECE - MARGIN)


def model_spans(model: Model, texts: list[str], step: int = 512) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the model finds in each text, by start. Windows are run ``step`` at a time: arrays stay small, and
    where numpy may use several threads, its products stay too small to be dealt to them.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    x, head = _windows(texts)
    begin = np.append(np.flatnonzero(head), len(head)) * STRIDE
    lead = np.empty((len(KINDS), len(x), STRIDE), np.float32)
    for lo in range(0, len(x), step):
        s = _scores(model, x, head, np.arange(lo, min(lo + step, len(x))))
        for k in range(len(KINDS)):
            lead[k, lo : lo + step] = (s[:, 0] - np.maximum(s[:, 1 + 2 * k], s[:, 2 + 2 * k])).T
    lead[:, x[:, :STRIDE] == 14] = -_OUTSIDE[1]
    keep = np.flatnonzero(np.logical_or.reduce([_open(lead[k].ravel(), _gain(model.w["trans"], k)) for k in range(len(KINDS))]))
    held, size, found = [], 0, []
    for stretch in (*_stretches(keep), None):
        if stretch is None or size > step:
            found += _decoded(model, x, head, held)
            held, size = [], 0
        if stretch is not None:
            held.append(stretch)
            size += 2 + (stretch[1] - stretch[0]) // STRIDE
    for (at, k, end, _, _, _), p in zip(found, _probabilities(model, found), strict=True):
        if p >= SURE:
            n = int(np.searchsorted(begin, at, "right")) - 1
            out[n].append((at - int(begin[n]), k, end - int(begin[n])))
    return [sorted(o) for o in out]


class _Rows:
    """Pieces of scores in rows of about one length, each piece between outside places, which part their paths."""

    def __init__(self) -> None:
        self.rows: dict[int, list[np.ndarray]] = {}
        self.free: dict[int, int] = {}

    def put(self, score: np.ndarray) -> tuple[int, int, int]:
        """Length of the row, its number among those, and where in it the piece begins."""
        n = len(score)
        size = ROW if n + 2 <= ROW else 2 ** int(n + 1).bit_length()
        if size not in self.rows or self.free[size] + n + 1 > size:
            self.rows.setdefault(size, []).append(np.tile(_OUTSIDE, (size, 1)))
            self.free[size] = 1
        at = self.free[size]
        self.rows[size][-1][at : at + n] = score
        self.free[size] = at + n + 1
        return size, len(self.rows[size]) - 1, at

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Length, number of the first row, and rows (N, T, K), a bounded number at a time."""
        for size, group in self.rows.items():
            many = max(1, (1 << 18) // size)
            for first in range(0, len(group), many):
                yield size, first, np.stack(group[first : first + many])


def _probabilities(model: Model, found: list[tuple]) -> list[float]:
    """The mean tag probability of each span, from its characters and ``NEAR`` ones to both sides."""
    rows, tags = _Rows(), {}
    at = [rows.put(near) for *_, near in found]
    for (_, _, _, lead, path, _), (size, row, i) in zip(found, at, strict=True):
        tags.setdefault((size, row), np.zeros(size, np.int64))[i + lead : i + lead + len(path)] = path
    sure = {}
    for size, first, every in rows.parts():
        for j, p in enumerate(model.sure(every.astype(float), np.stack([tags[size, first + j] for j in range(len(every))]))):
            sure[size, first + j] = p
    return [float(sure[size, row][i + lead : i + lead + len(path)].mean()) for (_, _, _, lead, path, _), (size, row, i) in zip(found, at, strict=True)]


def _decoded(model: Model, x: np.ndarray, head: np.ndarray, stretches: list) -> list[tuple]:
    """(place, kind, end) of the spans in the stretches, by one path over each, with their tags and the scores around (and where the span begins in these)."""
    if not stretches:
        return []
    some = np.unique(np.concatenate([np.arange(a // STRIDE, (b - 1) // STRIDE + 1) for a, b, _, _ in stretches]))
    score = _scores(model, x, head, some).transpose(2, 0, 1).reshape(-1, len(TAGS))
    rows, held, out = _Rows(), {}, []
    for a, b, lo, hi in stretches:
        i = int(np.searchsorted(some, a // STRIDE)) * STRIDE + a % STRIDE  # windows of a stretch are neighbours
        size, row, at = rows.put(score[i : i + b - a])
        held.setdefault((size, row), []).append((at, a, b, lo, hi))
    for size, first, every in rows.parts():
        paths = model.path(every)
        for j in np.flatnonzero(paths.any(1)):
            for at, a, b, lo, hi in held[size, first + j]:
                path = paths[j, at : at + b - a]
                for s, k, t in _path_spans(path):
                    if lo <= a + s < hi:
                        near = slice(max(at, at + s - NEAR), min(at + b - a, at + t + NEAR))
                        out.append((a + s, k, a + t, at + s - near.start, path[s:t].astype(np.int64), every[j, near]))
    return out


_EDGE = " \t\n\r.,;:!?"


_SAID = re.compile(rf"(?:\bplus )?\b(?:{'|'.join(NUMBERS)})(?: (?:{'|'.join(NUMBERS)}))*\b", re.I)


def _snapped(t: str, s: int, k: int, e: int, most: int = 64) -> tuple[int, int, int]:
    """A span with the rest of the words that it begins and ends in, without white space and stops at its edges; of numbers in words, the whole run."""
    lo = max(0, s - most)
    if k >= 2 and (said := [m for m in _SAID.finditer(t, lo, e + most) if m.start() < e and s < m.end()]):
        m = max(said, key=lambda m: m.end() - m.start())
        return m.start(), k, m.end()
    while s > lo and t[s].isalnum() and t[s - 1] in _LOCAL_CHARS:
        s -= 1
    hi = min(len(t), e + most)
    while e < hi and t[e - 1].isalnum() and t[e].isalnum():
        e += 1
    w = t[s:e]
    return s + len(w) - len(w.lstrip(_EDGE)), k, e - len(w) + len(w.rstrip(_EDGE))


def added(t: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of the model that count: those that are what they are marked as, and numbers marked as a card that are a
    phone's: of 9 to 15 digits, of which the first is 0 or after a plus sign."""
    out = []
    for x in found:
        s, k, e = _snapped(t, *x)
        if s < e and k == 2 and not spelled("card", t[s:e]) and re.match(r"\(?0|\+|(?:plus|zero) ", t[s:e].lower()):
            k = 3
        if s < e and spelled(KINDS[k], t[s:e]) and not any(s < b and a < e for a, _, b in out):
            out.append((s, k, e))
    return out


def _path_spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each begin tag with the inside tags of its kind after it."""
    out = []
    for s in np.flatnonzero(path % 2 == 1):
        t, inside = int(s) + 1, int(path[s]) + 1
        while t < len(path) and path[t] == inside:
            t += 1
        out.append((int(s), (inside - 2) // 2, t))
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the ``sample_rows`` rows with a digit or "@", for their base spans, that come first by a hash of their text."""
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text")).filter(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    n = rows.count()
    if n > 2 * sample_rows:  # of many rows, first those whose hash is low enough for about twice as many as are needed
        rows = rows.filter(F.pmod("h", F.lit(1 << 40)) < int(2 * sample_rows / n * (1 << 40)))
    rows = rows.orderBy(F.pmod("h", F.lit(1 << 40)), "text").limit(sample_rows).collect()
    return Model().fit(*examples([r["text"] for r in rows]))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def row(base: list, more: list) -> tuple:
        said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
        extra = [(s, len(KINDS) + k, f"model_{KINDS[k]}:{s}:{e}") for s, k, e in more if not any(s < e2 and s2 < e for s2, _, e2 in base)]
        every = sorted([(s, k, x) for (s, k, _), x in zip(base, said, strict=True)] + extra)
        return (*(sum(k == i for _, k, _ in base) for i in range(len(KINDS))), hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(x for _, _, x in every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 1):
                texts = part.column(1).to_pylist()
                rows = [row(base_spans(t), added(t, more)) for t, more in zip(texts, model_spans(model, texts), strict=True)]
                types = [pa.int64()] * len(KINDS) + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, f"doc_id {id_type}, {kinds}, base_sha256 string, spans string")


def detect(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on a sample of docs and find personal data in all of its rows."""
    return find(docs, train(docs, sample_rows))
