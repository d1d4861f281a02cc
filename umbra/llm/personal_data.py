"""Personal data in texts: four kinds by fixed rules, and what a linear-chain conditional random field (CRF) finds besides.

The CRF labels tokens (runs of digits, runs of letters, other characters) by their shapes: it is there for what the rules can't see, as
numbers written without a country code, or addresses with the sign spelled out. It is trained on the driver from LABELLED, a small table
of marked lines, the same weights for all tasks; it is decoded by Viterbi in numpy, many sequences at a time. What it labels counts
only if it holds up as its kind (digits, Luhn's sum, parts of an address) and overlaps nothing that the rules have found.

A token can only be labelled within REACH characters of a sign that any personal data has (a digit, an @, a spelled-out dot or an at in brackets), so
sequences are the stretches around such signs; the whole of every text is searched for them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters of a sequence on either side of a sign.
REACH = 48
#: Characters of a sequence that are decoded at once, and those on either side that are decoded along with them and then left.
LONG, CONTEXT = 1 << 14, 1 << 10
#: Tokens that a task gathers before it decodes them.
GATHERED = 1 << 16
LABELS = 1 + 2 * len(KINDS)
N_FEATURES = 1 << 14

# The patterns of the contract. Where a run can't begin inside another, that is said, so that no run is gone through twice.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: The labelled table: marked lines, in which each 9 stands for any digit and each w for any word. {kind|text} is personal data.
#: A card number is made to pass Luhn's sum where it is marked, and to fail it where it is not.
LABELLED = """w call {phone|(999) 555-9999} w
w w {phone|(999) 999-9999} w w
tel {phone|999-555-9999}, w
phone: {phone|999.999.9999} w
w w w {phone|999-999-9999} w.
fax {phone|999 999 9999} w w
mobile {phone|1 (999) 999-9999} w
w {phone|1-999-999-9999} w w
w {phone|+1 (999) 555-9999} w
w w {phone|+99 99 9999 9999}, w
call us at {phone|(999)999-9999}
w tel: {phone|099 9999 9999}
whatsapp {phone|0099 99 9999 9999} w
w {email|w.99@w9.example.com} w
w w {email|w@w.org}, w
mail {email|w.w (at) w.com} w
write to {email|w at w dot com} w
w {email|w [at] w [dot] org} w w
w {email|w dot w at w dot net}, w
contact {email|w.99 (at) mail9.example.com} w
w w {email|w(at)w(dot)com} w
e-mail: {email|w_w [at] w.com} or w
w <{email|w99 at w dot co dot uk}> w
w {email|w AT w DOT com} w
w w {ip|99.999.99.99} w
host {ip|999.99.9.9}, w
w {ip|99[.]99[.]999[.]9} w
w server {ip|99 . 99 . 99 . 99} w
ip {ip|9 dot 99 dot 99 dot 9} w
w {ip|99(.)99(.)99(.)99} w w
w {card|9999 9999 9999 9999} w
w w {card|9999999999999999} w
card {card|9999.9999.9999.9999}, w
paid with {card|9999 - 9999 - 9999 - 9999} w
w {card|9999/9999/9999/9999} w
visa {card|9999  9999  9999  9999} w w
w {card|9999_9999_9999_9999} w
amex {card|9999.999999.99999} w
w w 9999999999999999 w w
w 9999999999999999 9999999999999999 w
w 9999.9999.9999.9999 w
w 9999 9999 9999 9999 w w
w w 4.0. w w
version 9.9.9 w w
w w 9.9. w
w {ip|9.9.9.9} w
section 99.9 and 99.9.9 w
w 9999-99-99 w
on 99/99/9999 at 99:99 w
w 99:99:99 w at w
w w $9,999.99 w
w 99 w, 999 w and 9999 w
page 99 of 999
w w 99% w 9.9% w
isbn 999-9-99-999999-9 w
w 9 999 999 999 w
w 9,999,999,999 w
w 999 999 999 w 999 999 999
w 99 99 99 99 99 99 99 99
999 9999 999 9999 999 9999 999 9999
9.99 99.99 999.99 9.99 99.99 9.99
w token = "w99w9999w9w99999w9" w
w w at w w w at the w
w looked at w dot w
the dot at w w at 9 w
w dot w dot w dot w
w at w. W dot w w
w @ w w
w @w w #w99 w
w 99w w99 w9w9 w
w 1999-2026 w w
w score 99-99 w 9-9
no. 999 999 w
w (999) w w
w [9] w [99] w (9999) w
w+9 w 9+9=99 w
w w### w%%% 99### w$$$
| w | w | 99 | w | 999 |
x = 9 * 99 - 9.9 / 9
w 999-9999 w
id 999999-99999999 w
w 9999999999 w w
w 99999999 w 999999 w
order 999-9999999-9999999 w
w 999.999.999.999.999.999 w
w 999.999.999.999 w""".splitlines()

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\W\d_]+|\S")
_SIGN = re.compile(r"[0-9]+|@|(?<![A-Za-z])[dD][oO][tT](?![A-Za-z])|[\[(] ?[aA][tT] ?[\])]")
_WORDS = frozenset("at dot com org net example mail email e call tel phone fax mobile whatsapp card visa ip host server version section page token id order isbn no score contact write paid amex".split())


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _digits(x: str) -> str:
    return "".join(re.findall(r"[0-9]+", x))


def _is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def by_rules(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all four kinds, sorted. Each pattern is matched from left to right; a match that fails its test is not tried again."""
    out, end, last, at = [], 0, 0, text.find("@")
    while at >= 0:
        # The local part is the run before the sign; it begins behind the match and the sign before it.
        begin = max(end, last)
        run = text[begin:at]
        size = len(run) - len(run.rstrip(LOCAL))
        if size and (m := DOMAIN.match(text, at + 1)):
            out.append((at - size, 0, m.end()))
            end = m.end()
        last = at + 1
        at = text.find("@", last)
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _is_ip(m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """[from, to) of the stretches around signs. Those of more than LONG characters come in parts that touch; others never do."""
    lo = hi = None
    for m in _SIGN.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if hi is not None and a <= hi:
            hi = b
            while hi - lo > LONG:
                yield lo, lo + LONG
                lo += LONG
        else:
            if hi is not None:
                yield lo, hi
            lo, hi = a, b
    while hi is not None and hi - lo > LONG:
        yield lo, lo + LONG
        lo += LONG
    if hi is not None:
        yield lo, hi


@lru_cache(1 << 16)
def _shape(token: str) -> int:
    """A number for what a token looks like: digits by how many and up to 255 or not; letters by case and how many, some words as such."""
    c = token[0]
    if "0" <= c <= "9":
        name = f"9{min(len(token), 20)}{'b' if len(token) < 4 and int(token) < 256 else ''}"
    elif c.isascii() and c.isalpha():
        low = token.lower()
        name = low if low in _WORDS else f"{'A' if token.isupper() else 'Aa' if c.isupper() else 'a'}{min(len(token), 4)}"
    else:
        name = c if c.isascii() else "é" if c.isalpha() else "?"
    return zlib.crc32(name.encode()) & 0xFFFFF


class Tokens:
    """Tokens of a stretch: start, end, shape, the white space before each (none, a blank, more) and the run of numbers that each is part of."""

    def __init__(self, text: str, lo: int, hi: int):
        found = list(_TOKEN.finditer(text, lo, hi))
        self.start, self.end = [m.start() for m in found], [m.end() for m in found]
        self.shape = [_shape(m[0][:32]) for m in found]
        gaps = [min(2, a - b) for a, b in zip(self.start[1:], self.end, strict=False)]
        self.gap = [2, *gaps] if found else []
        self.run = [0] * len(found)
        is_number = ["0" <= text[a] <= "9" for a in self.start]
        i = 0
        while i < len(found):
            if not is_number[i]:
                i += 1
                continue
            # A run goes on over up to three signs of the kind that part a number's groups.
            j, last, digits = i, i, text[self.start[i] : self.end[i]][:24]
            while j + 1 < len(found) and self.gap[j + 1] < 2 and j - last < 4 and (is_number[j + 1] or text[self.start[j + 1]] in "-.()[]/_"):
                j += 1
                if is_number[j]:
                    last, digits = j, (digits + text[self.start[j] : self.end[j]])[:24]
            n = len(digits)
            state = 1 + min(n, 20) * 2 + (12 <= n <= 19 and luhn(digits))
            self.run[i : last + 1] = [state] * (last + 1 - i)
            i = last + 1


def features(sequences: list[Tokens]) -> tuple[np.ndarray, np.ndarray]:
    """tokens * templates numbers of features, all sequences one after the other; and the sequence of each token."""
    of = np.repeat(np.arange(len(sequences)), [len(s.shape) for s in sequences])
    shape, gap, run = (np.array([x for s in sequences for x in getattr(s, name)], np.int64) for name in ("shape", "gap", "run"))

    def at(values: np.ndarray, by: int) -> np.ndarray:
        """Values of the token `by` places on, -1 beyond the sequence."""
        out = np.full(len(values), -1, np.int64)
        if by >= 0:
            n = max(0, len(values) - by)
            out[:n] = np.where(of[by:] == of[:n], values[by:], -1)
        else:
            out[-by:] = np.where(of[-by:] == of[:by], values[:by], -1)
        return out

    s = {o: at(shape, o) for o in range(-4, 5)} if len(shape) else {o: shape for o in range(-4, 5)}
    after = at(gap, 1) if len(shape) else gap
    templates = [
        (s[0],), (s[-1],), (s[1],), (s[-2],), (s[2],), (s[-3],), (s[3],), (s[-4],), (s[4],),
        (s[-1], s[0]), (s[0], s[1]), (s[-2], s[-1], s[0]), (s[0], s[1], s[2]), (s[-1], s[0], s[1]), (s[0], gap), (s[0], gap, after, s[-1]),
        (run,), (run, s[0]), (run, s[-1], gap), (s[0], s[2], s[4]), (s[0], s[-2], s[-4]),
    ]
    out = np.empty((len(shape), len(templates)), np.int64)
    for t, values in enumerate(templates):
        h = np.full(len(shape), 7 + t, np.uint64)
        for v in values:
            h = (h ^ (v + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out[:, t] = (h % np.uint64(N_FEATURES)).astype(np.int64)
    return out, of


#: Whether a label may follow another, and begin a sequence: what goes on must have begun.
FOLLOWS = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(LABELS)] for a in range(LABELS)])
BEGINS = np.array([b == 0 or b % 2 == 1 for b in range(LABELS)])


def padded(scores: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """sequences * length * labels, 0 behind the end of each; and their lengths."""
    size = np.bincount(of, minlength=n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((n, int(size.max(initial=0)), LABELS))
    out[of, place] = scores
    return out, size


class Crf:
    """weights: features * labels; steps: labels * labels, the weight of a label behind another."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def _scores(self, feats: np.ndarray) -> np.ndarray:
        return self.weights[feats].sum(1)

    @property
    def _steps(self) -> np.ndarray:
        return np.where(FOLLOWS, self.steps, -1e9)

    def viterbi(self, sequences: list[Tokens]) -> list[np.ndarray]:
        """The likeliest labels of each sequence; sequences of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i].shape))
        while order:
            # Padding at most doubles what is decoded.
            shortest = max(8, len(sequences[order[0]].shape))
            n = next((i for i, o in enumerate(order) if len(sequences[o].shape) > 2 * shortest or i * 2 * shortest > GATHERED), len(order)) or 1
            some, order = order[:n], order[n:]
            feats, of = features([sequences[i] for i in some])
            score, size = padded(self._scores(feats), of, n)
            best, back = np.where(BEGINS, score[:, 0] if score.shape[1] else 0.0, -1e9), []
            for t in range(1, score.shape[1]):
                ways = best[:, :, None] + self._steps
                back.append(ways.argmax(1).astype(np.int8))
                new = ways.max(1) + score[:, t]
                live = (t < size)[:, None]
                best = np.where(live, new, best)
                back[-1] = np.where(live, back[-1], np.arange(LABELS, dtype=np.int8))  # behind the end nothing changes
            label = best.argmax(1)
            path = np.zeros((n, max(1, score.shape[1])), np.int8)
            path[:, -1] = label
            for t in range(score.shape[1] - 1, 0, -1):
                label = back[t - 1][np.arange(n), label]
                path[:, t - 1] = label
            for row, i in enumerate(some):
                out[i] = path[row, : size[row]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 60, rate: float = 0.2, decay: float = 2e-3) -> Crf:
    """A CRF from texts with (start, kind, end) marks, by gradient steps on the log-likelihood (forward and backward sums) with adaptive rates."""
    sequences, gold = [], []
    for text, marks in labelled:
        tokens = Tokens(text, 0, len(text))
        y = np.zeros(len(tokens.shape), int)
        for start, kind, end in marks:
            inside = [i for i, (a, b) in enumerate(zip(tokens.start, tokens.end, strict=True)) if a >= start and b <= end]
            y[inside] = 2 + 2 * kind
            y[inside[:1]] = 1 + 2 * kind
        sequences.append(tokens)
        gold.append(y)
    feats, of = features(sequences)
    flat, n = np.concatenate(gold), len(sequences)
    size = np.bincount(of, minlength=n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    used, local = np.unique(feats, return_inverse=True)
    local = local.reshape(feats.shape)
    w, steps = np.zeros((len(used), LABELS)), np.zeros((LABELS, LABELS))
    # Sums by feature: the tokens in the order of their features, cut where the next one begins.
    order, width = np.argsort(local.ravel(), kind="stable"), local.shape[1]
    cuts = np.searchsorted(local.ravel()[order], np.arange(len(used)))
    by_feature = lambda p: np.add.reduceat(p[order // width], cuts)
    truth_w, truth_s = by_feature(np.eye(LABELS)[flat]), np.zeros_like(steps)
    inside = np.flatnonzero(of[1:] == of[:-1])
    np.add.at(truth_s, (flat[inside], flat[inside + 1]), 1)
    moments = [np.full_like(w, 1e-8), np.full_like(steps, 1e-8)]
    for _ in range(rounds):
        score, _ = padded(w[local].sum(1), of, n)
        may = np.where(FOLLOWS, steps, -1e9)
        longest = score.shape[1]
        ahead, behind = np.empty_like(score), np.zeros_like(score)
        ahead[:, 0] = np.where(BEGINS, score[:, 0], -1e9)
        for t in range(1, longest):
            ahead[:, t] = np.where((t < size)[:, None], _logsum(ahead[:, t - 1, :, None] + may, 1) + score[:, t], ahead[:, t - 1])
        total = _logsum(ahead[:, -1], 1)
        pairs = np.zeros_like(steps)
        for t in range(longest - 2, -1, -1):
            live = (t + 1 < size)[:, None]
            onward = may + (score[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(live, _logsum(onward, 2), 0.0)
            p = np.exp(ahead[:, t, :, None] + onward - total[:, None, None])
            pairs += p[live[:, 0]].sum(0)
        p = np.exp(ahead + behind - total[:, None, None])[of, place]
        for x, g, m in ((w, truth_w - by_feature(p) - decay * w, moments[0]), (steps, truth_s - pairs - decay * steps, moments[1])):
            m += g * g
            x += rate * g / np.sqrt(m)
    weights = np.zeros((N_FEATURES, LABELS), np.float32)
    weights[used] = w
    return Crf(weights, np.where(FOLLOWS, steps, 0.0))


def realised(lines: list[str] = LABELLED, times: int = 8, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled table with digits and words filled in, each line several times: (text, [(start, kind, end)])."""
    r = np.random.default_rng(seed)
    letters = [list("abcdefghijklmnopqrstuvwxyz")] * 3 + [list("aeionrstéèçöüßñó")]

    def word(first: bool) -> str:
        own = letters[r.integers(4)]
        x = "".join(own[i] for i in r.integers(0, len(own), r.integers(1 + first, 10)))
        return x.title() if r.random() < 0.15 else x

    def filled(part: str, kind: str | None) -> str:
        plain = kind == "email"  # addresses have ASCII letters
        out = ""
        for token in re.findall(r"[A-Za-z]+|9+|.", part):
            if token == "w":
                x = word(plain)
                out += x if not plain else re.sub(r"[^a-z]", "e", x.lower())
            elif token[0] == "9":
                d = "".join(str(x) for x in r.integers(0, 10, len(token)))
                out += str(r.integers(0, 256)) if kind == "ip" else d
            else:
                out += token
        wanted = kind == "card"
        if 12 <= len(_digits(out)) <= 19 and kind in ("card", None) and luhn(_digits(out)) != wanted:
            at = max(i for i, c in enumerate(out) if c.isdigit())
            turned = [out[:at] + d + out[at + 1 :] for d in "0123456789"]
            out = next(x for x in turned if luhn(_digits(x)) == wanted)
        return out

    made = []
    for line in lines:
        for _ in range(times):
            text, marks = "", []
            for kind, inside, plain in re.findall(r"\{(\w+)\|(.*?)\}|([^{]+)", line):
                part = filled(inside or plain, kind or None)
                if kind:
                    marks.append((len(text), KINDS.index(kind), len(text) + len(part)))
                text += part
            made.append((text, marks))
    return made


def holds_up(text: str, start: int, kind: int, end: int) -> bool:
    """Whether what the CRF has labelled can be of its kind."""
    x, before, after = text[start:end], text[max(0, start - 2) : start], text[end : end + 2]
    if KINDS[kind] == "email":
        x = re.sub(r"\s*[\[(<{]?\s*(?<![A-Za-z])at(?![A-Za-z])\s*[\])>}]?\s*", "@", x, flags=re.IGNORECASE)
        x = re.sub(r"\s*[\[(<{]?\s*(?:(?<![A-Za-z])dot(?![A-Za-z])|(?<=[\[(])\.)\s*[\])>}]?\s*", ".", x, flags=re.IGNORECASE)
        return [(a, b) for a, k, b in by_rules(x) if k == 0] == [(0, len(x))] and bool(re.search(r"\.[A-Za-z]{2,}$", x))
    if re.search(r"[0-9A-Za-z]$|[0-9][-./]$", before) or re.search(r"^[0-9A-Za-z]|^[-./][0-9]", after):
        return False
    groups = re.findall(r"[0-9]+", x)
    if KINDS[kind] == "ip":
        return _is_ip(groups) and len(set(re.split(r"[0-9]+", re.sub(r"\s", "", x))[1:-1])) == 1
    n = sum(map(len, groups))
    if KINDS[kind] == "card":
        return 12 <= n <= 19 and luhn("".join(groups))
    return 10 <= n <= 15 and len(groups) > 1 and not re.search(r"[^0-9() .\-/+]", x)


class Finder:
    """Finds personal data in texts, one after the other; the CRF decodes the sequences of many texts at once."""

    def __init__(self, crf: Crf):
        self.crf, self.texts, self.waiting, self.held = crf, [], [], 0

    def add(self, text: str) -> None:
        base, found = by_rules(text), []
        self.texts.append((base, found))
        end = -1
        for lo, hi in stretches(text):
            # A part of a long stretch is decoded with some of what lies around it.
            a, b = (lo - CONTEXT if lo == end else lo), (min(len(text), hi + CONTEXT) if hi - lo == LONG else hi)
            end = hi
            tokens = Tokens(text, a, b)
            self.waiting.append((text, base, found, tokens, lo, hi))
            self.held += len(tokens.shape)
            if self.held > GATHERED:
                self._decode()

    def _decode(self) -> None:
        for (text, base, found, tokens, lo, hi), labels in zip(self.waiting, self.crf.viterbi([w[3] for w in self.waiting]), strict=True):
            for j in np.flatnonzero(labels % 2 == 1).tolist():
                e = j + 1
                while e < len(labels) and labels[e] == labels[j] + 1:
                    e += 1
                span = tokens.start[j], int(labels[j]) // 2, tokens.end[e - 1]
                if lo <= span[0] < hi and holds_up(text, *span) and not any(span[0] < b[2] and span[2] > b[0] for b in base):
                    found.append(span)
        self.waiting, self.held = [], 0

    def done(self) -> list[tuple[list, list]]:
        """(base, all) spans of the texts added since."""
        self._decode()
        out, self.texts = [(base, sorted(base + found)) for base, found in self.texts], []
        return out


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", labelled: list | None = None) -> DataFrame:
    """key, base and spans (arrays of kind, start, end in code points, by start and kind) for each row of docs.

    labelled: what the CRF is trained from, as realised() gives it. Null text is empty and has none. Keys stay as they are, null ones
    too; repeated rows are searched each; an empty table gives no row; other columns are not read. A text is held whole by its task, with
    the tokens around its signs.
    """
    crf = train(labelled if labelled is not None else realised())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    listed = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches):
        finder = Finder(crf)
        for b in batches:
            since = 0
            for i, t in enumerate(b.column("text")):
                finder.add(t.as_py() or "")
                if len(finder.texts) >= 1024 or i == b.num_rows - 1:
                    base, spans = zip(*finder.done(), strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("key").slice(since, i + 1 - since), pa.array(map(listed, base), span), pa.array(map(listed, spans), span)], ["key", "base", "spans"])
                    since = i + 1

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return own.mapInArrow(run, f"key {own.schema['key'].dataType.simpleString()}, base {spans}, spans {spans}").select(F.col("key").alias(key), "base", "spans")


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
