"""The detectors for one text at a time, for table functions of SQL. Tables are scanned faster by operators.mask.claims(), with the same result."""

from __future__ import annotations

import bisect
import functools

import regex

from .. import lexicons as L

#: What the other engine's patterns mean by a word, white space and a word's edge in Unicode, and without it.
_WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200C\u200D]"
_SPACE, _ASCII_SPACE = r"\p{White_Space}", r" \t\n\x0b\f\r"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: What separates nothing when an entity is looked for.
_BLANK = regex.compile(rf"[{_SPACE}\x1c-\x1f]")


def translated(pattern: str) -> str:
    """A pattern of lexicons.py, which are written for the tasks' own engine, for this one."""
    wide, pattern = pattern.startswith("(?U)"), pattern.removeprefix("(?U)")
    pattern = pattern.removeprefix("(?iu)")
    out, inside, i = "", False, 0
    while i < len(pattern):
        if pattern.startswith(r"(?U:\b)", i):
            out, i = out + _EDGE, i + 7
        elif pattern[i] == "\\" and pattern[i + 1] in "dswb":
            c = pattern[i + 1]
            plain = {"d": r"\p{Nd}" if wide else "0-9", "s": _SPACE if wide else _ASCII_SPACE, "w": _WORD[1:-1], "b": _EDGE}[c]
            out, i = out + (plain if inside or c == "b" else f"[{plain}]"), i + 2
        elif pattern[i] == "\\":
            out, i = out + pattern[i : i + 2], i + 2
        else:
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out, i = out + pattern[i], i + 1
    return out


@functools.cache
def _detectors() -> list[tuple[str, regex.Pattern]]:
    patterns = {"Email": L.EMAIL, "Phone": L.PHONE, "UEN": L.UEN, "ABN": L.ABN, "Address": L.ADDRESS}
    return [(c, regex.compile(translated(p), regex.V0 | (regex.IGNORECASE if p.startswith("(?iu)") else 0))) for c, p in patterns.items()]


_YEARS = regex.compile(rf"([0-9]{{4}})[ .{L.DASHES}]([0-9]{{4}})")


def is_phone(text: str) -> bool:
    """Seven digits or more, and no two years in a row."""
    years = _YEARS.fullmatch(text)
    if years and all(1900 <= int(y) <= 2099 for y in years.groups()) and 0 <= int(years[2]) - int(years[1]) <= 1:
        return False
    return len(regex.findall(r"\p{Nd}", text)) >= 7


class Scanner:
    """Finds claims in texts. entities: (value, category) pairs."""

    def __init__(self, entities: tuple[tuple[str, str], ...] = ()):
        edge = "[A-Za-z0-9_]"
        self.entities = []
        for value, category in sorted(entities, key=lambda e: -len(e[0])):
            words = [regex.escape(w) for w in _BLANK.sub(" ", value).split(" ") if w]
            pattern = regex.compile(rf"(?<!{edge}){rf'[{_SPACE}\x1c-\x1f]*'.join(words)}(?!{edge})", regex.V0 | regex.IGNORECASE)
            self.entities.append((_BLANK.sub("", value).lower(), pattern, category))

    def claims(self, text: str) -> list[tuple[int, int, int, str, str, str]]:
        """tier, start, end, text, category, source, in the order of the claims: what overlaps an earlier claim is none."""
        taken: list[tuple[int, int]] = []
        out = []

        def claim(m, tier: int, category: str, source: str) -> None:
            start, end = m.span()
            i = bisect.bisect_left(taken, (start, end))
            if (i == len(taken) or taken[i][0] >= end) and (i == 0 or taken[i - 1][1] <= start):
                taken.insert(i, (start, end))
                out.append((tier, start, end, m[0], category, source))

        low = _BLANK.sub("", text).lower()
        for squashed, pattern, category in self.entities:
            if squashed in low:
                for m in pattern.finditer(text):
                    claim(m, 0, category, "list")
        for tier, (category, pattern) in enumerate(_detectors(), 1):
            for m in pattern.finditer(text) if category != "Email" or "@" in text else ():
                if category != "Phone" or is_phone(m[0]):
                    claim(m, tier, category, "regex")
        return out


@functools.lru_cache(16)
def scanner(entities: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(entities)
