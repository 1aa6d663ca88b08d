"""Personal data with offset-preserving deobfuscation.

Small transducers rewrite a text to a normal form (full-width and look-alike
characters, digits spelled in four languages, ``at`` and ``dot`` disguises, each
by itself) and keep, for every character of the normal form, the source span it
came from and whether it was rewritten.  Detectors run on the source (base
spans) and on the normal form; a span of the normal form with a rewritten
character is mapped back and added.  It replaces nothing, and may cover a base
span: ``john@mail.example [dot] com`` has both the base span up to ``example``
and the whole one.

Null and empty texts have no spans.  Repeated rows get equal results; extra
columns pass through.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base detectors.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The look-behind only skips starts inside a digit run, which match no more than its first digit does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅαορν", "aeopcyxijshdqwABEKMHOPCTXYIJSaopv"))
# The digits 0 to 9 spelled in English, German, French and Spanish, with spellings that avoid accents.
DIGITS = {w: str(d) for d, words in enumerate((
    "zero null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"))
    for w in words.split()}
_digit = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<![^\W\d_])(?:{_digit})(?![^\W\d_])", re.I)
# Words for @ and for the dot.
_at, _dot = "at|arroba|arobase", "dot|punkt|punto|point"
DISGUISE = re.compile(rf"\s?[(\[{{<]\s?(?:({_at}|@)|({_dot}|\.))\s?[)\]}}>]\s?", re.I)
_label = "[A-Za-z0-9-]{1,63}"
#: Between name and host, where labels and dots, in signs or words, complete an address that ends in letters.
NAMED_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s(?:{_at}|@)\s|\s@|@\s|@)(?={_label}(?:(?:\.|\s(?:{_dot})\s){_label}){{0,5}}"
                      rf"(?:\.|\s(?:{_dot})\s)[A-Za-z]{{2,24}}(?![A-Za-z0-9]))", re.I)
NAMED_DOT = re.compile(rf"\s(?:{_dot})\s(?={_label})", re.I)
LABEL = re.compile(_label)
#: Between the numbers of an address.
NUMBER_DOT = re.compile(rf"(?<=[0-9])\s(?:{_dot})\s(?=[0-9])", re.I)


def emails(s: str):
    """Matches of ``[local]+`` + DOMAIN, found from each @ so that long runs
    without one cost nothing."""
    end, at = 0, s.find("@")
    while at >= 0:
        a = at
        while a > end and s[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(s, at) if a < at else None
        if m:
            yield a, m.end()
            end = m.end()
        at = s.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(s: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base detectors, by kind and start."""
    out = [(0, a, b) for a, b in emails(s)]
    out += [(1, *m.span()) for m in IP.finditer(s) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255
                                                         for p in m.group().split("."))]
    for m in CARD.finditer(s):
        d = re.sub(r"[\x20-]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(s):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


class Mapped:
    """A text with the source span of each character, and the number of
    rewritten ones before it."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)
        self.new = bytes(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by a string for each of the sorted edits; the
        character before an emptied place counts as rewritten."""
        if not edits:
            return
        text, start, end, mark, pos = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text += [self.text[pos:a], new]
            start += [*self.start[pos:a], *[self.start[a]] * len(new)]
            end += [*self.end[pos:a], *[self.end[b - 1]] * len(new)]
            mark += self.new[pos:a] + b"\x01" * len(new)
            if not new and mark:
                mark[-1] = 1
            pos = b
        text.append(self.text[pos:])
        self.text, self.start, self.end = "".join(text), [*start, *self.start[pos:]], [*end, *self.end[pos:]]
        self.new = bytes(mark + self.new[pos:])


def _letters(s: str):
    if s.isascii():
        return []
    out = []
    for i, c in enumerate(s):
        if c > "\x7f":
            new = LOOKALIKES.get(c)
            if new is None:
                new = unicodedata.normalize("NFKC", c)
                new = "" if unicodedata.category(c) == "Cf" else new if new != c and new.isascii() else None
            if new is not None:
                out.append((i, i + 1, new))
    return out


def _spelled(s: str):
    """Runs of spelled digits; one that stands alone counts beside a digit."""
    runs = []
    for m in SPELLED.finditer(s):
        if runs and s[runs[-1][1]:m.start()] in ("", " ", "-"):
            runs[-1] = runs[-1][0], m.end(), runs[-1][2] + DIGITS[m.group().lower()]
        else:
            runs.append((m.start(), m.end(), DIGITS[m.group().lower()]))

    def beside(a: int, b: int) -> bool:
        before, after = s[max(a - 2, 0):a], s[b:b + 2]
        near = lambda x, y: "0" <= x <= "9" or (x in " -" and "0" <= y <= "9")
        return near(before[-1:] or "x", before[:1] or "x") or near(after[:1] or "x", after[-1:] or "x")

    return [(a, b, d) for a, b, d in runs if len(d) > 1 or beside(a, b)]


def _disguised(s: str):
    return [(m.start(), m.end(), "@" if m.group(1) else ".") for m in DISGUISE.finditer(s)]


def _bare(s: str):
    """Signs and words between the parts of an address."""
    out = []
    for m in NAMED_AT.finditer(s):
        if out and m.start() < out[-1][1]:
            continue
        if m.group() != "@":
            out.append((m.start(), m.end(), "@"))
        host = LABEL.match(s, m.end())
        while host:
            d = NAMED_DOT.match(s, host.end())
            if d:
                out.append((d.start(), d.end(), "."))
            at = d.end() if d else host.end() + 1 if s[host.end():host.end() + 1] == "." else None
            host = LABEL.match(s, at) if at is not None else None
    taken = {a for a, _, _ in out}
    out += [(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(s) if m.start() not in taken]
    return sorted(out)


def find(text: str | None) -> tuple[list, list]:
    """(base spans, all spans), each by kind and start."""
    s = text or ""
    base = detect(s)
    m = Mapped(s)
    for step in (_letters, _spelled, _disguised, _bare):
        m.rewrite(step(m.text))
    if m.text == s:
        return base, base
    known, extra = set(base), set()
    for k, a, b in detect(m.text):
        if 1 in m.new[a:b]:
            extra.add((k, m.start[a], m.end[b - 1]))
    return base, sorted(known | extra)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def personal_data(text: Column) -> Column:
    """Struct (base, spans) of kind, start and end in code points."""
    @F.pandas_udf(f"base {SPANS}, spans {SPANS}")
    def udf(texts: pd.Series) -> pd.DataFrame:
        rows = [tuple([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in part] for part in find(t)) for t in texts]
        return pd.DataFrame(rows, columns=["base", "spans"])
    return udf(text)
