"""Personal data: identifiers in plain and in disguised spelling, with spans in the source text.

Plain identifiers are found by four scanners. For disguised ones a chain of transducers rewrites the text: look-alike letters and foreign digits to
ASCII, spelled digits to digits, bracketed or spoken at and dot to their signs. Each rewriting keeps, beside its output, where each
output character came from, so what is found in the rewritten text is mapped back to source characters. A
mapped span is added if no plain span of its kind covers it; plain spans always stay.

Defined cases: a null text counts as empty and has no spans; repeated rows have equal results; spans are in code points, end
exclusive; two spans of one kind may overlap only if one of them was disguised.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from shelfspark.llm.common import fresh

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of a local part, @ and a dotted domain. A local part cannot hold an @, so each @ is tried once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if at >= done and (domain := _DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[Span]:
    # A run of digits either starts a match or holds none, and a match ends with its last run.
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    at = text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                yield m.span()
            at = m.end() - 1
        at = text.find("+", at + 1)


SCANNERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


class Mapped:
    """A rewritten text that knows its source: runs of characters, each copied from, or standing for, a source span."""

    def __init__(self, text: str, runs: list[tuple[int, int, int, bool]] | None = None):
        self.text = text
        #: (start here, source start, source end, whether copied character by character)
        self.runs = runs if runs is not None else [(0, 0, len(text), True)]
        self.starts = [r[0] for r in self.runs]

    def rewritten(self, changes: list[tuple[int, int, str]]) -> Mapped:
        """With ordered, disjoint spans of this text replaced."""
        parts, runs, at, here = [], [], 0, 0
        for start, end, new in changes:
            if start > at:
                parts.append(self.text[at:start])
                runs.extend(self._copied(at, start, here))
                here += start - at
            if new:
                parts.append(new)
                runs.append((here, *self.source(start, end), False))
                here += len(new)
            at = end
        parts.append(self.text[at:])
        runs.extend(self._copied(at, len(self.text), here))
        return Mapped("".join(parts), runs)

    def _copied(self, start: int, end: int, here: int) -> Iterator[tuple[int, int, int, bool]]:
        k = bisect_right(self.starts, start) - 1
        while start < end:
            first, a, b, copied = self.runs[k]
            stop = min(end, self.starts[k + 1] if k + 1 < len(self.runs) else len(self.text))
            yield (here, a + start - first, a + stop - first, True) if copied else (here, a, b, False)
            here, start, k = here + stop - start, stop, k + 1

    def source(self, start: int, end: int) -> Span:
        """The source span of a non-empty span of this text."""
        first, a, b, copied = self.runs[bisect_right(self.starts, start) - 1]
        left = a + start - first if copied else a
        first, a, b, copied = self.runs[bisect_right(self.starts, end - 1) - 1]
        return left, a + end - first if copied else b


#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухіјѕԁԛԝһӏАВЕКМНОРСТУХІЈЅαοερνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡℓ",
                       "aeopcyxijsdqwhlABEKMHOPCTYXIJSaoepviktuABEZHIKMNOPTYXiagl", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
_SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "－": "-", "‐": "-", "‑": "-",
          "–": "-", " ": " ", " ": " ", " ": " ", "　": " ", "（": "(", "）": ")"}
_FOREIGN = re.compile("[" + "".join(map(re.escape, [*_LOOKALIKES, *_INVISIBLE, *_SIGNS])) + "０-ｚ٠-٩۰-۹०-९\U0001d400-\U0001d7ff]")


def _plain(char: str) -> str:
    if char in _INVISIBLE:
        return ""
    if found := _LOOKALIKES.get(char) or _SIGNS.get(char):
        return found
    if (digit := unicodedata.decimal(char, None)) is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", char)
    return folded if len(folded) == 1 and folded.isascii() else char


def plain_letters(m: Mapped) -> Mapped:
    """Look-alikes, full-width forms, foreign digits and invisible characters to ASCII."""
    changes = []
    for found in _FOREIGN.finditer(m.text):
        new = _plain(found.group())
        if new != found.group():
            changes.append((*found.span(), new))
    return m.rewritten(changes) if changes else m


#: Digit words of the four languages, and words for a plus sign.
_DIGITS = {w: str(d) for words in (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(words.split())}
_DIGITS |= {"oh": "0", "zwo": "2"}
_WORDS = "|".join(sorted(_DIGITS, key=len, reverse=True))
_GAP = r"[ \t]*+[-,./·]?[ \t]*+"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:plus|más)\b{_GAP})?(?:(?:{_WORDS}|[0-9]++)\b{_GAP}(?:(?:dot|punkt|point|punto)\b{_GAP})?){{3,}}")
_NEXT = rf"\b{_GAP}(?:(?:dot|punkt|point|punto)\b{_GAP})?"
#: No narrower than a run with a spelled digit: it has another digit, spelled or not, on one side or the other.
_SPELLED_CUE = re.compile(rf"(?i)(?<!\w)(?:{_WORDS}){_NEXT}(?:(?:{_WORDS})\b|[0-9])|[0-9]{_NEXT}(?:{_WORDS})\b")
_TOKEN = re.compile(rf"(?i)(?<!\w)(?:{_WORDS}|plus|más|dot|punkt|point|punto)(?!\w)")
_DOTS = ("dot", "punkt", "point", "punto")


def spelled_digits(m: Mapped) -> list[Mapped]:
    """Runs of three or more digits, some of them spelled: the words become digits and the gaps between them close.

    A run with a single spelled digit may as well be a number beside a common word. Where there is one, the text is read twice, without and
    with such runs rewritten, and the scanners judge.
    """
    if not _SPELLED_CUE.search(m.text):
        return [m]
    sure: list[tuple[int, int, str]] = []
    every: list[tuple[int, int, str]] = []
    for run in _SPELLED.finditer(m.text):
        tokens = list(_TOKEN.finditer(m.text, run.start(), run.end()))
        spelled = sum(t.group().lower() in _DIGITS for t in tokens)
        if not spelled:
            continue
        changes: list[tuple[int, int, str]] = []
        for t in tokens:
            word = t.group().lower()
            new = "." if word in _DOTS else _DIGITS.get(word, "+")
            start, end = t.span()
            # The gap behind a word goes with it, but for the end of the run; so does one in front of a spoken dot.
            while end < run.end() and m.text[end] in " \t,-/·":
                end += 1
            if end == run.end():
                end = t.end()
            if word in _DOTS:
                floor = changes[-1][1] if changes else run.start()
                while start > floor and m.text[start - 1] in " \t":
                    start -= 1
            changes.append((start, end, new))
        every += changes
        if spelled > 1:
            sure += changes
    readings = [m.rewritten(sure) if sure else m]
    return readings if len(sure) == len(every) else [*readings, m.rewritten(every)]


#: Spoken or bracketed signs.
_AT = r"(?:\s*+[\[({<]\s*+(?:at|@|ät|arroba|arobase)\s*+[\])}>]\s*+|\s++(?:at|arroba|arobase)\s++|\s++@\s*+|@\s++)"
_DOT = r"(?:\s*+[\[({<]\s*+(?:dot|\.|punkt|point|punto)\s*+[\])}>]\s*+|\s++(?:dot|punkt|point|punto)\s++)"
_LABEL = r"[A-Za-z0-9-]{1,63}+"
_NAME = r"[A-Za-z0-9._%+-]{1,64}+"
_DISGUISED_AT = re.compile(rf"(?i)({_NAME}(?:{_DOT}{_NAME}){{0,4}})({_AT}|@)({_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{1,6}})")
_AT_CUE = re.compile(r"(?i)[\[({<]\s*+(?:at|@|ät|arroba|arobase|dot|\.|punkt|point|punto)\s*+[\])}>]|\s(?:dot|punkt|point|punto)\s|\s@|@\s")
_DOTTED = re.compile(rf"(?i){_DOT}")
_IP_DOTS = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}+(?:(?:{_DOT}|\.)[0-9]{{1,3}}+){{3}}(?![0-9])")


def spoken_signs(m: Mapped) -> Mapped:
    """Disguised at and dot signs inside what then reads as an address: a plain dot and a plain "at" prove nothing alone."""
    if not _AT_CUE.search(m.text):
        return m
    spans: list[tuple[int, int, str]] = []
    for found in _DISGUISED_AT.finditer(m.text):
        spoken = found.group(2).strip().isalpha()
        dots = [(*d.span(), ".") for part in (1, 3) for d in _DOTTED.finditer(m.text, *found.span(part))]
        # "look at example.com" is no address: a bare spoken at needs a disguised dot behind it.
        if found.group(2) == "@" and not dots or spoken and not any(d[0] >= found.start(3) for d in dots):
            continue
        spans.extend([*dots, (*found.span(2), "@")])
    for found in _IP_DOTS.finditer(m.text):
        spans.extend((*d.span(), ".") for d in _DOTTED.finditer(m.text, *found.span()))
    changes: list[tuple[int, int, str]] = []
    for span in sorted(set(spans)):
        if not changes or span[0] >= changes[-1][1]:
            changes.append(span)
    return m.rewritten(changes) if changes else m


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) of all identifiers of a text, by kind as listed, then start."""
    text = text or ""
    base = {kind: list(scan(text)) for kind, scan in SCANNERS.items()}
    source = Mapped(text)
    readings = [spoken_signs(m) for m in spelled_digits(source if text.isascii() else plain_letters(source))]
    out = []
    for kind, scan in SCANNERS.items():
        spans = {span: False for span in base[kind]}
        for m in readings:
            if m is source:
                continue
            known = list(spans)
            for start, end in scan(m.text):
                span = m.source(start, end)
                if any(_within(span, other) for other in known):
                    continue
                # What a later reading extends is one identifier; plain spans always stay.
                for other in known:
                    if spans.get(other) and _within(other, span):
                        del spans[other]
                spans[span] = True
        out.extend((kind, *span, disguised) for span, disguised in sorted(spans.items()))
    return out


def _within(span: Span, other: Span) -> bool:
    return other[0] <= span[0] and span[1] <= other[1]


_SPANS = ArrayType(StructType([StructField("kind", StringType(), False), StructField("start", LongType(), False),
                               StructField("end", LongType(), False), StructField("disguised", BooleanType(), False)]), False)


def detect(documents: DataFrame, spans_col: str = "spans") -> DataFrame:
    """``documents`` with an array of the identifiers of each whole text."""
    text = documents.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "disguised"), s, strict=True)) for s in find(t.as_py())] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, spans_col])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(spans_col, _SPANS, False)]))


def redact_text(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in brackets; overlapping spans are replaced together, by the first one's kind."""
    found = sorted((start, -end, kind) for kind, start, end, _ in find(text))
    if not found:
        return text
    parts, at = [], 0
    for start, end, kind in found:
        if start >= at:
            parts.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, -end)
    return "".join(parts) + text[at:]


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with redacted texts; a null text stays null, and n_chars, where there is one, counts the new text."""
    text = documents.columns.index("text")
    counts = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            new = [redact_text(t.as_py()) for t in columns[text]]
            if counts is not None:
                old = columns[counts]
                columns[counts] = pa.array([c.as_py() if n is None or len(n) == len(o.as_py()) else len(n) for c, n, o in zip(old, new, columns[text], strict=True)], old.type)
            columns[text] = pa.array(new, columns[text].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(run, documents.schema)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def report(documents: DataFrame) -> DataFrame:
    """Per document: counts by kind, digest of the plain spans, and all spans as text."""
    narrow = documents.select("doc_id", "text")
    schema = StructType([narrow.schema[0], *[StructField(f"n_{k}", LongType(), False) for k in KINDS],
                         StructField("base_sha256", StringType(), False), StructField("spans", StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in row) for row in rows], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(joined([s[:3] for s in row if not s[3]]).encode()).hexdigest() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(base, pa.string()), pa.array([joined([s[:3] for s in row]) for row in rows], pa.string())], names=schema.names)

    return narrow.mapInArrow(run, schema)
