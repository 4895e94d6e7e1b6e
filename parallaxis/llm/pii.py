"""Personal data by anchor expansion: an automaton finds cues, local parsers expand and check what stands around each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import free_name, small_batches

#: Kinds in the order that ties of a start are listed in; those after phone are the method's own.
KINDS = ("email", "ip", "card", "phone", "account", "url", "handle")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[\s:#=.]{0,3}(?:(?:no|number|nr)\b[\s:#=.]{0,3})?((?=[A-Z0-9-]{0,30}[0-9])[A-Z0-9][A-Z0-9-]{4,30})(?![A-Za-z0-9])")
_URL = re.compile(r"[^\s<>\"'|]+")
_AUTHORITY = re.compile(r"[^\s<>\"'|/?#]+")
#: Marks that end a sentence rather than a URL.
_TAIL = ".,;:!?)]}"
_HANDLE = re.compile(r"[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_@]|\.[A-Za-z0-9])")

#: Cues that name an identifier, in lower case; the parser asks for a number after them.
IDENTIFIERS = ("account", "acct", "iban", "passport", "ssn")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue, what in [("@", "@"), ("+", "+"), *((str(d), "digit") for d in range(10)), *((w, "name") for w in IDENTIFIERS), *((w, "scheme") for w in SCHEMES)]:
        a.add_word(cue, (what, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def iban_ok(text: str) -> bool:
    """Remainder 1 modulo 97 with the first four characters moved to the end, letters counted from 10."""
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    m = _LABEL.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def _lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def _octet(digits: str) -> bool:
    """Whether a run of digits, however long, is 255 at most."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def find(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, kind's number, end) in code points, by start and kind."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    emails = dotted = digits = phones = urls = hosts = numbers = 0  # where the last match of a kind ends
    for end, (what, size) in _automaton().iter(_lowered(text)):
        at = end - size + 1
        if what == "digit":
            if at >= dotted:
                m = _DOTTED.match(text, at)
                dotted = m.end()
                if dotted - at >= 7:
                    parts = [(x.start(), x.end()) for x in re.finditer("[0-9]+", m.group())]
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i : i + 4]
                        if all(_octet(m.group()[a:b]) for a, b in four):
                            out.append((at + four[0][0], 1, at + four[3][1]))
            if at >= digits:
                m = _DIGITS.match(text, at)
                digits = m.end()
                if digits - at >= 14:
                    plain = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(plain) <= 19 and luhn(plain):
                        out.append((at, 2, digits))
            if at >= 2 and at >= numbers and text[at - 2 : at].isupper() and text[at - 2 : at].isascii() and (at == 2 or not text[at - 3].isalnum()):
                m = _IBAN.match(text, at - 2)
                if m and iban_ok(m.group()):
                    out.append((at - 2, 4, m.end()))
                    numbers = m.end()
        elif what == "@":
            found = _email(text, at, emails)
            if found:
                out.append((found[0], 0, found[1]))
                emails = found[1]
            elif (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "._%+-@")) and (m := _HANDLE.match(text, at + 1)):
                out.append((at, 6, m.end()))
        elif what == "+":
            if at >= phones and (m := _PHONE.match(text, at)):
                phones = m.end()
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((at, 3, phones))
        elif what == "scheme":
            if at >= urls and end + 1 >= hosts and (m := _AUTHORITY.match(text, end + 1)):
                host = m.group().rstrip(_TAIL).rsplit("@")[-1]
                if "." in host:
                    urls = stop = _URL.match(text, end + 1).end()
                    while stop > end + 1 and text[stop - 1] in _TAIL:
                        stop -= 1
                    out.append((at, 5, stop))
                else:
                    hosts = m.end()  # a scheme inside has no better host
        elif at >= numbers and (at == 0 or not text[at - 1].isalnum()):
            m = _NUMBER.match(text, end + 1)
            if m and sum(c.isdigit() for c in m.group(1)) >= 5:
                out.append((m.start(1), 4, m.end()))
                numbers = m.end()
    return sorted(set(out))


def find_pii(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """The input without its text, with an array of (kind, start, end); ends are exclusive, positions are code points.

    Null and empty texts have an empty array. A text's spans depend on nothing but the text, so ties and repeated rows
    get equal arrays; an empty table gives an empty table. A column of the input named like the result is replaced.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text_col and c.lower() != out.lower()]
    src = df.select(*keep, F.col(text_col).alias(free_name(df, "_t")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{out}` array<struct<kind:string,start:long,end:long>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], names=[*keep, out])

    return src.mapInArrow(run, schema)


def mask_pii(text: str | None) -> str | None:
    """The text with every span, overlaps joined, replaced by its first kind in angle brackets."""
    if not text:
        return text
    out, at = [], 0
    spans = find(text)
    i = 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{KINDS[kind]}>"]
        at = end
    return "".join([*out, text[at:]])
