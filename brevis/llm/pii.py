"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at-signs, plus signs,
digits, ``://`` and identifier cues. Around each anchor a deterministic local parser expands the
candidate to its boundaries and validates it:

* ``email``: local part to the left of the at-sign, dotted domain to its right;
* ``ip``: four dotted numbers of 255 at most;
* ``card``: 12 to 19 digits, single blanks or hyphens between them, Luhn check;
* ``phone``: ``+`` and 9 to 15 digits with usual separators;
* ``login``: user information of an address ``scheme://user:password@host``;
* ``account``: an IBAN (mod-97 check) or a number of 6 digits or more after an account cue;
* ``secret``: the value after a password or token cue, or an access key.

Spans are code points, end exclusive. Spans of one kind do not overlap; a candidate of the first
four kinds that fails its validation is dropped without another try inside it.

Defined results: a null text counts as empty and has no spans; repeated rows are searched each on
its own; other columns are untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from brevis.llm.lexicon import blocks
from brevis.session import ship_package

KINDS = ("email", "ip", "card", "phone", "login", "account", "secret")
BASE_KINDS = KINDS[:4]
#: Cues before a secret or an account number, in lower, upper and title case.
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_VALUE = re.compile(r"[ \t]*[=:][ \t]*(?:\"([^\"\s]+)\"|'([^'\s]+)'|([^\s\"',;]+))")
_ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[ \t]*(?:no\.?|number|nr\.?)?[ \t]*[:#=]?[ \t]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}|[0-9][0-9-]{4,20}[0-9])(?![A-Za-z0-9])")
_LOGIN = re.compile(r"([A-Za-z0-9._%+-]+(?::[^\s/@:]*)?)@[A-Za-z0-9]")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("login", 3))
    a.add_word("AKIA", ("key", 4))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                a.add_word(form, (kind, len(cue)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    turned = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then kind in the order of ``KINDS``."""
    out: list[tuple[int, int, str]] = []
    resume = dict.fromkeys(KINDS, 0)

    def found(kind: str, start: int, end: int) -> None:
        out.append((start, end, kind))
        resume[kind] = end

    for last, (anchor, size) in _automaton().iter(text):
        at = last - size + 1
        if anchor == "digit":
            # a run of digits is met at its first digit, or where the last match ended
            if at >= resume["ip"] and (at == resume["ip"] or not "0" <= text[at - 1] <= "9"):
                m = _IP.match(text, at)
                if m:
                    resume["ip"] = m.end()
                    if all(map(_octet, m.group().split("."))):
                        found("ip", at, m.end())
            if at >= resume["card"]:
                m = _CARD.match(text, at)
                if m:
                    resume["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        found("card", at, m.end())
        elif anchor == "email":
            start = at
            while start > resume["email"] and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                found("email", start, m.end())
        elif anchor == "phone":
            if at >= resume["phone"]:
                m = _PHONE.match(text, at)
                if m:
                    resume["phone"] = m.end()
                    if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                        found("phone", at, m.end())
        elif anchor == "login":
            m = _LOGIN.match(text, last + 1) if last + 1 >= resume["login"] else None
            if m and at and text[at - 1].isalpha():
                found("login", last + 1, m.end(1))
        elif anchor == "key":
            m = _ACCESS_KEY.match(text, at) if at >= resume["secret"] and not (at and text[at - 1].isalnum()) else None
            if m:
                found("secret", at, m.end())
        elif anchor == "secret":
            m = _VALUE.match(text, last + 1) if at >= resume["secret"] else None
            if m and len(m.group(m.lastindex)) >= 6:
                found("secret", *m.span(m.lastindex))
        elif at >= resume["account"] and not (at and text[at - 1].isalnum()):
            m = _ACCOUNT.match(text, last + 1)
            if m and (m.group(1)[0].isdigit() or _iban(m.group(1))):
                found("account", *m.span(1))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with ``[KIND]`` for each span; of overlapping spans the first names the whole."""
    parts, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (array of start, end, kind) for the whole text of every row."""
    ship_package(docs.sparkSession)
    fields = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in find_spans(t)] if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(fields))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by placeholders and, if there, ``n_chars`` of
    changed texts set anew. A null text stays null."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            old = b.column("text").to_pylist()
            new = [redact(t, find_spans(t)) if t else t for t in old]
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            columns["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in columns:
                sizes = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(n) if n is not None and n != o else k for n, o, k in zip(new, old, sizes, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)
