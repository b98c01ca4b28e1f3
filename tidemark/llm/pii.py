"""PII by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus
signs, digits, URL schemes and identifier cues. At each anchor a deterministic
parser expands to the boundaries of the entity and validates it. Base kinds (email,
ip, card, phone) follow fixed patterns, leftmost and non-overlapping per kind; a
pattern match that fails its validation is dropped and its characters stay consumed.
Added kinds: ``url`` (scheme address), ``account`` (IBAN by its check digits, or the
identifier after a cue such as "account", "iban", "ssn", "passport") and ``secret``
(the value after "token =", "api_key:", "password:" and the like).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import hex_sha256, lean_worker

#: Kinds in their listed order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE_KINDS = KINDS[:4]

#: Fixed cue words, lower case.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")

#: Most characters an identifier or its lead-in may have: a grammar rule, not a cut of the text.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|\\^`{}\[\]]+")
_LEAD = re.compile(r"(?:[\x20_-]?(?:no|nr|number|id|key))?\.?[\x20]{0,2}[:=#][\x20]{0,2}[\"']?(?=[A-Za-z0-9])")
_VALUE = re.compile(r"[A-Za-z0-9_+/.=-]{8,}")
_ACCOUNT = re.compile(r"(?:[\x20](?:no|nr|number|id))?\.?[\x20]{0,2}[:=#]?[\x20]{0,2}([A-Z]{0,2}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in ("@", "+"):
        a.add_word(w, (w, 1))
    for d in "0123456789":
        a.add_word(d, ("d", 1))
    # cues are matched in the lower, the capitalised and the upper case form
    for kind, words in (("s", SCHEMES), ("a", ACCOUNT_CUES), ("k", SECRET_CUES)):
        for w in words:
            for form in {w, w.capitalize(), w.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_AUTOMATON = None


def _anchors(text: str):
    global _AUTOMATON
    if _AUTOMATON is None:       # once per Python worker
        _AUTOMATON = _automaton()
    return _AUTOMATON.iter(text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All (start, end, kind) of a text in code points, by start, then kind as listed.

    None and empty texts have none. Spans of different kinds may overlap; those of
    one kind do not. Each value is read once, so the time is linear in the text's length."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)
    plain = 0                                  # end of the last secret value refused for want of a digit
    for end, (what, n) in _anchors(text):
        at = end - n + 1
        if what == "d":
            if at and text[at - 1] in _DIGITS:
                continue                       # parsers start at the head of a digit run
            if at >= done["ip"]:
                m = _IP.match(text, at)
                if m:
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                        out.append((at, m.end(), "ip"))
            if at >= done["card"]:
                m = _CARD.match(text, at)
                if m:
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, m.end(), "card"))
            s = at - 2                         # an IBAN: two capitals before the digits
            if s >= done["account"] and text[s:at].isascii() and text[s:at].isupper() \
                    and text[s:at].isalpha() and not (s and text[s - 1].isalnum()):
                m = _IBAN.match(text, s)
                while m:                       # words after it may look like part of it
                    if iban_ok(m[0]):
                        out.append((s, m.end(), "account"))
                        done["account"] = m.end()
                        break
                    cut = m[0].rfind(" ")
                    m = _IBAN.fullmatch(text, s, s + cut) if cut > 0 else None
        elif what == "@":
            lo, floor = at, done["email"]
            while lo > floor and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at:
                m = _DOMAIN.match(text, at + 1)
                if m:
                    out.append((lo, m.end(), "email"))
                    done["email"] = m.end()
        elif what == "+":
            if at >= done["phone"]:
                m = _PHONE.match(text, at)
                if m:
                    done["phone"] = m.end()
                    if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                        out.append((at, m.end(), "phone"))
        elif what == "s":
            if at >= done["url"] and not (at and text[at - 1].isalnum()):
                m = _URL.match(text, end + 1)
                if m:
                    stop = end + 1 + len(m[0].rstrip(".,;:!?)"))
                    if stop > end + 1:
                        out.append((at, stop, "url"))
                        done["url"] = stop
        else:
            if at and text[at - 1].isalnum():
                continue
            if what == "a":
                m = _ACCOUNT.match(text, end + 1)
                if m and m.start(1) >= done["account"] and any(c in _DIGITS for c in m[1]):
                    out.append((m.start(1), m.end(1), "account"))
                    done["account"] = m.end(1)
                continue
            lead = _LEAD.match(text, end + 1)
            # a cue inside a value already read would take the rest of it: read each value once
            if lead and lead.end() >= max(done["secret"], plain):
                m = _VALUE.match(text, lead.end())
                if m and any(c in _DIGITS for c in m[0]):
                    out.append((*m.span(), "secret"))
                    done["secret"] = m.end()
                elif m:
                    plain = m.end()
    order = {k: i for i, k in enumerate(KINDS)}
    out.sort(key=lambda x: (x[0], order[x[2]]))
    return out


def spans_text(spans, kinds=KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in kinds)


def redact_text(text: str | None, spans) -> str | None:
    """The text with each entity replaced by ``[KIND]``; overlapping spans merge into one
    replacement that names the kind that starts first."""
    if not spans:
        return text
    parts, at, open_ = [], 0, None
    for s, e, k in spans:
        if open_ and s < open_[1]:
            open_[1] = max(open_[1], e)
            continue
        if open_:
            parts += [text[at:open_[0]], f"[{open_[2].upper()}]"]
            at = open_[1]
        open_ = [s, e, k]
    parts += [text[at:open_[0]], f"[{open_[2].upper()}]", text[open_[1]:]]
    return "".join(parts)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, counts of the base kinds, ``spans``
    (array of start, end, kind) and, on request, the redacted text.

    Null and empty texts have no spans; repeated rows each give a row; other columns
    of ``df`` are not read, so their names cannot clash; an empty table gives none.
    The work is one pass of each partition: nothing is shuffled."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, spans array<struct<start:int,end:int,kind:string>>"
    if with_text:
        schema += ", redacted string"

    def run(batches):
        typ = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [find_spans(t) for t in texts]
            cols = [b.column(0), pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found], typ)]
            names = [id_col, "spans"]
            if with_text:
                cols.append(pa.array([redact_text(t, f) for t, f in zip(texts, found)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with its texts redacted in place (same columns, same rows); null stays null.
    ``length_col``, if named, gets the new number of code points."""
    names = df.columns
    schema = df.schema

    def run(batches):
        lean_worker()
        for b in batches:
            at = names.index(text_col)
            texts = b.column(at).to_pylist()
            new = [redact_text(t, find_spans(t)) for t in texts]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if length_col:
                k = names.index(length_col)
                cols[k] = pa.array([None if t is None else len(t) for t in new], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return df.mapInArrow(run, schema)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest per row: counts of the base kinds, ``base_sha256`` and ``spans`` as text.
    The same cases as :func:`detect`."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [find_spans(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(x[2] == k for x in r) for r in rows], pa.int64()) for k in BASE_KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts,
                 pa.array([hex_sha256(spans_text(r, BASE_KINDS).encode()) for r in rows], pa.string()),
                 pa.array([spans_text(r) for r in rows], pa.string())],
                [id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"{id_col} {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
