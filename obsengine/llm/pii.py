"""Personal data by anchor expansion.

One Aho-Corasick automaton over a text finds anchors: at-signs, digits, plus signs before a digit, schemes and identifier
cues. A deterministic local parser expands each anchor to a span and validates it. Parsers of one kind take the leftmost
match and go on after it; a match that fails validation is dropped and the parser goes on after it as well.

Kinds. email: local part, at-sign, labels joined by dots (at least two). ip: four groups of digits joined by dots, each
at most 255. card: digits with at most one space or hyphen between, 14 to 19 of them, Luhn sum right. phone: plus sign,
digit, further digits and separators up to the last digit, 10 to 15 digits. Three kinds more: url: a scheme, "://" and
what follows up to white space, quotes or brackets, if it names a user ("user@" or "user:word@"); account: the number
after an identifier cue, of 6 to 34 letters and digits with at least 5 digits (mod-97 checked after "iban"); secret: what is
assigned to, or follows, a cue such as token or password: 16 letters, digits and signs or more, of them 4 letters and 4 digits at
least. Cues count in any case.

Offsets are code points, end exclusive. Cases: a null or empty text has no spans; rows that repeat are handled one by
one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsengine.llm.common import id_and_text, per_batch

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
CUES = ("account number", "account no", "account:", "acct", "iban", "passport", "ssn", "tax id", "customer id", "kontonummer", "numéro de compte", "número de cuenta")
SECRET_CUES = ("token", "secret", "password", "passwd", "passphrase", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "client_secret", "bearer")
# A-Z to a-z, where lower() would change the length of a text.
_LOWER = {c: c + 32 for c in range(65, 91)}

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_LABEL = _LETTERS | _DIGITS | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_ACCOUNT = re.compile(r"[\s:#.\-]{0,4}(?:(?:no|nr|number|is|es|est|ist)\b[\s:#.\-]{0,4})?([A-Za-z0-9](?:[ \-]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"'`]?(?:\s{0,3}(?::=|=>|[:=])\s{0,3}|\s{1,3}(?:is\s{1,3})?)[\"'`]?([A-Za-z0-9_\-./+]{16,}={0,2})")
_AFTER_SCHEME = re.compile(r"[^\s\"'<>()\[\]{}]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    for d in sorted(_DIGITS):
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("phone", 2))
    found.add_word("://", ("url", 3))
    found.make_automaton()
    cues = ahocorasick.Automaton()
    for kind, words in (("account", CUES), ("secret", SECRET_CUES)):
        for cue in words:
            cues.add_word(cue, (kind, len(cue)))
    cues.make_automaton()
    return found, cues


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def _secret(text: str, at: int) -> tuple[int, int] | None:
    """What a cue that ends at `at` gives."""
    m = _SECRET.match(text, at)
    if not m or sum(c in _DIGITS for c in m[1]) < 4 or sum(c in _LETTERS for c in m[1]) < 4:
        return None
    return m.start(1), m.end(1)


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Around the at-sign at `at`, from least on."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    n, end, dots, k = len(text), 0, 0, at + 1
    while k < n and text[k] in _LABEL:
        while k < n and text[k] in _LABEL:
            k += 1
        end, dots = k, dots + 1
        if k < n and text[k] == ".":
            k += 1
        else:
            break
    return (start, end) if start < at and dots > 1 else None


def _run(text: str, k: int) -> int:
    n = len(text)
    while k < n and text[k] in _DIGITS:
        k += 1
    return k


def _ip(text: str, at: int) -> tuple[int, int, bool] | None:
    """Four groups from the digit at `at`, and whether each is at most 255."""
    k, fit, n = at, True, len(text)
    for group in range(4):
        end = _run(text, k)
        if end == k:
            return None
        digits = text[k:end].lstrip("0")
        fit &= len(digits) < 4 and int(digits or 0) <= 255
        k = end
        if group < 3:
            if k >= n or text[k] != ".":
                return None
            k += 1
    return at, k, fit


def _card(text: str, at: int) -> tuple[int, int, bool] | None:
    """Digits from `at` with at most one separator between, and whether they are a card's."""
    n, k, digits = len(text), at + 1, [text[at]]
    while True:
        if k < n and text[k] in _DIGITS:
            digits.append(text[k])
            k += 1
        elif k + 1 < n and text[k] in " -" and text[k + 1] in _DIGITS:
            digits.append(text[k + 1])
            k += 2
        else:
            break
    return (at, k, 14 <= len(digits) <= 19 and luhn("".join(digits))) if len(digits) > 1 else None


def _phone(text: str, at: int) -> tuple[int, int, bool] | None:
    """From the plus sign at `at`, which a digit follows."""
    n, k, last, count = len(text), at + 2, 0, 1
    while k < n and text[k] in _PHONE:
        if text[k] in _DIGITS:
            last, count = k, count + 1
        k += 1
    return (at, last + 1, 10 <= count <= 15) if last >= at + 3 else None


def _url(text: str, at: int) -> tuple[int, int] | None:
    start = at
    while start > 0 and text[start - 1] in _LETTERS:
        start -= 1
    after = _AFTER_SCHEME.match(text, at + 3)
    if start == at or not after or "@" not in after[0].split("/")[0]:
        return None
    return start, after.end()


def _account(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The number after a cue that ends before `at`."""
    m = _ACCOUNT.match(text, at)
    if not m:
        return None
    plain = re.sub(r"[ \-]", "", m[1])
    if sum(c in _DIGITS for c in plain) < 5 or (cue == "iban" and not (plain[:2].isalpha() and plain[2:4].isdigit() and mod97(plain.upper()))):
        return None
    return m.start(1), m.end(1)


def spans_of(text: str, found) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind as listed in KINDS. found: anchors()."""
    out: list[tuple[int, int, int]] = []
    after = dict.fromkeys(KINDS, 0)
    low = _lower(text)
    for end, (kind, size) in found[1].iter(low):
        at = end - size + 1
        if at >= after[kind] and (m := _account(text, end + 1, low[at : end + 1]) if kind == "account" else _secret(text, end + 1)):
            after[kind] = m[1]
            out.append((m[0], KINDS.index(kind), m[1]))
    for end, (kind, size) in found[0].iter(text):
        at = end - size + 1
        if kind == "digit":
            if at >= after["ip"] and (at == 0 or text[at - 1] not in _DIGITS) and (m := _ip(text, at)):
                after["ip"] = m[1]
                if m[2]:
                    out.append((at, 1, m[1]))
            if at >= after["card"]:
                if m := _card(text, at):
                    after["card"] = m[1]
                    if m[2]:
                        out.append((at, 2, m[1]))
                else:
                    after["card"] = at + 1
        elif kind == "email":
            if at >= after["email"] and (m := _email(text, at, after["email"])):
                after["email"] = m[1]
                out.append((m[0], 0, m[1]))
        elif kind == "phone":
            if at >= after["phone"] and (m := _phone(text, at)):
                after["phone"] = m[1]
                if m[2]:
                    out.append((at, 3, m[1]))
        elif at >= after["url"] and (m := _url(text, at)):
            after["url"] = m[1]
            out.append((m[0], 4, m[1]))
    out.sort()
    return [(KINDS[k], s, e) for s, k, e in out]


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of each row."""
    docs = id_and_text(documents, id_col, text_col)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(span))])

    def make():
        found = anchors()

        def f(batch):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, found)] if t else [] for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "spans": spans}

        return f

    return per_batch(docs, schema, make)


def counted(found: DataFrame) -> DataFrame:
    """n_<kind> of each row of find(), and its spans as text, of the base kinds and of all."""

    def line(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))

    found = found.withColumn("base", F.filter("spans", lambda x: x["kind"].isin(*BASE)))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, line("base").alias("base_text"), line("spans").alias("span_text"))


def redacted(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with every span replaced by <kind>; all columns and rows are kept, overlapping spans become one."""
    import pyarrow as pa

    def make():
        found = anchors()

        def clean(text):
            if not text:
                return text
            out, last = [], 0
            for kind, s, e in spans_of(text, found):
                if s >= last:
                    out += [text[last:s], f"<{kind}>"]
                last = max(last, e)
            return "".join([*out, text[last:]])

        def f(batch):
            at = batch.schema.get_field_index(text_col)
            column = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], schema=batch.schema)

        return f

    return per_batch(documents, documents.schema, make)
