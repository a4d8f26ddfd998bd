"""Personal data in texts: cues found by Aho-Corasick, expanded and checked by local parsers.

One automaton finds at-signs, "+digit", "scheme://", dotted digits, digits that follow each other (also over one
space or hyphen), country codes before a digit, words that name an identifier or a secret, and words for streets. A
parser at each cue expands to the boundaries of the item and validates it. Each parser walks a run of characters once,
so texts without cues or with endless runs take linear time; long texts are read whole.

Kinds, in this order: the base kinds email, ip, card, phone; then login
(user:password of a URL), iban (length of its country, checksum modulo 97), account (the number after
a cue such as "SSN:", "account no." or "passport"), address (a house number beside a street's name) and secret
(the value given to a password, token or key). Spans are (kind, start, end)
in code points, end exclusive, ordered by start, then kind as listed. Null counts
as an empty text; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import release

#: Texts that leave a worker at once.
ROWS = 256
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "address", "secret")
#: Words that name an identifier whose number follows (fixed values).
CUES = ("ssn", "social security", "account", "acct", "passport", "tax id", "driver license", "id number", "customer id")
#: Words to which a secret is given (fixed values).
SECRETS = ("password", "passwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "private_key")
#: Words for streets after the name (fixed values).
STREETS = (" street", " avenue", " road", " lane", " drive", " boulevard", " court", " square", "straße", "strasse", " weg", " allee")
#: Words for streets before the name (fixed values).
STREETS_BEFORE = ("rue ", "avenue ", "boulevard ", "calle ", "avenida ", "plaza ", "via ")
#: Lengths of account numbers by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits that the match before didn't reach, so the run's start is enough.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The part after the scheme is walked once, whether or not it holds a login.
_LOGIN = re.compile(r"([^\s/@:]++:[^\s/@]++)@|[^\s/@]*+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SECRET = re.compile(r"[\"']?\s{0,3}(?:[:=]|=>)\s{0,3}[\"']?([A-Za-z0-9_./+=-]{8,})")
_HOUSE_BEFORE = re.compile(r"(?<![0-9A-Za-z.,-])([0-9]{1,5}[A-Za-z]?(?: (?:[NSEW]\.? )?[A-Z][\w.'-]{0,30}){1,3})$")
_PLACE_AFTER = re.compile(r"(?:\.?,? (?:Apt|Suite|Unit|No)\.? ?[0-9A-Za-z]{1,6})?(?:, [A-Z][\w'-]{1,30}(?: [A-Z][\w'-]{1,30})?)?(?:,? [A-Z]{2})?(?:,? [0-9]{5}(?:-[0-9]{4})?)?(?![0-9])")
_HOUSE_AFTER = re.compile(r" [0-9]{1,4}[A-Za-z]?(?![0-9A-Za-z])")
_NAMED = re.compile(r"(?:(?:de|la|del|los|las|du|des|di|della) ){0,2}[A-Z][\w'-]{1,30}(?: [A-Z][\w'-]{1,30})?,? [0-9]{1,4}[A-Za-z]?(?![0-9A-Za-z])")
_ACCOUNT = re.compile(r"(?:\s{0,3}(?:no\.?|number|num|#|nr\.?|is))?\s{0,3}[:#=]?\s{0,3}([A-Z]{0,3}[0-9][0-9 -]{4,30}[0-9])(?![0-9A-Za-z])", re.IGNORECASE)
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _iban_end(text: str, m: re.Match) -> int | None:
    """Where the account number ends, if the characters its country asks for are there and check."""
    size, at, held = IBAN_LENGTHS[text[m.start() : m.start() + 2]], m.start(), []
    while len(held) < size and at < m.end():
        if text[at] != " ":
            held.append(text[at])
        at += 1
    number = "".join(held)
    whole = len(number) == size and not (at < len(text) and text[at].isalnum())
    return at if whole and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1 else None


class Finder:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        digits = "0123456789"
        words = {"@": "at", **{f"+{d}": "plus" for d in digits}, **{f".{d}": "dot" for d in digits}, **dict.fromkeys(SCHEMES, "scheme"), **dict.fromkeys(CUES, "cue"), **dict.fromkeys(SECRETS, "secret")}
        words |= {f"{c}{s}{d}": "digits" for c in digits for s in ("", " ", "-") for d in digits}
        words |= {f"{c.lower()}{d}": "country" for c in IBAN_LENGTHS for d in digits}
        words |= {w: "street" for w in STREETS} | {w: "street before" for w in STREETS_BEFORE}
        for word, kind in words.items():
            self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        found: list[tuple[str, int, int]] = []
        email_end = ip_end = phone_end = card_end = 0
        cue_end = login_end = iban_end = address_end = secret_end = 0
        lower = text.lower()
        if len(lower) != len(text):  # a few letters grow in lower case
            lower = text.translate(_ASCII_LOWER)
        for last, (kind, size) in self.automaton.iter(lower):
            at = last - size + 1
            if kind == "digits":
                # The first pair of digits after a match begins the next run, which a match takes whole.
                if at >= card_end:
                    m = _CARD.match(text, at)
                    card_end = m.end()
                    if card_end - at >= 12:
                        number = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(number) <= 19 and luhn(number):
                            found.append(("card", at, card_end))
            elif kind == "at":
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at)):
                    email_end = m.end()
                    found.append(("email", start, email_end))
                elif start < at:
                    # The run before this at-sign was walked once and can't open another match.
                    email_end = max(email_end, at)
            elif kind == "plus":
                if at >= phone_end and (m := _PHONE.match(text, at)):
                    phone_end = m.end()
                    if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        found.append(("phone", at, phone_end))
            elif kind == "dot":
                if at > ip_end and "0" <= text[at - 1] <= "9":
                    start = at
                    while start > ip_end and "0" <= text[start - 1] <= "9":
                        start -= 1
                    if m := _IP.match(text, start):
                        ip_end = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                            found.append(("ip", start, ip_end))
            elif kind == "scheme":
                if at >= login_end:
                    m = _LOGIN.match(text, last + 1)
                    login_end = max(m.end(), last + 1)
                    if m[1]:
                        found.append(("login", m.start(1), m.end(1)))
            elif kind == "country":
                if at >= iban_end and not (at and text[at - 1].isalnum()) and text[at : at + 2] in IBAN_LENGTHS and (m := _IBAN.match(text, at)) and (end := _iban_end(text, m)):
                    iban_end = end
                    found.append(("iban", at, end))
            elif kind == "street":
                if at >= address_end and not text[last + 1 : last + 2].isalnum():
                    if m := _HOUSE_BEFORE.search(text, max(address_end, at - 100), at):
                        address_end = _PLACE_AFTER.match(text, last + 1).end()
                        found.append(("address", m.start(1), address_end))
                    elif text[at] != " " and (m := _HOUSE_AFTER.match(text, last + 1)):
                        start = at
                        while start > address_end and text[start - 1].isalpha():
                            start -= 1
                        if text[start].isupper():
                            address_end = m.end()
                            found.append(("address", start, address_end))
            elif kind == "street before":
                if at >= address_end and not (at and text[at - 1].isalnum()) and (m := _NAMED.match(text, last + 1)):
                    address_end = m.end()
                    found.append(("address", at, address_end))
            elif kind == "secret":
                if at >= secret_end and (m := _SECRET.match(text, last + 1)):
                    secret_end = m.end(1)
                    if any("0" <= c <= "9" for c in m[1]):
                        found.append(("secret", m.start(1), secret_end))
            elif at >= cue_end and (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
                cue_end = m.end(1)
                if 6 <= sum("0" <= c <= "9" for c in m[1]) <= 20:
                    found.append(("account", m.start(1), m.end(1)))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_finder: list[Finder] = []


def finder() -> Finder:
    if not _finder:
        _finder.append(Finder())
    return _finder[0]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes [KIND] of its first."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def pii_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of each text."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = finder()
        for s in parts:
            yield pd.Series([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in f.spans(t)] for t in s], dtype=object)

    return run(text)


def pii_redacted(text: Column) -> Column:
    """The text with its personal data replaced by placeholders; null stays null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = finder()
        for s in parts:
            for at in range(0, len(s), ROWS):
                yield pd.Series([None if t is None else redact(t, f.spans(t)) for t in s.iloc[at : at + ROWS]], dtype=object)
        release()

    return run(text)


def pii_digest(text: Column) -> Column:
    """Counts of the base kinds, the digest of the base spans, all spans and their number, as a struct."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = finder()
        for s in parts:
            rows = []
            for t in s:
                spans = f.spans(t)
                base = [x for x in spans if x[0] in BASE]
                rows.append((*(sum(x[0] == k for x in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return run(text)
