"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, `://`, cues of accounts
and secrets, street words. Around each anchor a local parser expands to the span's boundaries and
validates it. Parsers never go back behind an anchor of their kind that was used, so a text is
read in linear time whatever it holds.

Base kinds: email, ip (parts at most 255), card (13 to 19 digits passing the Luhn check), phone
(9 to 15 digits). Kinds of the method itself: account (a valid IBAN, or a cue and a number),
address (house number, names, street word), secret (cue and a long token), url (with user data).
Spans are counted in code points, end exclusive; kinds are independent of each other, so spans of
different kinds may overlap.

Null and empty texts have no spans. Repeated rows are searched one by one. Other columns are kept
by `mask` and not read.
"""

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "secret", "url")
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "routing", "ssn", "social security")
SECRET_CUES = ("api key", "api_key", "apikey", "password", "secret", "token")
STREETS = ("Avenue", "Boulevard", "Drive", "Lane", "Road", "Street")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME_END = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_USER_URL = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+@[^\s\"'<>]+")
_NUMBER = re.compile(r"(?: number| no\.?| num)?[ ]?[:=#]?[ ]?([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.I)
_IBAN = re.compile(r"[ ]?[:=#]?[ ]?([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_TOKEN = re.compile(r"[\"']?[ ]?[:=][ ]?[\"']?([A-Za-z0-9_\-]{16,})")
_HOUSE = re.compile(r"[0-9]{1,5}(?: [A-Z][a-z]{1,20}){1,3} $")
_ADDRESS_REACH, _SCHEME_REACH = 80, 24


def _automaton():
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    for text, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(text, (kind, len(text)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    for word in STREETS:
        found.add_word(" " + word, ("street", len(word)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    turned = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind as in KINDS and then by start."""
    found = []
    email_end = ip_end = card_end = account_end = secret_end = 0
    for last, (anchor, length) in _ANCHORS.iter(text):
        start, end = last - length + 1, last + 1
        if anchor == "digit":
            if start >= ip_end:
                chain = _DOTTED.match(text, start)
                ip_end = chain.end()
                parts = chain[0].split(".")
                at = start
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        found.append(("ip", at, at + size))
                    at += size + 1
            if start >= card_end:
                chain = _SPACED.match(text, start)
                card_end = chain.end()
                if 13 <= card_end - start <= 40:
                    digits = chain[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and _luhn(digits):
                        found.append(("card", start, card_end))
        elif anchor == "at":
            left = start
            while left > email_end and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (domain := _DOMAIN.match(text, end)):
                email_end = domain.end()
                found.append(("email", left, email_end))
        elif anchor == "plus":
            if number := _PHONE.match(text, start):
                if 9 <= sum(c.isdigit() for c in number[0]) <= 15:
                    found.append(("phone", start, number.end()))
        elif anchor == "scheme":
            scheme = _SCHEME_END.search(text[max(0, start - _SCHEME_REACH) : start])
            if scheme and (rest := _USER_URL.match(text, end)):
                found.append(("url", start - len(scheme[0]), rest.end()))
        elif anchor == "account" and end >= account_end and not (start and text[start - 1].isalnum()):
            number = _IBAN.match(text, end)
            number = number if number and _iban(number[1]) else _NUMBER.match(text, end)
            if number:
                account_end = number.end(1)
                found.append(("account", number.start(1), account_end))
        elif anchor == "secret" and end >= secret_end:
            if token := _TOKEN.match(text, end):
                secret_end = token.end(1)
                found.append(("secret", token.start(1), secret_end))
        elif anchor == "street" and not text[end : end + 1].isalpha():
            if house := _HOUSE.search(text[max(0, start - _ADDRESS_REACH) : start]):
                found.append(("address", start - len(house[0]), end))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str, spans) -> str:
    """The text with every span replaced by its kind; overlapping spans merge under the first one's kind."""
    out, at, order = [], 0, sorted(spans, key=lambda s: (s[1], -s[2]))
    k = 0
    while k < len(order):
        kind, start, end = order[k]
        while k + 1 < len(order) and order[k + 1][1] < end:
            k += 1
            end = max(end, order[k][2])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def _texts(data, offsets):
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]


def _report(data, offsets):
    counts, base, joined = [[] for _ in BASE], [], []
    for text in _texts(data, offsets):
        spans = find_spans(text)
        for k, kind in enumerate(BASE):
            counts[k].append(sum(s[0] == kind for s in spans))
        base.append(hashlib.sha256(_joined(s for s in spans if s[0] in BASE).encode()).hexdigest())
        joined.append(_joined(spans))
    return [*(np.array(c, np.int64) for c in counts), base, joined]


def _mask(data, offsets):
    texts = [masked(t, find_spans(t)) for t in _texts(data, offsets)]
    return [texts, np.array([len(t) for t in texts], np.int64)]


def find(docs: DataFrame, keep=("doc_id",), column="text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of each document."""
    return map_texts(
        docs, _report, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", keep, column
    )


def mask(docs: DataFrame, keep=("doc_id",), column="text") -> DataFrame:
    """Columns `keep`, the masked text and its length in code points; a null text becomes an empty one."""
    return map_texts(docs, _mask, "masked_text string, masked_chars bigint", keep, column)


def op8_personal_data(spark, sf_dir) -> DataFrame:
    return find(documents(spark, sf_dir))
