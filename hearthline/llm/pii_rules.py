"""Plain rules for personal data: email, ip, card and phone spans of one text, leftmost and without overlap in a kind.

Each search is linear in the text: runs are taken whole, as no shorter take of a run can match where the whole run does not.
"""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the checksum of card numbers."""
    doubled = "0246813579"
    return sum(int(c) for c in digits[::-1][::2]) % 10 == -sum(int(doubled[int(c)]) for c in digits[::-1][1::2]) % 10


def is_card(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", text)) <= 15


def small_part(part: str) -> bool:
    """A decimal number of at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p and not NOT_DIGIT.search(p) and small_part(p) for p in parts)


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """All spans by kind, then start."""
    out = emails(text)
    for kind, pattern, good in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m.group())]
    return out


def plausible(kind: str, text: str) -> bool:
    """Whether a span that only the tagger found may be what it is tagged as."""
    if kind == "email":
        name, _, host = text.partition("@")
        return bool(name) and "." in host.strip(".") and not re.search(r"\s", text)
    if kind == "ip":
        return is_ip(re.sub(r"[^0-9]+", ".", text).strip("."))
    return is_card(text) if kind == "card" else is_phone(text)
