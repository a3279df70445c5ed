"""Personal data: anchors found by Aho-Corasick are expanded and validated by small deterministic parsers.

One automaton pass over a text finds the characters and words that any span must contain: at-signs, plus signs, digits,
URL schemes and identifier cues.  A parser starts at each anchor and looks only at its surroundings.

Spans, in code points, end exclusive, leftmost and non-overlapping within a kind:

* ``email``, ``ip``, ``card``, ``phone``: the base kinds.  A candidate that fails its check (an octet over 255, the card's
  length or check digit, the phone's number of digits) is dropped and the search goes on behind it.
* ``url`` (after ``://``), ``iban`` (after the cue, check digits verified), ``ssn`` and ``account`` (digits after a cue).
* ``secret``: what is assigned to a name such as ``token`` or ``password`` (eight characters or more, a digit among them, no
  prose), keys that announce themselves by a public prefix, and private keys with their frame.

A null text is an empty one and has no span; a text is read whole, whatever its length.  Every input row gives one row,
repeated rows and null ids too.  Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwise.llm.frames import in_arrow, table, texts

KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "account", "secret")
BASE = KINDS[:4]
CUES = {"iban": ("IBAN", "iban", "Iban"), "ssn": ("SSN", "ssn", "Social Security"),
        "account": ("account", "Account", "ACCOUNT", "acct", "Acct")}

# Names that secrets are assigned to, and prefixes of published key formats with what follows them.
SECRET_NAMES = ("token", "password", "passwd", "pwd", "secret", "api_key", "api-key", "apikey", "access_key", "private_key")
KEY_PREFIXES = {
    "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "ghp_": r"[A-Za-z0-9]{36}", "gho_": r"[A-Za-z0-9]{36}",
    "github_pat_": r"[A-Za-z0-9_]{22,90}", "sk_live_": r"[A-Za-z0-9]{16,64}", "xoxb-": r"[A-Za-z0-9-]{20,80}",
    "xoxp-": r"[A-Za-z0-9-]{20,80}", "AIza": r"[A-Za-z0-9_-]{35}",
}
_FRAME = "-----BEGIN "

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_URL_REST = re.compile(r"[^\s<>\"'(){}|\\^`]+")
_IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?:\x20?(?:number|no\.?))?[\x20:#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I)
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?))?[\x20:#]{0,3}([0-9]{6,18})(?![0-9])", re.I)

_ASSIGNED = re.compile(r"[\"']?[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9_./+=~-]{8,})")
_HAS_DIGIT = re.compile(r"[0-9]")
_KEYS = {prefix: re.compile(f"({rest})(?![A-Za-z0-9])") for prefix, rest in KEY_PREFIXES.items()}
_FRAMED = re.compile(r"[A-Z0-9\x20]{0,30}PRIVATE KEY-----")
_FRAME_END = re.compile(r"-----END [A-Z0-9\x20]{0,30}PRIVATE KEY-----")

SCHEMA = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
          "n_secret bigint, n_spans bigint")
_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE),
                    ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("n_spans", pa.int64())])


def anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for character in "0123456789":
        automaton.add_word(character, ("digit", 1))
    for text, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        automaton.add_word(text, (kind, len(text)))
    for kind, cues in CUES.items():
        for cue in cues:
            automaton.add_word(cue, (kind, len(cue)))
    for name in SECRET_NAMES:
        for cue in (name, name.capitalize(), name.upper()):
            automaton.add_word(cue, ("assigned", len(cue)))
    for prefix in KEY_PREFIXES:
        automaton.add_word(prefix, ("key", len(prefix)))
    automaton.add_word(_FRAME, ("frame", len(_FRAME)))
    automaton.make_automaton()
    return automaton


def _secret(text: str, anchor: str, start: int, end: int, frame_ends: list[int]) -> tuple[int, int] | None:
    """The secret that a cue at ``start`` to ``end`` announces; ``frame_ends`` are the text's ends of frames."""
    if anchor == "assigned":
        match = _ASSIGNED.match(text, end)
        return match.span(1) if match and _HAS_DIGIT.search(match.group(1)) else None
    if anchor == "key":
        match = _KEYS[text[start:end]].match(text, end)
        return (start, match.end()) if match and not text[start - 1 : start].isalnum() else None
    match = _FRAMED.match(text, end)
    if not match:
        return None
    close = bisect_right(frame_ends, match.end())
    return start, frame_ends[close] if close < len(frame_ends) else match.end()


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban_valid(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def find(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    passed = dict.fromkeys(KINDS, 0)  # where the search of a kind goes on
    frame_ends: list[int] | None = None
    for last, (anchor, length) in automaton.iter(text):
        if anchor == "digit":
            if last >= passed["ip"]:
                if match := _QUAD.match(text, last):
                    passed["ip"] = match.end()
                    if all(_octet(p) for p in match.group().split(".")):
                        found["ip"].append(match.span())
                else:  # no later digit of this run can do better
                    passed["ip"] = _DIGITS.match(text, last).end()
            if last >= passed["card"]:
                if match := _CARD.match(text, last):
                    passed["card"] = match.end()
                    digits = match.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(match.span())
        elif anchor == "at":
            start = last
            while start > passed["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (match := _DOMAIN.match(text, last + 1)):
                passed["email"] = match.end()
                found["email"].append((start, match.end()))
        elif anchor == "plus":
            if last >= passed["phone"] and (match := _PHONE.match(text, last)):
                passed["phone"] = match.end()
                if 8 <= sum(c.isdigit() for c in match.group()) <= 15:
                    found["phone"].append(match.span())
        elif anchor == "scheme":
            start = last - 2
            while start > passed["url"] and text[start - 1] in _SCHEME:
                start -= 1
            while start < last - 2 and not text[start].isalpha():
                start += 1
            if start < last - 2 and (match := _URL_REST.match(text, last + 1)):
                end = match.end()
                while text[end - 1] in ".,;:!?":
                    end -= 1
                if end > last + 1:
                    passed["url"] = end
                    found["url"].append((start, end))
        elif anchor in ("assigned", "key", "frame"):
            start = last + 1 - length
            if start < passed["secret"]:
                continue
            if anchor == "frame" and frame_ends is None:
                frame_ends = [match.end() for match in _FRAME_END.finditer(text)]
            if span := _secret(text, anchor, start, last + 1, frame_ends or []):
                passed["secret"] = span[1]
                found["secret"].append(span)
        else:
            match = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[anchor].match(text, last + 1)
            if match and match.start(1) >= passed[anchor] and (anchor != "iban" or iban_valid(match.group(1))):
                passed[anchor] = match.end(1)
                found[anchor].append(match.span(1))
    return found


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans[kind])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = anchors()
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE]
        digests, spans, secrets, every = [], [], [], []
        for value in batch.column("text"):
            found = find(value.as_py() or "", automaton)
            for kind, column in zip(BASE, counts):
                column.append(len(found[kind]))
            digests.append(hashlib.sha256(listed(found, BASE).encode()).hexdigest())
            spans.append(listed(found, KINDS))
            secrets.append(len(found["secret"]))
            every.append(sum(map(len, found.values())))
        yield table(_ARROW, batch.column("doc_id"), *counts, digests, spans, secrets, every)


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, all spans, and the counts of secrets and of all spans; no shuffle."""
    return in_arrow(texts(docs), _scan, SCHEMA)
