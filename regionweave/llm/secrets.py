"""Secret scan: a keyword automaton finds where a secret could start, anchored expressions look only there, and kinds with an embedded checksum must pass it.

Base kinds: assign, access, hex. Added kinds carry their own proof: `forge` and `registry` tokens end in a base-62 CRC-32 of their body, `card` numbers obey the Luhn rule, `iban` numbers leave 1 modulo 97. Keywords of a card are two digits side by side, of an account number a country's letters and a digit. Where numbers stand side by side, every row of whole groups that has a fitting length is tried, the longest first, since a card may be followed by its expiry date or an account by a bank's code.

Spans are code points, end exclusive. Null and empty texts have no spans. Overlaps of different kinds stay. Very long texts are scanned whole, one at a time in memory; equal rows get equal results; an empty table gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import portions, table

#: Order of kinds among spans that start together; the first three are the base.
KINDS = ("assign", "access", "hex", "forge", "registry", "card", "iban")
BASE = KINDS[:3]


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
FORGE = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
REGISTRY = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Keywords by the kind they announce; matched in lower case, then checked by the anchored expression.
# Countries whose account numbers have this form.
COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"} | {f"gh{c}_": "forge" for c in "pousr"} | {"npm_": "registry"}
KEYWORDS |= {f"{n:02d}": "card" for n in range(100)} | {f"{c.lower()}{n}": "iban" for c in COUNTRIES for n in range(10)}
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Classes for runs: h for a hexadecimal digit in lower case.
_RUN_HEX = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))
HEX_LEAST, ASSIGN_LEAST, ACCESS_LEAST = 24, 6, 20


def crc62(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS62[r] + out
    return out


def luhn(digits: str) -> bool:
    """Whether decimal digits obey the Luhn rule."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(number: str) -> bool:
    """Whether an account number leaves 1 modulo 97 after its first four characters are moved to the end."""
    n = number.replace(" ", "")
    return 15 <= len(n) <= 34 and int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def _accept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= ASSIGN_LEAST
    if kind == "access":
        return m.end() - m.start() >= ACCESS_LEAST
    return crc62(m[1]) == m[2]


_ANCHORED = {"assign": ASSIGN, "access": ACCESS, "forge": FORGE, "registry": REGISTRY}


def _runs(classes: bytes | str, mark: str, least: int):
    """Maximal runs of `mark` of at least `least`, found by their own keyword."""
    word = mark * least
    at = classes.find(word)
    while at >= 0:
        start, end = at, at + least
        while start and classes[start - 1] == mark:
            start -= 1
        while end < len(classes) and classes[end] == mark:
            end += 1
        yield start, end
        at = classes.find(word, end)


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All secrets of a text as (kind, start, end), by start and then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    past: dict[str, int] = {}
    for last, (kind, n) in _automaton().iter(low):
        start = last - n + 1
        if start < past.get(kind, 0):
            continue
        if kind in _NUMBERS:
            past[kind] = _NUMBERS[kind](text, start, found)
        elif m := _ANCHORED[kind].match(text, start):
            past[kind] = m.end()
            if _accept(kind, m):
                found.append((kind, start, m.end()))
    flat = text.encode("latin-1", "replace")  # one byte a code point; other characters become "?", in no class
    found += [("hex", a, b) for a, b in _runs(flat.translate(_RUN_HEX).decode("latin-1"), "h", HEX_LEAST)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


_LONG_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}")
_DIGITS, _GROUPS, _PLAIN = re.compile("[0-9]+"), re.compile("[0-9](?:[ -]?[0-9])*"), frozenset("0123456789")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ A-Z0-9])")


def _cards(text: str, start: int, end: int):
    """Card numbers in a run of digit groups: from every group on, the longest row of whole groups that passes."""
    groups = [(m.start(), m[0], m.end()) for m in _DIGITS.finditer(text, start, end)]
    i = 0
    while i < len(groups):
        digits, passed = "", None
        for j in range(i, len(groups)):
            if len(digits) + len(groups[j][1]) > 19:
                break
            digits += groups[j][1]
            if len(digits) >= 13 and luhn(digits) and len(set(digits)) > 1:
                passed = j
        if passed is None:
            i += 1
        else:
            yield "card", groups[i][0], groups[passed][2]
            i = passed + 1


def _card(text: str, start: int, found: list) -> int:
    """Adds the cards of the digit groups that two digits at `start` belong to; gives where the next look may begin."""
    while start and text[start - 1] in _PLAIN or start > 1 and text[start - 1] in " -" and text[start - 2] in _PLAIN:
        start -= 1
    m = _LONG_NUMBER.match(text, start)
    if not m:
        return _GROUPS.match(text, start).end()
    found += _cards(text, m.start(), m.end())
    return m.end()


def _account(text: str, start: int, found: list) -> int:
    """Adds the account number that a country's letters at `start` open, the longest that passes; shorter ones end before a space."""
    m = IBAN.match(text, start) if _ACCOUNT.match(text, start) else None
    end = m.end() if m else start
    while end > start:
        if iban(text[start:end]):
            found.append(("iban", start, end))
            return end
        end = text.rfind(" ", start, end)
    return start + 1


_NUMBERS = {"card": _card, "iban": _account}


def _join(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan_frame(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `df`: `key`, counts of the base kinds, the digest of their spans, and all spans; only two columns are read."""

    def scan(batches):
        for b in portions(batches, 1):
            all_spans = [spans(t) for t in b.column(1).to_pylist()]
            base = [[s for s in found if s[0] in BASE] for found in all_spans]
            counts = [pa.array([sum(s[0] == k for s in found) for found in base], pa.int64()) for k in BASE]
            digests = pa.array([hashlib.sha256(_join(found).encode()).hexdigest() for found in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, pa.array([_join(s) for s in all_spans], pa.string())], [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(scan, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[{kind}]") -> str | None:
    """A text with every span replaced by its kind; of spans that overlap, the first; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in spans(text):
        if a >= at:
            out += [text[at:a], mark.format(kind=kind)]
            at = b
    return "".join([*out, text[at:]])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans every document; one scan, no shuffle."""
    return scan_frame(table(spark, sf_dir, "documents"))
