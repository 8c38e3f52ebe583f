"""Secret scan: patterns find candidates, decoding and parsing confirm the structured ones.

Base kinds are plain patterns. Beyond them, base64 and hex runs are decoded, and only what parses is reported: private
keys in DER whose nested lengths add up, OpenSSH private keys whose length-prefixed fields add up, and signed tokens
whose header is a JSON object that names an algorithm. Offsets are code points, the end exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows and null ids give a row each; an empty
table gives an empty result; other columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm._shared import map_texts

#: Base kinds first, in their fixed order, then those confirmed by structure.
KINDS = ("assign", "access", "hex", "token", "key", "openssh")
ASSIGN = re.compile(r"(?ia)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: JSON objects start with a brace and a quote or white space, hence these first letters.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_.-])")
#: Lines may be indented or quoted.
BREAK = r"(?:[\r\n]+[\x20\t>]*|\\n[\x20\t>]*)"
ENCODED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{BREAK}[A-Za-z0-9+/_-]{{16,}})*={{0,2}}")
HEXED = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
#: The last line of a wrapped encoding may be short.
LAST_LINE = re.compile(rf"{BREAK}[A-Za-z0-9+/_-]{{1,15}}={{0,2}}(?![A-Za-z0-9+/_=-])")
#: Encodings of fewer letters hold no private key.
LEAST_ENCODED = 64
Span = tuple[int, int, str]

#: Cheap necessary conditions, so that most texts never meet the slow patterns: a keyword, or a run long enough.
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
RUNS = bytes(b if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 0x20 for b in range(256))


def longest_run(text: str) -> int:
    """The longest run of letters, digits and ``+/_-`` (each ASCII)."""
    return max(map(len, text.encode().translate(RUNS).split()), default=0)


def long_run_letters(text: str) -> int:
    """The letters in runs that may be a line of an encoding."""
    return sum(n for n in map(len, text.encode().translate(RUNS).split()) if n >= 16)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, those that are too short dropped."""
    found, lowered = [], text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if longest_run(text) >= 24:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def fields(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """The DER fields (tag, start, end of content) that fill ``data[at:end]`` exactly, else None."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key: RSA or EC fields, or a wrapped key of any algorithm."""
    outer = fields(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = fields(data, *outer[0][1:])
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    tags = [f[0] for f in inner]
    if tags[1:3] == [0x30, 0x04]:  # algorithm, then the wrapped key
        algorithm = fields(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[1:2] == [0x04]:  # EC
        return data[inner[0][1]] == 1 and inner[1][2] - inner[1][1] >= 16
    return len(tags) >= 9 and tags[:9] == [0x02] * 9 or len(tags) == 6 and tags == [0x02] * 6


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: the magic, four length-prefixed fields and a key count."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for step in ("cipher", "kdf", "options", "count", "public", "private"):
        if at + 4 > len(data):
            return False
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if step == "count":
            if n != 1:
                return False
            continue
        if at + n > len(data):
            return False
        at += n
    return at == len(data)


def unbase64(text: str) -> bytes | None:
    """Decode either base64 alphabet, with or without padding; None if it can't be."""
    text = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token_header(part: str) -> bool:
    raw = unbase64(part)
    if not raw or raw[:1] != b"{":
        return False
    try:
        header = json.loads(raw)
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def confirmed_spans(text: str) -> list[Span]:
    """What decodes and parses as a key or a signed token."""
    found = []
    if "ey" in text or "ew" in text:
        found += [(m.start(), m.end(), "token") for m in SIGNED.finditer(text) if is_token_header(m[1])]
    # all but the last line, of 15 letters at most
    if long_run_letters(text) < LEAST_ENCODED - 15:
        return found
    for m in ENCODED.finditer(text):
        last = LAST_LINE.match(text, m.end())
        for end in [m.end(), last.end()] if last else [m.end()]:
            letters = re.sub(BREAK, "", text[m.start() : end])
            data = unbase64(letters) if len(letters) >= LEAST_ENCODED else None
            kind = "key" if data and is_private_key(data) else "openssh" if data and is_openssh_key(data) else None
            if kind:
                found.append((m.start(), end, kind))
                break
    for m in HEXED.finditer(text):
        data = bytes.fromhex(m[0])
        if is_private_key(data):
            found.append((m.start(), m.end(), "key"))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans``; ``spans`` lists kind:start:end by start."""

    def make(texts):
        rows = []
        for text in texts.to_pylist():
            base = base_spans(text or "")
            spans = base + (confirmed_spans(text) if text else [])
            kinds = [s[2] for s in base]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans)))
        return [list(c) for c in zip(*rows)] if rows else [[]] * 6

    return map_texts(docs, ["doc_id"], make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same columns with every span in ``text`` replaced by ``mark``; overlapping spans become one mark.

    Defined results: every row stays, repeated ones too; null and empty texts stay as they are; an empty table gives an
    empty one; extra columns may have any names.
    """

    def make(texts):
        out = []
        for text in texts.to_pylist():
            spans = sorted(base_spans(text) + confirmed_spans(text)) if text else []
            parts, at = [], 0
            for a, b, _ in spans:
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append("".join(parts) + text[at:] if parts else text)
        return [out]

    # struct, not a row of columns: extra columns may have any name
    keep = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("kept"), "text")
    return map_texts(keep, ["kept"], make, "text string").select(*[F.col("text") if c == "text" else F.col("kept").getField(c).alias(c) for c in docs.columns])
