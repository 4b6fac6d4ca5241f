"""Secret scans: an Aho-Corasick automaton finds keywords, regular expressions are tried only at its hits, and kinds that carry a
checksum are kept only if it is right.

Base kinds: assign, access, hex. Kinds with a checksum: git_token and npm_token (CRC32 in base 62), age_key (bech32),
xprv (double SHA-256 in base 58). Hex runs have no keyword; a scan for 24 hex digits stands in for it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm.common import batch

KINDS = ("assign", "access", "hex", "git_token", "npm_token", "age_key", "xprv")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GIT = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_AGE = re.compile(r"(?:AGE-SECRET-KEY-1[A-Z0-9]{58}|age-secret-key-1[a-z0-9]{58})(?![A-Za-z0-9])")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
#: The digits of base 62 and base 58, and those of bech32 with its generator.
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_B32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_tail(body: str) -> str:
    """The last six digits of a git or npm token: CRC32 of the 30 before them, in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _B62[d] + out
    return out.rjust(6, "0")


def _crc_right(found: str) -> bool:
    body = found.partition("_")[2]
    return crc_tail(body[:-6]) == body[-6:]


def _polymod(values: list[int]) -> int:
    """The checksum of bech32: a cyclic code over 5-bit values."""
    state = 1
    for v in values:
        high, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(_GENERATOR):
            state ^= g * (high >> i & 1)
    return state


def _bech32_values(text: str) -> list[int]:
    head, _, data = text.lower().rpartition("1")
    return [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [_B32.find(c) for c in data]


def _age_right(found: str) -> bool:
    values = _bech32_values(found)
    return -1 not in values and _polymod(values) == 1


def _xprv_right(found: str) -> bool:
    n = 0
    for c in found:
        n = n * 58 + _B58.index(c)
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: kind, pattern, keywords in lower case, what a match must pass.
_RULES = (
    ("assign", _ASSIGN, ("password", "passwd", "secret", "token", "apikey", "api_key"), lambda m: len(m[1]) >= 6),
    ("access", _ACCESS, ("akia",), lambda m: len(m[0]) >= 20),
    ("git_token", _GIT, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), lambda m: _crc_right(m[0])),
    ("npm_token", _NPM, ("npm_",), lambda m: _crc_right(m[0])),
    ("age_key", _AGE, ("age-secret-key-1",), lambda m: _age_right(m[0])),
    ("xprv", _XPRV, ("xprv",), lambda m: _xprv_right(m[0])),
)


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for rule, (_, _, words, _) in enumerate(_RULES):
        for w in words:
            out.add_word(w, (rule, len(w)))
    out.make_automaton()
    return out


_MADE: list[ahocorasick.Automaton] = []


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind; leftmost, not overlapping within a kind."""
    if not _MADE:
        _MADE.append(_automaton())
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[int, set[int]] = {}
    for last, (rule, n) in _MADE[0].iter(low):
        hits.setdefault(rule, set()).add(last + 1 - n)
    found = [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    for rule, starts in hits.items():
        kind, pattern, _, passes = _RULES[rule]
        end = 0
        for at in sorted(starts):
            if at >= end and (m := pattern.match(text, at)):
                end = m.end()
                if passes(m):
                    found.append((at, kind, end))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_checked", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_OUT_DDL = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        spans = [find_secrets(t or "") for t in rows["text"].to_pylist()]
        count = lambda *kinds: [sum(s[1] in kinds for s in found) for found in spans]
        yield batch(
            _OUT,
            doc_id=rows["doc_id"],
            n_assign=count("assign"),
            n_access=count("access"),
            n_hex=count("hex"),
            n_checked=count(*KINDS[3:]),
            base_sha256=[hashlib.sha256(joined([s for s in found if s[1] in BASE]).encode()).hexdigest() for found in spans],
            spans=[joined(found) for found in spans],
        )


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans.

    spans: kind:start:end in code points (end exclusive), by start and kind, joined by commas. Null texts count as
    empty and have no spans; repeated rows are scanned alike. Other columns are ignored; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _OUT_DDL)
