"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions near hits, checksums.

One automaton over all keywords passes over each whole text, lower-cased in ASCII so that
code point offsets stay. A kind's regular expression is tried only at the places its keyword
was found, anchored there. Long hexadecimal runs have no keyword; they are found by mapping
the text to hex / other and searching for 32 hex characters in a row. Token formats that
embed a checksum are reported only if it holds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

# The base kinds with their patterns and least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_VALUE = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 16
HEX = re.compile(r"[0-9a-f]+")
HEX_CHARS = 32
# Further public token formats.
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}

#: A text may be one long run of keywords. How far a failed match that began as written also settles the keywords that
#: follow it: those of the same run of token characters end at the same place and go on in the same way. In another case
#: a keyword begins no match and settles nothing.
_SETTLES = {"jwt": re.compile(r"eyJ[A-Za-z0-9_-]*")}

_HEX_CLASS = bytes(104 if chr(c) in "0123456789abcdef" else 46 for c in range(256))
_HEX_RUN = b"h" * HEX_CHARS
_HEX_REST = re.compile(rb"h*")

Span = tuple[str, int, int]


def base62_crc32(text: str) -> str:
    """CRC-32 of text as six base-62 digits, as some token formats end with it."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _jwt_header(part: str) -> bool:
    """Whether the part is a JSON object in base64; one nested beyond what the JSON parser reads isn't a header."""
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


#: Kind: pattern, and whether a match is a secret.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_VALUE),
    "access": (ACCESS, lambda m: m.end() - m.start() >= ACCESS_CHARS),
    "github": (GITHUB, lambda m: base62_crc32(m[1]) == m[2]),
    "npm": (NPM, lambda m: base62_crc32(m[1]) == m[2]),
    "jwt": (JWT, lambda m: _jwt_header(m[1])),
    "pem": (PEM, lambda m: True),
}

_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            made.add_word(word, (len(word), kind))
        made.make_automaton()
        _automaton = made
    return _automaton


def find_spans(text: str | None) -> list[Span]:
    """All spans (kind, start, end) in code points, by start, then kind in the order of KINDS.

    Within a kind matches are leftmost and don't overlap; one that fails its length or
    checksum still uses up its characters.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    found: list[Span] = []
    after = dict.fromkeys(KINDS, 0)
    for last, (length, kind) in _keywords().iter(raw.lower().decode("utf-8", "surrogatepass")):
        start = last - length + 1
        if start < after[kind]:
            continue
        pattern, accepts = RULES[kind]
        if m := pattern.match(text, start):
            after[kind] = m.end()
            if accepts(m):
                found.append((kind, start, m.end()))
        elif kind in _SETTLES and (run := _SETTLES[kind].match(text, start)):
            after[kind] = run.end()
    classes = raw.translate(_HEX_CLASS)
    at, chars, counted = classes.find(_HEX_RUN), 0, 0
    while at >= 0:
        # A run is ASCII; the code points before it are the bytes that don't continue a character.
        end = _HEX_REST.match(classes, at + HEX_CHARS).end()
        chars += len(raw[counted:at].decode("utf-8", "surrogatepass"))
        counted = at
        found.append(("hex", chars, chars + end - at))
        at = classes.find(_HEX_RUN, end)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


REPORT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = find_spans(text.as_py())
            base = [s for s in spans if s[0] in KINDS[:3]]
            counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            rows.append((*counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], REPORT.names)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Input: doc_id, text (other columns are ignored). The counts and the digest cover the base
    kinds; spans lists all kinds as kind:start:end, comma-joined. Null and empty texts have
    no spans. Null doc_ids and repeated rows keep their rows; an empty table gives no rows.
    Nothing is shuffled.
    """
    shared.ship(docs.sparkSession)
    return shared.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_report, REPORT)


_MASKED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """text with every secret replaced, overlapping spans as one."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end in find_spans(text):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([redact(t.as_py()) for t in batch.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], _MASKED.names)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and text with the secrets replaced; null texts stay null. Other cases as for scan_secrets."""
    shared.ship(docs.sparkSession)
    return shared.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_redact, _MASKED)
