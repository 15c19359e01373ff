"""Secrets in texts: a keyword automaton proposes places, anchored patterns look only there, checksums confirm."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans with the same start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "key_block")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
_TOKEN = re.compile(r"[A-Za-z0-9_-]+")
_BLOCK = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Keywords in lower case, and the kind whose pattern is tried where one stands.
_KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign", "akia": "access", "npm_": "npm", "eyj": "jwt", "-----begin ": "key_block"} | {f"gh{x}_": "github" for x in "pousr"}
_PATTERNS = {"assign": _ASSIGN, "access": _ACCESS, "github": _GITHUB, "npm": _NPM, "jwt": _JWT, "key_block": _BLOCK}


def _automaton():
    # Imported where it is used, in tasks: what never scans for secrets works without it.
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        made.add_word(word, (len(word), kind))
    made.make_automaton()
    return made


_FOUND = None


def crc_digits(body: str) -> str:
    """CRC-32 of body in six base-62 digits, as such tokens end with."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    if kind in ("github", "npm"):
        return crc_digits(m[1]) == m[2]
    if kind == "jwt":
        return _json_part(m[1]) and _json_part(m[2])
    body = "".join(m[2].split())
    try:
        return len(base64.b64decode(body, validate=True)) >= 16
    except ValueError:
        return False


def secret_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind.

    Per kind the leftmost non-overlapping matches count, as if the pattern ran over the text from its start; a match
    that fails its length or checksum is dropped but still covers its characters. Only A-Z are lower-cased for
    the keywords, byte by byte, so offsets stay true in any script. Hex runs have no keyword; their one character
    class is scanned for directly. The time is linear in the length of the text: bytes are mapped to code points once,
    and a run of characters in which no web token began is not tried again.
    """
    global _FOUND
    if not text:
        return []
    _FOUND = _FOUND or _automaton()
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower().decode("latin-1")
    spans, last = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)], dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in _FOUND.iter(lower))
    if len(raw) != len(text) and hits:
        # Code points that begin before each byte of a hit.
        begins = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        at = np.array([h[0] for h in hits])
        hits = list(zip((begins[at] - 1).tolist(), (h[1] for h in hits), strict=True))
    barren = 0
    for start, kind in hits:
        if start < last[kind] or kind == "jwt" and start < barren:
            continue
        if m := _PATTERNS[kind].match(text, start):
            last[kind] = m.end()
            if _valid(kind, m):
                spans.append((m.start(), m.end(), kind))
        elif kind == "jwt" and (run := _TOKEN.match(text, start)):
            barren = run.end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Every span, or run of overlapping spans, is replaced by [SECRET:kind of its first]."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"[SECRET:{kind}]"]
        at = end
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
        found, clean = [], []
        for x in texts:
            text = x.as_py()
            s = secret_spans(text)
            found.append([{"start": a, "end": b, "kind": k} for a, b, k in s])
            clean.append(redact(text, s) if s else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(_SPAN)), pa.array(clean, pa.string())], names=[*batch.schema.names[:-1], "spans", "redacted"])


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs, spans array<struct<start, end, kind>> and redacted (null where no span was found).

    A narrow operation: rows are neither moved nor grouped, whole texts are scanned whatever their length, repeated
    rows are scanned each. Null or empty text has no spans. Other columns of docs are not read.
    """
    src = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
    return src.mapInArrow(_scan, T.StructType([*src.schema.fields[:-1], T.StructField("spans", T.ArrayType(span)), T.StructField("redacted", T.StringType())]))


def span_list(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans, comma-joined in order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of the base spans and all spans as text."""
    found = scan_secrets(docs)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(span_list(F.col("spans"), KINDS[:3]), 256)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base.alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
