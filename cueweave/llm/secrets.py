"""Secret scan (operator 5): keyword automaton, anchored expressions only at its hits, embedded checksums.

An Aho-Corasick automaton finds every keyword of every text in one pass. Only at a hit is the expression of that
keyword tried, anchored at the hit, so the expressions never scan text. Kinds that carry a checksum or a structure
are kept only where it holds.

Defined results: a null or empty text has no span; matches of one kind never overlap, the leftmost wins, and a match
that fails its length or checksum still uses up its characters; repeated rows each get their own result; other
columns are passed by.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, query, table

# The patterns and lengths of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 8, 16

# Public formats with an embedded checksum or structure.
CHECKED = re.compile(r"(?:ghp|gho|ghu|ghs|ghr|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Keyword in lower case -> kind. The kinds stand in the order in which spans at one start are listed.
KEYWORDS = {
    **dict.fromkeys(["password", "passwd", "secret", "token", "apikey", "api_key"], "assign"),
    "akia": "access",
    **dict.fromkeys(["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"], "checked"),
    "eyj": "jwt",
    "-----begin ": "key",
}
KINDS = ["assign", "access", "hex", "checked", "jwt", "key"]
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED, "jwt": JWT, "key": PEM}


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def is_token(m: re.Match) -> bool:
    return base62_crc(m[1][:30]) == m[1][30:]


def is_jwt(m: re.Match) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def is_der(m: re.Match) -> bool:
    """The body is one DER sequence whose stated length is its length."""
    try:
        der = base64.b64decode("".join(m[2].split()), validate=True)
    except binascii.Error:
        return False
    if len(der) < 4 or der[0] != 0x30:
        return False
    long = der[1] & 0x7F if der[1] & 0x80 else 0
    return len(der) == 2 + long + (int.from_bytes(der[2 : 2 + long], "big") if long else der[1])


VALID = {
    "assign": lambda m: len(m[2]) >= ASSIGN_LENGTH,
    "access": lambda m: m.end() - m.start() >= ACCESS_LENGTH,
    "checked": is_token,
    "jwt": is_jwt,
    "key": is_der,
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def secret_spans(text: str, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered; only ASCII matters here
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    hits = sorted((end - size + 1, kind) for end, (size, kind) in keywords.iter(low))
    spans, done = [], dict.fromkeys(PATTERNS, 0)
    for at, kind in hits:
        if at >= done[kind] and (m := PATTERNS[kind].match(text, at)):
            done[kind] = m.end()
            if VALID[kind](m):
                spans.append((kind, at, m.end()))
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: ``id_column``, spans (array of kind, start, end). One pass over the table, nothing is shuffled."""
    prepare(docs.sparkSession)
    id_type = docs.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in secret_spans(t or "", keywords)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["id", "spans"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(scan, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_column)


def joined(spans, *kinds: str):
    """kind:start:end of the spans, of ``kinds`` if any are given, joined by commas."""
    if kinds:
        spans = F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


BASE = ("assign", "access", "hex")


def is_kind(kind: str):
    return lambda k: k == kind


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    kinds = F.transform(spans, lambda s: s.kind)
    counts = [F.size(F.array_remove(F.transform(kinds, is_kind(k)), False)).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(spans, *BASE), 256).alias("base_sha256"), joined(spans).alias("spans"))
