"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions only near hits, embedded checksums."""

from __future__ import annotations

import functools
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Tokens of a prefix, 30 random characters and six that are the base-62 CRC-32 of the random part.
CHECKED = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
CHECKED_BODY = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(6, "0")


@functools.cache
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, names in {"assign": ASSIGN_WORDS, "access": ("akia",), **CHECKED}.items():
        for w in names:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start, then kind in the order of KINDS; code points, end exclusive.

    Per kind, leftmost matches that don't overlap; those too short or with a wrong checksum go afterwards. An
    expression of a keyword kind is only tried where the automaton saw its keyword begin, which is where it can match.
    Runs of hex digits hold no keyword, so their expression reads the text itself.
    """
    if not text:
        return []
    folded = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z only: positions stay
    hits: dict[str, list[tuple[int, int]]] = {}
    for end, (kind, n) in automaton().iter(folded):
        hits.setdefault(kind, []).append((end - n + 1, end + 1))
    out = [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    for kind, places in hits.items():
        k, last = KINDS.index(kind), 0
        for start, after in sorted(places):
            if start < last:
                continue
            if kind in CHECKED:
                m = CHECKED_BODY.match(text, after) if text[start:after] in CHECKED[kind] else None
                good = m and base62_crc(m[0][:30]) == m[0][30:]
            else:
                m = (ASSIGN if kind == "assign" else ACCESS).match(text, start)
                good = m and (len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= 20)
            if m:
                last = m.end()
                if good:
                    out.append((start, last, k))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


SPANS = "array<struct<start:int,end:int,kind:string>>"


def secret_spans(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    return pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(t.as_py())] for t in texts], kind)


def scan(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Adds the spans of every whole text. Null and empty texts have none; no state is kept between rows, so repeated
    rows agree, and a very long text costs time in proportion. name replaces a column of that name."""
    return docs.withColumn(name, F.arrow_udf(secret_spans, SPANS)(F.col(text)))


def op10_secret_scans(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), name="_spans").select("doc_id", "_spans")
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    joined = lambda s: F.array_join(F.transform(s, one), ",")
    base = F.filter("_spans", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
