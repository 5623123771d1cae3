"""Operator 2: secrets by keyword automaton, anchored expressions and checksums.

An Aho-Corasick automaton finds every keyword in one pass over the
lower-cased text; only there is an expression matched, anchored at the hit.
Formats that embed a checksum are kept only if it holds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from punctual.llm.common import release, steps, strings

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[\w-]++)\.(eyJ[\w-]++)\.[\w-]++", re.A)
JWT_RUN = re.compile(r"[\w-]+", re.A)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# A run of 32 hexadecimal digits holds every 4 of its digits as a keyword, so no run is missed.
HEX_GRAM = 4


def crc_base62(text: str) -> str:
    """CRC-32 of ``text`` as six base-62 digits."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m.group(2)) >= 8
    if kind == "access":
        return m.end() - m.start() >= 16
    if kind in ("github", "npm"):
        return crc_base62(m.group(1)) == m.group(2)
    return _json_part(m.group(1)) and _json_part(m.group(2))


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    words: dict[str, list] = {}
    for kind, pattern, keys in (("assign", ASSIGN, ("password", "passwd", "secret", "token", "apikey", "api_key")),
                                ("access", ACCESS, ("akia",)),
                                ("github", GITHUB, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
                                ("npm", NPM, ("npm_",)), ("jwt", JWT, ("eyj",))):
        for k in keys:
            words[k] = [kind, pattern]
    for gram in product("0123456789abcdef", repeat=HEX_GRAM):
        words["".join(gram)] = ["hex", HEX]
    a = ahocorasick.Automaton()
    for k, (kind, pattern) in words.items():
        a.add_word(k, (len(k) - 1, kind, pattern))
    a.make_automaton()
    return a


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets: by start, then in the order of KINDS; offsets in code points."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so offsets stay
    hits: dict[str, list[int]] = {}
    done, out = 0, []
    for end, (back, kind, pattern) in _automaton().iter(lowered):
        start = end - back
        if kind == "hex":
            if start >= done and (m := HEX.match(text, start)):
                done = m.end()
                if done - start >= 32:
                    out.append((start, done, kind))
        else:
            hits.setdefault(kind, []).append(start)
            hits[kind + "/"] = pattern
    for kind in KINDS:
        after = 0
        for start in sorted(set(hits.get(kind, ()))):
            if start < after:
                continue
            if m := hits[kind + "/"].match(text, start):
                after = m.end()
                if _valid(kind, m):
                    out.append((start, after, kind))
            elif kind == "jwt" and (run := JWT_RUN.match(text, start)):
                after = run.end()  # what follows the run fails for every start in it
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, schema: str, row) -> DataFrame:
    """One result row per document: ``row(doc_id, text, spans)`` in the columns of ``schema``."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in steps(batches, "text"):
            rows = [row(d, t, find(t)) for d, t in zip(b.column("doc_id").to_pylist(), strings(b, "text"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[f for f, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: counts of the base kinds, their digest, and all spans.

    Null text is empty and holds none; null doc_ids and repeated rows are
    kept; a text of any length is read whole, in time linear in it; other
    columns are ignored; an empty table gives no rows.
    """

    def row(doc, text, spans):
        base = [s for s in spans if s[2] in BASE_KINDS]
        counts = [sum(s[2] == k for s in base) for k in BASE_KINDS]
        return doc, *counts, hashlib.sha256(_spans(base).encode()).hexdigest(), _spans(spans)

    return scan(docs, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", row)


def redact(text: str | None) -> str | None:
    """``text`` with every secret replaced by its kind in square brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind in find(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; all rows and columns stay.

    Null and empty texts stay as they are, repeated rows are each redacted,
    and an empty table stays empty.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in steps(batches, "text"):
            i = b.schema.get_field_index("text")
            clean = pa.array([redact(t) for t in b.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([clean if k == i else b.column(k) for k in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)
