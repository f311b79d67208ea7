"""Secret scan: keyword automaton, anchored patterns near hits, embedded checksums.

One Aho-Corasick pass over an ASCII-folded copy of a text finds every keyword; a
kind's pattern is matched only at the places its keywords point to. Kinds that embed a
check (a CRC-32 tail, base58 with a double SHA-256, a JSON header) are reported
only if that check holds. Runs of hex digits have no keyword and use a plain scan.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.llm.common import on_columns, text_or_empty

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "crctoken", "wif", "jwt")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_WIF = re.compile(r"[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![0-9A-Za-z])")
#: A run of the characters that a token's parts are made of; no token of the run can start after its end.
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_FOLD = {c: c + 32 for c in range(65, 91)}


def crc_tail(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's body."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _crc_ok(m: re.Match) -> bool:
    return crc_tail(m[1]) == m[2]


def _wif_ok(m: re.Match) -> bool:
    n = 0
    for c in m[0]:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    body, check = raw[:-4], raw[-4:]
    return len(body) in (33, 34) and body[:1] == b"\x80" and hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4] == check


def _jwt_ok(m: re.Match) -> bool:
    """Header and claims are JSON objects; one nested too deeply to be read is none."""
    try:
        for part in m[0].split(".")[:2]:
            if not isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict):
                return False
    except (ValueError, RecursionError):
        return False
    return True


#: kind -> (keywords, keyword is searched in the folded text, pattern, test of a match)
_RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), True, _ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (("AKIA",), False, _ACCESS, lambda m: len(m[0]) >= 16),
    "crctoken": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), False, _CRC_TOKEN, _crc_ok),
    "jwt": (("eyJ",), False, _JWT, _jwt_ok),
}


@cache
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    for kind, (words, folded, _, _) in _RULES.items():
        for w in words:
            found.setdefault(w.translate(_FOLD), []).append((kind, None if folded else w, len(w)))
    a = ahocorasick.Automaton()
    for w, targets in found.items():
        a.add_word(w, tuple(targets))
    a.make_automaton()
    return a


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the order of KINDS.

    Within a kind, matches are taken from the left and do not overlap; one that fails its
    length or checksum test still uses up its characters, as with a plain left-to-right scan.
    """
    spans, done = [], dict.fromkeys(KINDS, 0)
    folded = text.lower()
    if len(folded) != len(text):  # some letters lower to two; then fold A-Z alone
        folded = text.translate(_FOLD)
    for last, targets in _automaton().iter(folded):
        for kind, exact, n in targets:
            start = last - n + 1
            if start < done[kind] or exact is not None and text[start : last + 1] != exact:
                continue
            _, _, pattern, holds = _RULES[kind]
            if kind == "jwt":  # a keyword further on in a run that no second part follows cannot match either
                end = _JWT_RUN.match(text, start).end()
                if not text.startswith(".eyJ", end):
                    done[kind] = end
                    continue
            if m := pattern.match(text, start):
                done[kind] = m.end()
                if holds(m):
                    spans.append((kind, start, m.end()))
            elif kind == "jwt":  # nor can one whose second part has no third
                done[kind] = end
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    for m in _WIF.finditer(text):
        if (m.start() == 0 or not text[m.start() - 1].isalnum()) and _wif_ok(m):
            spans.append(("wif", m.start(), m.end()))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every maximal run of covered characters replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            if a > at or not out:
                out.append(text[at:a])
                out.append(mark)
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def secret_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] if t else [] for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: redact(t, s) if t and (s := scan(t)) else t)


def scan_documents(documents: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end; empty if none) for every row.

    Null and empty texts have no spans; repeated rows are scanned each; other columns are
    not read. Texts are scanned whole, in Arrow batches, without a shuffle.
    """
    return documents.select("doc_id", secret_spans(text_or_empty("text")).alias("spans"))


def redact_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with secrets replaced in ``text`` (null stays null) and ``n_chars``, if present, recounted.

    Rows without a secret and all other columns stay as they are.
    """

    def step(d: DataFrame) -> DataFrame:
        d = d.withColumn("__old", F.col("text")).withColumn("text", redacted(F.col("text")))
        if "n_chars" not in d.columns:
            return d
        changed = ~F.col("text").eqNullSafe(F.col("__old"))
        count = F.char_length("text").cast(d.schema["n_chars"].dataType)
        return d.withColumn("n_chars", F.when(changed, count).otherwise(F.col("n_chars")))

    return on_columns(documents, ("text", "n_chars"), step)


def digest(scanned: DataFrame) -> DataFrame:
    """The counts and the two span lists of the registered query."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )
