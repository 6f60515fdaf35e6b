"""Secret scan: patterns, and a token-efficiency test for random strings.

Three patterns give the base spans. The method adds spans: strings that a byte-pair vocabulary needs
many tokens for (few characters per token), after known digests, UUIDs, numbers and word-like
identifiers are excluded and where no base span lies. Rows are scanned where they are: no shuffle.

Defined cases: null text is empty; an empty text has no spans; texts are scanned whole; repeated rows are
scanned each by itself; an empty table gives an empty result; other columns stay apart in `doc`.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from popgraph.llm.common import annotate

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
MAX_RATIO = 2.2
MIN_LENGTH = 20

# The base patterns, their kinds in order, least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "tokens"]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
# Fixed value: how text is cut before byte-pair merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")  # a run below the least length fails as a whole
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.IGNORECASE)
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_/+=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[_/+=-]*\Z")
_NUMBER = re.compile(r"[0-9+/_=-]+\Z")
_LETTERS = re.compile(rf"[A-Za-z]{{{MIN_LENGTH},}}")
_CAMEL = re.compile(rf"[A-Z]?[a-z]{{2,{MIN_LENGTH - 2}}}(?:[A-Z][a-z]{{2,{MIN_LENGTH - 2}}})+\Z")  # one way to match, as a failing match tries all

_encodings: dict[bytes, object] = {}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def excluded(string: str) -> bool:
    """Known digests and identifiers: they look random, or cost many tokens, but are no secrets.

    A part of MIN_LENGTH letters or more makes no identifier by its letter case: its tokens say whether it is words.
    """
    if any(p.match(string) for p in (_CAMEL, _NUMBER, _DIGEST, _UUID)):
        return True
    return bool(_IDENTIFIER.match(string)) and not _LETTERS.search(string)


def random_spans(text: str, encode, max_ratio: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of strings with at most `max_ratio` characters per token that touch no taken span."""
    out = []
    for m in _CANDIDATE.finditer(text):
        string, at, end = m[0], m.start(), m.end()
        if excluded(string) or any(s < end and at < e for s, _, e in taken):
            continue
        if len(string) <= max_ratio * len(encode(string)):
            out.append((at, 3, end))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _encoding(raw: bytes):
    """One encoder per Python worker and vocabulary."""
    import tiktoken

    key = hashlib.sha256(raw).digest()
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def scan_secrets(
    docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO, text: str = "text", hide: tuple[str, ...] = ()
) -> DataFrame:
    """(doc, n_assign, n_access, n_hex, n_random, base_spans, spans) for every row; `doc` lacks columns in `hide`.

    `vocabulary` is the path of a rank file on the driver; its bytes, at most MAX_VOCABULARY_BYTES, are
    broadcast. Spans are kind:start:end in code points, end exclusive, comma-joined.
    """
    if os.path.getsize(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def scan(batch: pa.RecordBatch) -> list[pa.Array]:
        encode = _encoding(ranks.value).encode_ordinary
        counts, bases, alls = [], [], []
        for value in batch.column(text):
            whole = value.as_py() or ""
            base = base_spans(whole)
            more = random_spans(whole, encode, max_ratio, base)
            kinds = [k for _, k, _ in base]
            counts.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more)))
            bases.append(listed(base))
            alls.append(listed(sorted(base + more)))
        columns = zip(*counts) if counts else [()] * 4
        return [*(pa.array(c, pa.int64()) for c in columns), pa.array(bases, pa.string()), pa.array(alls, pa.string())]

    long, string = T.LongType(), T.StringType()
    fields = [("n_assign", long), ("n_access", long), ("n_hex", long), ("n_random", long), ("base_spans", string), ("spans", string)]
    return annotate(docs, fields, scan, hide)
