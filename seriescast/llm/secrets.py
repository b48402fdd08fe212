"""Secrets in text: fixed patterns, and strings that a tokenizer can hardly compress.

Words and identifiers take few tokens for their length, random strings many.  Runs of key characters whose
characters per token fall below a threshold are reported, unless they are digests of a usual length, UUIDs,
numbers, or words and numbers between separators.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seriescast.llm.bytebpe import load
from seriescast.llm.registry import query, table, texts

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is the whole run
KINDS = ("assign", "access", "hex", "random")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SEPARATORS = re.compile(r"[-_/+=]+")
NUMBERED = re.compile(r"[A-Za-z]{0,3}[0-9]+")  # v2, rc1, 2024
#: Of random lower-case keys of 16 letters, one in nine takes a token for exactly two characters or more.
LETTERS_PER_TOKEN = 2.05
Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping within a kind; failing ones dropped."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_known(s: str) -> bool:
    """Digests, UUIDs, and numbers with their separators."""
    if HEX_ONLY.fullmatch(s) and len(s) in DIGEST_LENGTHS or UUID.fullmatch(s):
        return True
    return not any(c.isalpha() for c in s)


def is_identifier(s: str, bpe, chars_per_token: float) -> bool:
    """Numbers, such as dates and versions, between words that the tokenizer compresses."""
    parts = [p for p in SEPARATORS.split(s) if p]
    rest = [p for p in parts if not NUMBERED.fullmatch(p)]
    return len(rest) < len(parts) and all(len(p) >= chars_per_token * len(bpe.ids(p)) for p in rest)


def random_spans(text: str, bpe, base: list[Span], chars_per_token: float,
                 letters_per_token: float = LETTERS_PER_TOKEN) -> list[Span]:
    """Key-like runs outside ``base`` that take a token for fewer than ``chars_per_token`` characters.

    Runs of letters alone, which the tokenizer was made for, are held against ``letters_per_token`` if that is more.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        s = m[0].strip("=-_/+")
        if len(s) < 16 or is_known(s) or any(a < m.end() and m.start() < e for a, _, e in base):
            continue
        ratio = max(chars_per_token, letters_per_token) if s.isalpha() else chars_per_token
        if len(s) < ratio * len(bpe.ids(s)) and not is_identifier(s, bpe, chars_per_token):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def _scan(tokenizer: str, chars_per_token: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in batches:
            counts, shas, spans = [[], [], [], []], [], []
            for t in b.column("text"):
                text = t.as_py()
                base = base_spans(text)
                every = sorted(base + random_spans(text, bpe, base, chars_per_token))
                for k, n in enumerate(counts):
                    n.append(sum(x[1] == k for x in every))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(shas), pa.array(spans)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", chars_per_token: float = 2.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each row.

    Spans are kind:start:end in code points.  A null or empty text has none; repeated rows and null ids each
    give their row; other columns are ignored.
    """
    return texts(docs).mapInArrow(_scan(tokenizer, chars_per_token), SCHEMA)


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
