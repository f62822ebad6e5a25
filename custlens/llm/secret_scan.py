"""Secret scans that link the parts of a credential.

Strong patterns are reported wherever they stand. Weak candidates, an account name, a random-looking string or an
endpoint, are common in harmless text; they are reported only where complementary parts stand together: an identifier
and a secret in one scope, close to each other, with the endpoints beside them. Scopes are the parts of a text between
blank lines. The parts are joined as intervals, ordered by place, so the work is in proportion to the parts.

Each document is scanned on its own, in Arrow batches; a pattern match picks the documents that need a closer look, and
nothing is shuffled.

Defined results: a missing or empty text has no spans; rows are scanned one by one, so repeated rows and repeated or
missing ids each get their own result; an empty table gives an empty result; other columns are not read. Places are code
points, the end not included.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import slices

ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Kinds in the order in which spans that start together are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "web_token", "vendor_token", "url_password", "linked_id",
         "linked_secret", "linked_endpoint")

#: The name before "://". Of one that is longer than any known scheme, its last 16 characters.
SCHEME = r"(?:(?<![a-z0-9])[a-z][a-z0-9+.-]{1,15}|(?<=[a-z0-9])[a-z0-9]{16})"

STRONG = (
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?")),
    # only at the beginning of a run of its characters, and each part takes its whole run: linear in the text
    ("web_token", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    ("vendor_token", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})")),
    ("url_password", re.compile(SCHEME + r"://[^\s:/@\"']+:[^\s:/@\"']{3,}@[A-Za-z0-9.-]+")),
)
IDENTIFIER = re.compile(
    r"(?i:(?<![a-z0-9])(?:user(?:name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|tenant_?id))"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]{3,})", re.ASCII)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    rf"(?:{SCHEME}://[^\s\"'<>]{{3,}}|(?i:(?<![a-z])(?:host(?:name)?|endpoint|server|region))"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:/_-]{3,})", re.ASCII)
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

#: What a text must hold for any span of any kind: every linked pair has an identifier.
GATE = (
    r"(?i:password|passwd|secret|token|api_?key|user|login|account|client_?id|access_?key|tenant_?id)(?i:[a-z_]*)[\"']?\x20*[:=]"
    r"|AKIA|[0-9a-f]{24}|-----BEGIN|eyJ|gh[pousr]_|xox[abprs]-|sk_live_|://[^\s@]+@"
)

#: Parts of a credential stand at most this many characters apart, unless a call says otherwise; None is the whole scope.
REACH = 300

Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    spans = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def looks_random(token: str) -> bool:
    """Letters and digits mixed, and at least 3.5 bits per character."""
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= 3.5


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of the taken ones."""
    taken = sorted(taken)
    starts, reach, most = [s for s, _, _ in taken], [], 0
    for _, _, e in taken:
        most = max(most, e)
        reach.append(most)
    kept = []
    for start, kind, end in spans:
        k = bisect_left(starts, end)  # all taken spans before k start before this one ends
        if k == 0 or reach[k - 1] <= start:
            kept.append((start, kind, end))
    return kept


def linked_spans(text: str, known: list[Span], reach: int | None = REACH) -> list[Span]:
    """Weak candidates that complement each other, or a known span, within one scope.

    ``known`` spans are parts too: an access key is an identifier, any other one a secret.
    """
    ids = [(m.start(), "linked_id", m.end()) for m in IDENTIFIER.finditer(text)]
    if not ids and not any(kind == "access" for _, kind, _ in known):
        return []
    secrets = _free([(m.start(), "linked_secret", m.end()) for m in RANDOM.finditer(text) if looks_random(m[0])], known + ids)
    ends = _free([(m.start(), "linked_endpoint", m.end()) for m in ENDPOINT.finditer(text)], known + ids + secrets)
    ids = _free(ids, known)
    breaks = [m.start() for m in SCOPE_END.finditer(text)]
    far = len(text) if reach is None else reach
    all_ids = sorted(ids + [s for s in known if s[1] == "access"])
    all_secrets = sorted(secrets + [s for s in known if s[1] != "access"])

    def near(span: Span, others: tuple[list[Span], list[int]]) -> bool:
        """Whether another span before or behind is in reach and in the same scope."""
        spans, ended = others
        k, nr = bisect_left(spans, (span[0], "", 0)), bisect_left(breaks, span[0])
        begins, ends = breaks[nr - 1] if nr else -1, breaks[nr] if nr < len(breaks) else len(text)
        before = k > 0 and ended[k - 1] > begins and span[0] - ended[k - 1] <= far
        return before or (k < len(spans) and spans[k][0] <= ends and spans[k][0] - span[2] <= far)

    def by_place(spans: list[Span]) -> tuple[list[Span], list[int]]:
        """The spans in order, and how far those up to each reach."""
        return spans, list(accumulate((e for _, _, e in spans), max))

    all_secrets, placed_ids = by_place(all_secrets), by_place(all_ids)
    out = [s for s in ids if near(s, all_secrets)] + [s for s in secrets if near(s, placed_ids)]
    pairs = by_place([s for s in all_ids if near(s, all_secrets)])
    return out + [s for s in ends if near(s, pairs)]


def scan_text(text: str, reach: int | None = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; both by start, then by kind."""
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(base_spans(text), key=order)
    strong = [(m.start(), kind, m.end()) for kind, pattern in STRONG for m in pattern.finditer(text)]
    return base, sorted(base + strong + linked_spans(text, base + strong, reach), key=order)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def _scanned(batches: Iterator[pa.RecordBatch], reach: int | None = REACH) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 8 << 20):
            texts = batch.column("text")
            n = batch.num_rows
            counts = {k: [0] * n for k in KINDS[:3]}
            sums, spans = [EMPTY] * n, [""] * n
            hits = pc.indices_nonzero(pc.match_substring_regex(texts, GATE)).to_pylist()
            for i in hits:
                base, every = scan_text(texts[i].as_py(), reach)
                for _, kind, _ in base:
                    counts[kind][i] += 1
                sums[i] = hashlib.sha256(_listed(base).encode()).hexdigest()
                spans[i] = _listed(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(sums, pa.string()),
                 pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """One row per document: counts of base spans, the digest of their list, and all spans as kind:start:end.

    ``reach`` is the distance up to which parts of a credential are linked within a scope; None links any two of a scope.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(lambda batches: _scanned(batches, reach), SCHEMA)
