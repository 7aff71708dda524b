"""Secret scan with multipart credential linking.

Strong findings (base spans) come from three patterns.  Beyond them the text is
searched for parts of credentials: access identifiers, secrets and endpoints.
Parts are joined by interval: two parts are linked when the gap between their
spans is at most ``GAP`` code points and no blank line stands between them (the
scope).  A weak candidate, which alone proves nothing, is reported only when
parts of complementary kinds occur with it in its scope:

* a weak secret needs an identifier or a base access key,
* an identifier needs a secret (weak or base),
* an endpoint needs an identifier as well as a secret.

Defined results: null counts as empty; an empty text gives no spans and the hash
of the empty string; overlapping base spans of different kinds all stay;
repeated rows, and rows with null or repeated ids, are each scanned; spans that
start together come in the order of ``KINDS``; an empty table gives an empty
result; other columns are not read.  A text of any length is scanned whole, in
work linear in its length plus n log n in the number of its parts.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from postroom.llm.common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 characters or more
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Order of the kinds among spans that start together.
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
RANK = {k: i for i, k in enumerate(KINDS)}

IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id|tenant)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.A | re.I)
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+]{1,11}://[A-Za-z0-9.-]+(?::\d{1,5})?|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/-]{4,})""", re.A)
WEAK = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/=_-])")
GAP = 240  # code points between linked parts


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], RANK[s[2]]))


def scopes(text: str) -> list[int]:
    """Starts of the blocks between blank lines."""
    return [0, *(m.end() for m in re.finditer(r"\n[ \t]*\n", text))]


class _Parts:
    """The spans of one role, to be asked whether one lies near a span."""

    def __init__(self, spans: list[tuple[int, int]], starts: list[int]):
        self.by_scope: dict[int, list[tuple[int, int]]] = {}
        self.reach: dict[int, list[int]] = {}
        for s, e in sorted(spans):
            self.by_scope.setdefault(bisect.bisect_right(starts, s), []).append((s, e))
        for k, own in self.by_scope.items():
            ends, most = [], -1
            for _, e in own:
                most = max(most, e)
                ends.append(most)
            self.reach[k] = ends

    def near(self, span: tuple[int, int], starts: list[int], gap: int) -> bool:
        """Whether some other span of the same scope is at most ``gap`` away."""
        k = bisect.bisect_right(starts, span[0])
        own = self.by_scope.get(k)
        if not own:
            return False
        i = bisect.bisect_right(own, (span[1] + gap, 1 << 60))  # those that start in time
        if not i:
            return False
        if own[i - 1] != span:
            return self.reach[k][i - 1] >= span[0] - gap
        return i > 1 and self.reach[k][i - 2] >= span[0] - gap


def linked_spans(text: str, base: list[tuple[int, int, str]], gap: int = GAP) -> list[tuple[int, int, str]]:
    """Weak parts that complementary parts of their scope confirm."""
    ids = [m.span() for m in IDENTIFIER.finditer(text)]
    strong = [(s, e) for s, e, k in base if k != "access"]
    keys = [(s, e) for s, e, k in base if k == "access"]
    if not ids and not keys:
        return []
    covered = sorted((s, e) for s, e, _ in base)
    ends = list(itertools.accumulate((e for _, e in covered), max))
    weak = []
    for m in WEAK.finditer(text):
        i = bisect.bisect_left(covered, (m.end(), -1))
        if not i or ends[i - 1] <= m.start():
            weak.append(m.span())
    if not weak and not strong:
        return []
    starts = scopes(text)
    near_ids, near_secrets = _Parts(ids + keys, starts), _Parts(strong + weak, starts)
    out = [(*s, "weak_secret") for s in weak if near_ids.near(s, starts, gap)]
    out += [(*s, "identifier") for s in ids if near_secrets.near(s, starts, gap)]
    for m in ENDPOINT.finditer(text):
        if near_ids.near(m.span(), starts, gap) and near_secrets.near(m.span(), starts, gap):
            out.append((*m.span(), "endpoint"))
    return out


def find_spans(text: str | None, gap: int = GAP) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted([*base, *linked_spans(text, base, gap)], key=lambda s: (s[0], RANK[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_linked bigint, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """One row per document with its findings; ``spans`` lists kind:start:end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = find_spans(text, gap)
                kinds = [k for *_, k in base]
                rows.append((doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
