"""Secret scans with a trigram index.

Each rule's pattern is turned into a Boolean query of trigrams that every match
must hold. Documents are indexed batch by batch, each batch a segment with its
own postings; a rule's query intersects and unites postings, and only the
documents that remain are searched with the pattern. A rule without mandatory
trigrams searches every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as c
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import texts
from factorloom.llm.tokens import small_parts


@dataclass(frozen=True)
class Rule:
    """A kind of secret; of the matches of `pattern`, those stay whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1


#: The rules that every scan has, in the order in which spans that start together are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 24),
)

#: More kinds of well-known credentials; all of them have mandatory trigrams.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("url_login", r"(?:https|http|ftp|postgres|mysql)://[A-Za-z0-9._-]+:[^\s:@/]{3,}@"),
)

# A query is None (all documents), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


def _both(op: str, parts: list[Query]) -> Query:
    if op == "or" and (None in parts or not parts):
        return None
    flat = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not flat else flat[0] if len(flat) == 1 else (op, tuple(flat))


def _strings(node: tuple) -> list[str] | None:
    """The few strings that a node can match, in lower case; None if they are many or unknown."""
    op, arg = node
    if op is c.LITERAL:
        return [chr(arg).lower()]
    if op is c.IN and len(arg) <= 8 and all(k is c.LITERAL for k, _ in arg):
        return sorted({chr(x).lower() for _, x in arg})
    if op is c.SUBPATTERN:
        return _joined(arg[3])
    if op is c.BRANCH:
        each = [_joined(b) for b in arg[1]]
        return None if None in each else sorted({x for e in each for x in e})
    if op is c.MAX_REPEAT and arg[1] != c.MAXREPEAT and arg[1] <= 2 and (one := _joined(arg[2])) is not None:
        every, now = [], [""]
        for k in range(arg[1] + 1):
            every += now if k >= arg[0] else []
            now = [a + b for a in now for b in one]
        return every if len(every) <= 32 else None
    return None


def _joined(nodes: object) -> list[str] | None:
    out = [""]
    for n in nodes:
        if (s := _strings(n)) is None or len(out) * len(s) > 32:
            return None
        out = [a + b for a in out for b in s]
    return out


def _of_strings(strings: list[str]) -> Query:
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """A query, over lower-case trigrams of ASCII characters, that holds in every text with a match."""

    def of(nodes: object) -> Query:
        parts: list[Query] = []
        run = [""]
        for n in nodes:
            s = _strings(n)
            if s is not None and len(run) * len(s) <= 32 and all(x.isascii() for x in s):
                run = [a + b for a in run for b in s]
                continue
            parts.append(_of_strings(run))
            run = [""]
            op, arg = n
            if op is c.SUBPATTERN:
                parts.append(of(arg[3]))
            elif op is c.BRANCH:
                parts.append(_both("or", [of(b) for b in arg[1]]))
            elif op is c.MAX_REPEAT and arg[0] > 0:
                parts.append(of(arg[2]))
        return _both("and", [*parts, _of_strings(run)])

    return of(_parser.parse(pattern, flags))


class TrigramIndex:
    """Postings of one batch of texts: for each trigram of `wanted`, the ordinals of the texts that hold it, in order."""

    def __init__(self, texts: list[str], wanted: list[str]):
        self.size = len(texts)
        lookup = np.full(1 << 24, -1, np.int16) if not hasattr(TrigramIndex, "_lookup") else TrigramIndex._lookup
        TrigramIndex._lookup = lookup
        codes = [int.from_bytes(t.encode(), "big") for t in wanted]
        lookup[codes] = np.arange(len(codes))
        lists: list[list[int]] = [[] for _ in wanted]
        for k, text in enumerate(texts):
            b = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)  # of bytes: ASCII letters alone change
            for start in range(0, max(len(b) - 2, 0), 1 << 20):
                x = b[start : start + (1 << 20) + 2].astype(np.int32)
                got = lookup[(x[:-2] << 16) | (x[1:-1] << 8) | x[2:]]
                for i in np.unique(got[got >= 0]).tolist():
                    if not lists[i] or lists[i][-1] != k:
                        lists[i].append(k)
        lookup[codes] = -1
        self.postings = {t: np.array(p, np.int64) for t, p in zip(wanted, lists, strict=True)}

    def find(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        op, parts = query
        found = [self.find(p) for p in parts]
        join: Callable = np.intersect1d if op == "and" else np.union1d
        out = found[0]
        for f in found[1:]:
            out = join(out, f)
        return out


def trigrams_of(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def spans_of(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Start and end (code points, end exclusive) of the matches that stay, leftmost first and without overlaps."""
    if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1 and rule.pattern.startswith("["):
        # Runs of one class: the longest runs are the matches, so shorter ones need not be made.
        return [m.span() for m in re.finditer(f"{rule.pattern[:-1]}{{{rule.least},}}", text, rule.flags)]
    return [m.span() for m in re.finditer(rule.pattern, text, rule.flags) if len(m[rule.group]) >= rule.least]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Per document doc_id and `spans`, an array of (kind, start, end) ordered by start, then by the rules' order.

    Null texts count as empty; empty texts have no spans. Rows repeated with
    their doc_id, and rows without one, are scanned each time. An empty table gives
    no rows; columns beyond doc_id and text are not read.
    """
    queries = {r.kind: trigram_query(r.pattern, r.flags) for r in rules}
    wanted = sorted(set().union(*map(trigrams_of, queries.values())))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_parts(batches, 256):
            held = b.column("text").to_pylist()
            index = TrigramIndex(held, wanted)
            found: list[list[tuple]] = [[] for _ in held]
            for n, rule in enumerate(rules):
                for k in index.find(queries[rule.kind]).tolist():
                    found[k] += [(s, n, e) for s, e in spans_of(held[k], rule)]
            spans = [[{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def secret_digests(docs: DataFrame) -> DataFrame:
    """The scan as counts and digests: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r.kind for r in BASE_RULES]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs).select(
        "doc_id", *map(count, base), F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )


