"""Secret scans by a trigram inverted index.

Each rule's pattern is turned into a Boolean query over the byte trigrams that
any match must hold (A-Z folded). A batch of texts gets posting lists for the
trigrams that the queries name, the lists are intersected and joined as the
query says, and only the candidates left are searched with the pattern. A rule
whose pattern forces no trigram has the query "anything" and scans every text.

Null texts are empty and have no spans; the same holds for empty texts. Spans
are code points, end exclusive; repeated rows give repeated results; columns of
the input other than doc_id and text do not matter.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_text, slices



@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to search and which matches stay.

    ``search``, where given, finds the spans of the pattern's leftmost matches in another
    way, for patterns that a plain search may go through a text for at every place.
    """

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool]
    any_case: bool = False
    search: Callable[[str], Iterator[tuple[int, int]]] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def finder(self) -> Callable[[str], Iterator[tuple[int, int]]]:
        """A function that gives the spans in a text."""
        if self.search is not None:
            return self.search
        compiled = self.compiled()
        return lambda text: ((m.start(), m.end()) for m in compiled.finditer(text) if self.keep(m))


_PARTS = re.compile(r"[A-Za-z0-9_.-]+", re.ASCII)


def _tokens_of_three(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``eyJ`` and eight letters or more, a dot, eight or more, a dot, eight or more: part by part of what dots divide.

    In a part only the first ``eyJ`` has to be looked at, as the rest of the part is longest there.
    """
    for chain in _PARTS.finditer(text):
        parts = chain[0].split(".")
        starts = [chain.start()]
        for p in parts:
            starts.append(starts[-1] + len(p) + 1)
        i = 0
        while i + 2 < len(parts):
            at = parts[i].find("eyJ")
            if at >= 0 and len(parts[i]) - at >= 11 and len(parts[i + 1]) >= 8 and len(parts[i + 2]) >= 8:
                yield starts[i] + at, starts[i + 2] + len(parts[i + 2])
                i += 2
            i += 1


# The three base kinds, then kinds added to them.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: m.end(2) - m.start(2) >= 12,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]{16,}", lambda m: True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", lambda m: True),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", lambda m: True),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", lambda m: True),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda m: True, search=_tokens_of_three),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: True),
)
BASE = ("assign", "access", "hex")

# A trigram query: True (anything), a trigram (bytes), or ("and"|"or", parts).
Query = object


def _both(parts: list) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _either(parts: list) -> Query:
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _of_strings(strings: set[str]) -> Query:
    def one(s: str) -> Query:
        b = s.lower().encode()
        return _both([b[i : i + 3] for i in range(len(b) - 2)])

    return _either([one(s) for s in sorted(strings)])


_MOST = 64


def _analyse(tree) -> tuple[set[str] | None, Query]:
    """(every string that the node can match, if they are few; what any match of it forces)."""
    exact: set[str] | None = {""}
    forced: list = []

    def close(strings: set[str] | None) -> None:
        if strings:
            forced.append(_of_strings(strings))

    for op, arg in tree:
        if op is sre.LITERAL and arg < 128:
            node: tuple[set[str] | None, Query] = ({chr(arg)}, True)
        elif op is sre.IN and all(k is sre.LITERAL and v < 128 for k, v in arg):
            node = ({chr(v) for _, v in arg}, True)
        elif op is sre.SUBPATTERN:
            node = _analyse(arg[-1])
        elif op is sre.BRANCH:
            sides = [_analyse(x) for x in arg[1]]
            if all(s[0] is not None for s in sides):
                node = (set().union(*(s[0] for s in sides)), True)
            else:
                node = (None, _either([_both([s[1], _of_strings(s[0]) if s[0] else True]) for s in sides]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner = _analyse(body)
            if (low, high) == (0, 1) and inner[0] is not None:
                node = (inner[0] | {""}, True)
            elif low == 0:
                node = (None, True)
            else:
                node = (None, _both([inner[1], _of_strings(inner[0]) if inner[0] else True]))
        else:
            node = (None, True)
        if node[1] is not True:
            forced.append(node[1])
        if exact is not None and node[0] is not None and len(exact) * len(node[0]) <= _MOST:
            exact = {a + b for a in exact for b in node[0]}
        else:
            close(exact)
            exact = node[0]
    if forced:
        close(exact)
        return None, _both(forced)
    return exact, True


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match satisfies; True if the pattern forces none."""
    exact, forced = _analyse(sre_parse.parse(pattern))
    return _both([forced, _of_strings(exact) if exact else True])


def _leaves(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_leaves, query[1]))


class TrigramIndex:
    """Posting lists of a batch of texts for the trigrams that some queries name."""

    def __init__(self, queries: list[Query]):
        self.grams = sorted(set().union(*map(_leaves, queries)) if queries else ())
        self.number = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(self.grams):
            self.number[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32
        self.rows = 0
        self.postings: dict[bytes, np.ndarray] = {}

    def index(self, data: np.ndarray, ends: np.ndarray) -> None:
        """``data``: the texts' bytes end to end; text i ends before ends[i]."""
        low, self.rows = self.fold[data], len(ends)
        self.postings = {g: np.zeros(0, np.int64) for g in self.grams}
        if len(low) < 3 or not self.grams:
            return
        found = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        row = np.searchsorted(ends, at, side="right")
        at, row, kind = at[at + 3 <= ends[row]], row[at + 3 <= ends[row]], found[at[at + 3 <= ends[row]]]
        pairs = np.unique(kind.astype(np.int64) * self.rows + row)
        kinds, rows = pairs // self.rows, pairs % self.rows
        edges = np.searchsorted(kinds, np.arange(1, len(self.grams) + 2))
        for i, g in enumerate(self.grams):
            self.postings[g] = rows[edges[i] : edges[i + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = sorted((self.candidates(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def scan_batches(batches: Iterator[pa.RecordBatch], rules=RULES) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int]]]]]:
    """For each slice: (the slice, for each row its spans (start, rule number, end) by start, then rule)."""
    searched = [(r.finder(), trigram_query(r.pattern)) for r in rules]
    index = TrigramIndex([q for _, q in searched])
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        raw = [t.encode() for t in texts]
        index.index(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(b) for b in raw]))
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (find, query) in enumerate(searched):
            for row in index.candidates(query).tolist():
                found = [(start, k, end) for start, end in find(texts[row])]
                if found:
                    spans[row] += found
        for s in spans:
            s.sort()
        yield batch, spans


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row a document: doc_id and spans, an array of (kind, start, end)."""

    def run(batches):
        for batch, spans in scan_batches(batches, rules):
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return id_text(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row a document: counts of the base kinds, a digest of their spans, and all spans as text."""

    def run(batches):
        for batch, spans in scan_batches(batches, rules):
            counts = [[sum(rules[k].kind == b for _, k, _ in s) for s in spans] for b in BASE]
            said = [[f"{rules[k].kind}:{a}:{b}" for a, k, b in s] for s in spans]
            base = [",".join(x for x in row if x.partition(":")[0] in BASE) for row in said]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]),
                    pa.array([",".join(x) for x in said]),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacted(text: str, spans: list[tuple[int, int, int]], rules) -> str:
    out, done = [], 0
    for start, kind, end in spans:
        if end > done:
            out += [text[done : max(start, done)], f"<{rules[kind].kind}>" if start >= done else ""]
            done = end
    return "".join(out) + text[done:]


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """The same rows and columns, every span in text replaced by its kind in angle brackets; n_chars, if there, follows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)
    at = docs.columns.index("text")

    def run(batches):
        for batch, spans in scan_batches((b for b in nulls_kept(batches)), rules):
            texts = batch.column("text").to_pylist()
            new = [_redacted(t, s, rules) if s else t for t, s in zip(texts, spans, strict=True)]
            null = batch.column("__null").to_pylist()
            new = [None if z else t for t, z in zip(new, null, strict=True)]
            columns = [batch.column(n) for n in schema.names]
            columns[at] = pa.array(new, schema.field(at).type)
            if "n_chars" in schema.names:
                i = schema.names.index("n_chars")
                old = columns[i].to_pylist()
                columns[i] = pa.array([len(t) if s and t is not None else o for t, s, o in zip(new, spans, old, strict=True)], schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, docs.schema)


def nulls_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Null texts made empty, and marked so in a column __null."""
    import pyarrow.compute as pc

    for b in batches:
        i = b.schema.names.index("text")
        null = pc.is_null(b.column(i))
        names = [*b.schema.names, "__null"]
        columns = [*b.columns, null]
        columns[i] = pc.fill_null(b.column(i), "")
        yield pa.RecordBatch.from_arrays(columns, names=names)
