"""Secret scans: all rules in one combined minimal automaton, one pass over the bytes of every text.

The pass reads texts from their ends, with the rules turned round, so that every state tells which rules have a match that
begins at this byte. The spans of those few places come from a second combined automaton, anchored there and read forwards: for
each rule the leftmost match, the longest one, then the next behind it. It stops where none of the rules that begin there can end
any more, so bytes are read again only where matches are. Whether a match counts is a mark of that automaton too: a rule may
name a stricter pattern for it, and a match without the mark is dropped but still uses up its characters (a short value of
``assign``, say).

Null and empty texts have no spans. Rows keep their number and order within a partition; repeated rows
are scanned like any other; other columns pass through ``redact_secrets`` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automata import Dfa
from .common import pieces, releasing, texts_of, with_columns

_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: (kind, pattern, pattern of the matches that count, letters in either case). The first three are the base kinds, in the
#: order of their rank. Lengths are part of what counts: in the pass over all bytes they would multiply the states.
#: Hexadecimal runs are the exception, as prose is full of short ones.
RULES = [
    ("assign", _KEY + r"[A-Za-z0-9+/_.=-]+", _KEY + r"[A-Za-z0-9+/_.=-]{6,}", True),
    ("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}", False),
    ("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24,}", False),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{30,}", False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}", False),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{6,}", False),
    ("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", False),
]
BASE = [kind for kind, *_ in RULES[:3]]


class Scanner:
    def __init__(self, rules=RULES):
        self.kinds = [kind for kind, *_ in rules]
        self.begins = Dfa([(p, fold) for _, p, _, fold in rules], anchored=False, backwards=True)
        self.ends = Dfa([(p, fold) for _, p, _, fold in rules] + [(c, fold) for _, _, c, fold in rules], anchored=True)

    def spans(self, texts) -> list[list[tuple[int, int, int]]]:
        """For every text (start, rank of the kind, end) in code points, in this order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for at, run in pieces(texts):
            gap = b"\xff"  # in no UTF-8 text, so it leads every state to the start
            buf = np.frombuffer(gap.join(run), np.uint8)
            where, mask = self.begins.events(np.ascontiguousarray(buf[::-1]))
            if not len(where):
                continue
            order = np.argsort(-where)
            where, mask = len(buf) - where[order], mask[order]
            size = np.fromiter(map(len, run), np.int64, len(run)) + 1
            first = np.cumsum(size) - size
            text = np.searchsorted(first, where, side="right") - 1
            cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])).tolist()
            for a, b in zip(cut, [*cut[1:], len(text)], strict=True):
                d = int(text[a])
                out[at + d] = self._resolve(run[d], (where[a:b] - first[d]).tolist(), mask[a:b].tolist())
        return out

    def _resolve(self, data: bytes, begins: list[int], masks: list[int]) -> list[tuple[int, int, int]]:
        found, free, n = [], [0] * len(self.kinds), len(self.kinds)
        for a, mask in zip(begins, masks, strict=True):
            wanted = sum(1 << k for k in range(n) if mask >> k & 1 and free[k] <= a)
            if not wanted:
                continue
            for k, (b, marks) in self.ends.longest(data, a, wanted).items():
                free[k] = b
                if marks >> (n + k) & 1:
                    found.append((a, k, b))
        if found and not data.isascii():
            point = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            found = [(int(point[a]), k, int(point[b])) for a, k, b in found]
        return sorted(found)


def _listed(spans, kinds) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: the id, counts of the base kinds, base_sha256 and all spans."""
    scanner, kind = Scanner(rules), df.schema[id_col].dataType.simpleString()

    @releasing
    def run(batches):
        for batch in batches:
            rows = []
            for spans in scanner.spans(texts_of(batch)):
                base = [s for s in spans if s[1] < len(BASE)]
                count = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                rows.append((*count, hashlib.sha256(_listed(base, scanner.kinds).encode()).hexdigest(), _listed(spans, scanner.kinds)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield with_columns(batch, ["id"], ["n_assign", "n_access", "n_hex", "base_sha256", "spans"], list(map(pa.array, zip(*rows, strict=True), kinds)))

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    out = narrow.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact_secrets(df: DataFrame, text_col: str = "text", count_col: str | None = None, mark: str = "[REDACTED]", rules=RULES) -> DataFrame:
    """The same rows and columns with every secret in the text replaced by mark; overlapping spans count as one.

    count_col, if given, is set to the new number of characters where a text changes.
    """
    scanner = Scanner(rules)

    @releasing
    def run(batches):
        for batch in batches:
            texts, changed = texts_of(batch, text_col), []
            for i, spans in enumerate(scanner.spans(texts)):
                if spans:
                    parts, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            parts += [texts[i][at:a], mark]
                        at = max(at, b)
                    texts[i] = "".join([*parts, texts[i][at:]])
                    changed.append(i)
            if changed:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns[text_col] = pa.array(texts, columns[text_col].type)
                if count_col:
                    counts = columns[count_col].to_pylist()
                    for i in changed:
                        counts[i] = len(texts[i])
                    columns[count_col] = pa.array(counts, columns[count_col].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            yield batch

    return df.mapInArrow(run, df.schema)
