"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

P(w | u v) mixes the relative frequencies of the trigram, the bigram and the word with a smoothed unigram:
``l3 * f3 + (1 - l3) * (l2 * f2 + (1 - l2) * (l1 * f1 + (1 - l1) * base))``. ``l3`` and ``l2`` depend on the bucket of the context's
frequency (0 to 4 one by one, then powers of two); a context that was never seen gets no weight. The weights are
learned by expectation-maximisation on held-out counts: one in ``HELD_OUT`` groups of training documents is deleted, its tokens are
predicted with the counts of the others alone. Scores then use the counts of all training documents. A text ends in
an end token; it begins after start marks.

Counts are exact and cover all training documents. Documents are dealt to groups of ``GROUP_CHARS`` by hash. A group sends
each of its distinct n-grams once, with its count, to the n-gram's bucket, so that frequent n-grams cost one entry a
group; the bucket adds up and answers each group with the totals in the order of the hashes, so answers carry no
keys. The group then scores its texts by look-up. With more than 2**``FAN_BITS`` groups, n-grams go up through several levels of
buckets, each of which adds up so many blocks of groups and looks at so many more bits of the hash, and answers come down the
same way: what one task holds is of the size of a group at every size of the input. The driver sees a few sums and a
histogram of bounded size. N-grams are told apart by ``BODY_BITS`` of hash and the bits of the bucket.

Null counts as the empty text, which is an end token. Without training tokens all counts are 0. Repeated rows
are counted one by one and each gets its score; those of one id and text share a group, where they are one row with a number. Null ids form a fold of their own (that of the empty string) and stay null.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, fold, mix64, releasing, releasing_group, stored, word_hashes

HELD_OUT, ADD, LEVELS, EM_ROUNDS = 10, 0.1, 24, 40
ORDER = 3
GROUP_CHARS, FAN_BITS, BODY_BITS = 6_000_000, 10, 38
#: Held-out tokens that a level's weight is worth before it has seen any.
PRIOR = 2.0
_END, _START = np.uint64(0xA5A5_5A5A_0F0F_1234), np.uint64(0x1357_9BDF_0246_8ACE)
_K = np.uint64(0x9E3779B97F4A7C15)
_REQUEST = "up long, pre long, blk long, grams binary, counts binary, held binary"
_ANSWER = "blk long, pre long, totals binary, kept binary, tokens long, distinct long, kept_tokens long"


def _joined(times: Counter) -> bytes:
    """Documents (id, flags, text) and how often each occurs, as bytes."""
    ids, flags, texts = zip(*times, strict=True)
    numbers = [np.array(x, np.int64).tobytes() for x in ([len(times)], ids, [len(t) for t in texts], list(times.values()))]
    return b"".join([*numbers, bytes(flags), *texts])


def _documents(data: bytes) -> Counter:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, size, times = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
    flags, ends = data[8 + 24 * n : 8 + 25 * n], 8 + 25 * n + np.cumsum(size)
    out: Counter = Counter()
    for i, flag, a, b, k in zip(ids.tolist(), flags, (ends - size).tolist(), ends.tolist(), times.tolist(), strict=True):
        out[i, flag, data[a:b]] += k
    return out


def _packed(docs: DataFrame, groups: int) -> DataFrame:
    """group and a compressed batch of its documents."""

    @releasing
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            f = pa.Table.from_batches([batch]).sort_by("group")
            if not len(f):
                continue
            group, ids = f["group"].to_numpy(), f["doc_id"].combine_chunks()
            flags = f["held"].to_numpy().astype(np.uint8) | (ids.is_null().to_numpy(False).astype(np.uint8) << 1)
            ids, texts = ids.fill_null(0).to_numpy(False), [encode(t) for t in f["text"].to_pylist()]
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            rows = []
            for a, b in zip(at, [*at[1:], len(group)], strict=True):
                times = Counter(zip(ids[a:b].tolist(), flags[a:b].tolist(), texts[a:b], strict=True))
                rows.append(press.compress(_joined(times)))
            yield pa.record_batch({"group": pa.array(group[at], pa.int64()), "docs": pa.array(rows, pa.binary())})

    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.select("*", key.alias("group"), (fold() == 0).alias("held")).mapInArrow(run, "group long, docs binary")


class Group:
    """The tokens of a group's distinct documents, how often each occurs, and their distinct n-grams, as numbers of total + BODY_BITS bits and two of the order."""

    def __init__(self, blobs, total_bits: int):
        times: Counter = Counter()
        for blob in blobs:
            times.update(_documents(zstandard.ZstdDecompressor().decompress(blob)))
        ids, flags, texts = zip(*times, strict=True)
        self.ids, self.times = np.array(ids, np.int64), np.array(list(times.values()), np.int64)
        self.held, self.no_id = ((np.array(flags, np.uint8) & bit).astype(bool) for bit in (1, 2))
        words, first = word_hashes(list(texts))
        n = np.diff(first)
        self.first = np.concatenate([[0], np.cumsum(n + 1)])
        token = np.empty(self.first[-1], np.uint64)
        inner = np.ones(len(token), bool)
        inner[self.first[1:] - 1] = False
        token[inner] = words[: first[-1]]
        token[~inner] = _END
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        place = np.arange(len(token)) - self.first[self.doc]
        self.at_start = place == 0
        shift = np.uint64(64 - total_bits - BODY_BITS)
        grams, h = [np.zeros(1, np.uint64)], token
        for k in range(1, ORDER + 1):
            if k > 1:
                before = np.full(len(token), _START)
                before[k - 1 :] = token[: len(token) - k + 1]
                h = mix64(h * _K + np.where(place >= k - 1, before, _START) + np.uint64(k))
            grams.append(((mix64(h) >> shift) << np.uint64(2)) | np.uint64(k))
        # number 0 stands for the beginning of a document
        self.grams, index = np.unique(np.concatenate(grams), return_inverse=True)
        self.of = np.split(index[1:], ORDER)

    def counts(self) -> np.ndarray:
        ok = ~self.held[self.doc]
        times = self.times[self.doc[ok]].astype(float)  # sums stay whole numbers
        out = sum(np.bincount(x[ok], times, len(self.grams)) for x in self.of).astype(np.int64)
        out[0] = self.times[~self.held].sum()
        return out

    def contexts(self, k: int) -> np.ndarray:
        """Number of the context's n-gram for order k of every token."""
        out = np.zeros(len(self.doc), np.int64)
        if k > 1:
            out[1:] = self.of[k - 2][:-1]
            out[self.at_start] = 0
        return out


def _bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _send(x: np.ndarray) -> bytes:
    """Non-negative numbers in as few whole bytes each as the largest needs; none if all are 0, but for their number."""
    top = int(x.max()) if len(x) else 0
    n = (top.bit_length() + 7) // 8
    return bytes([n]) + (_bytes(x.astype(np.uint64), n) if n else len(x).to_bytes(8, "little"))


def _receive(data: bytes) -> np.ndarray:
    n = data[0]
    if not n:
        return np.zeros(int.from_bytes(data[1:], "little"), np.uint64)
    raw = np.zeros(((len(data) - 1) // n, 8), np.uint8)
    raw[:, :n] = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1).T
    return raw.view("<u8")[:, 0]


def level_bits(groups: int) -> list[int]:
    """Bits of the hash that each level of buckets looks at; at least as many buckets as groups in the end."""
    total = max(0, groups - 1).bit_length()
    levels = max(1, -(-total // FAN_BITS))
    return [total // levels + (k < total % levels) for k in range(levels)]


def _split(block: int, prefix: int, grams: np.ndarray, counts: np.ndarray, held: np.ndarray, width: int, bits: int) -> list[tuple]:
    """Requests of one node of a level to the buckets of the next."""
    rest = np.uint64(width - bits)
    part = grams >> rest
    body = grams & ((np.uint64(1) << rest) - np.uint64(1))
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    rows = []
    for a, b in zip(cut, [*cut[1:], len(part)] if len(part) else [], strict=True):
        rows.append((block >> bits, prefix << bits | int(part[a]), block, _send(np.diff(body[a:b], prepend=np.uint64(0))), _send(counts[a:b]), _send(held[a:b])))
    return rows


class Merged:
    """What the requests of one bucket add up to."""

    def __init__(self, f: pd.DataFrame):
        f = f.sort_values("blk")
        self.blocks = f["blk"].to_numpy(np.int64)
        grams = [np.cumsum(_receive(x), dtype=np.uint64) for x in f["grams"]]
        self.cuts = np.cumsum([len(x) for x in grams])[:-1]
        self.known, self.where = np.unique(np.concatenate(grams), return_inverse=True)
        self.total, self.held = (np.bincount(self.where, np.concatenate([_receive(x) for x in f[c]]).astype(np.float64), len(self.known)).astype(np.uint64) for c in ("counts", "held"))

    def answers(self, prefix: int, total: np.ndarray, kept: np.ndarray, groups: bool) -> pd.DataFrame:
        """A row for each block; groups that are not held out need no counts without those that are."""
        parts = [np.split(x[self.where], self.cuts) for x in (total, kept)]
        none = _send(np.zeros(0, np.uint64))
        rows = [(int(b), prefix, _send(t), none if groups and not _is_held_out(b) else _send(k)) for b, t, k in zip(self.blocks, *parts, strict=True)]
        out = pd.DataFrame(rows, columns=["blk", "pre", "totals", "kept"])
        return out.assign(tokens=0, distinct=0, kept_tokens=0)


def _is_held_out(group):
    return group % HELD_OUT == 1


def _requests(bits: list[int]):
    def run(key, f):
        g = Group(f["docs"], sum(bits))
        counts, group = g.counts(), int(key[0])
        rows = _split(group, 0, g.grams, counts, counts * int(_is_held_out(group)), sum(bits) + BODY_BITS + 2, bits[0])
        return pd.DataFrame(rows, columns=["up", "pre", "blk", "grams", "counts", "held"])

    return run


def _raise(bits: list[int], level: int):
    """Adds up at one level and asks the next."""
    width = sum(bits[level:]) + BODY_BITS + 2

    def run(key, f):
        m = Merged(f)
        return pd.DataFrame(_split(int(key[0]), int(key[1]), m.known, m.total, m.held, width, bits[level]), columns=["up", "pre", "blk", "grams", "counts", "held"])

    return run


def _top(groups: bool):
    def run(key, f):
        m = Merged(f)
        kept = m.total - m.held
        out = m.answers(int(key[1]), m.total, kept, groups)
        word = (m.known & np.uint64(3)) == 1
        out.loc[0, ["tokens", "distinct", "kept_tokens"]] = [int(m.total[word].sum()), int((m.total[word] > 0).sum()), int(kept[word].sum())]
        return out

    return run


def _lower(groups: bool):
    """Passes the answers that a bucket got on to those that asked it."""

    def run(key, left, right):
        m = Merged(left)
        right = right.sort_values("pre")
        total, kept = (np.concatenate([_receive(x) for x in right[c]]) for c in ("totals", "kept"))
        return m.answers(int(key[1]), total, kept, groups)

    return run


def _counted(g: Group, right: pd.DataFrame, column: str) -> np.ndarray:
    total = np.concatenate([_receive(x) for x in right.sort_values("pre")[column]])
    if len(total) != len(g.grams):
        raise ValueError("answers do not fit the group's n-grams")
    return total.astype(np.float64)


def _level(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 to 4 by themselves, then powers of two."""
    c = np.maximum(count, 0)
    return np.minimum(np.where(c <= 4, c, np.log2(np.maximum(c, 1)) + 3).astype(np.int64), LEVELS - 1)


def _estimates(g: Group, total: np.ndarray, tokens: float, distinct: float):
    """The smoothed estimate of every token, and level of context and estimate by order from the highest."""
    one = total[g.of[0]]
    base = (one + ADD) / (tokens + ADD * (distinct + 1))
    out = []
    for k in range(ORDER, 1, -1):
        context = total[g.contexts(k)]
        out.append((_level(context), np.where(context > 0, total[g.of[k - 1]] / np.maximum(context, 1), 0.0)))
    out.append((np.full(len(one), int(tokens > 0)), one / max(tokens, 1)))
    return base, out


def _cells(sums: dict, bits: list[int]):
    """Histogram of the held-out tokens' estimates relative to the smoothed one, in cells of bounded number."""

    def run(key, left, right):
        g = Group(left["docs"], sum(bits))
        ok = ~g.held[g.doc]
        base, orders = _estimates(g, _counted(g, right, "kept"), sums["kept_tokens"], sums["distinct"])
        cell = np.zeros(int(ok.sum()), np.int64)
        ratios = []
        for k, (level, p) in enumerate(orders):
            r = (p / base)[ok]
            q = np.where(r > 0, np.clip(np.log2(np.maximum(r, 1e-9)) + 5, 1, 31), 0).astype(np.int64)
            if k < ORDER - 1:
                cell = cell * LEVELS + level[ok]
            cell = cell * 32 + q
            ratios.append(r)
        cell, back = np.unique(cell, return_inverse=True)
        times = g.times[g.doc[ok]].astype(float)
        out = {"cell": cell, "n": np.bincount(back, times, len(cell))}
        return pd.DataFrame(out | {f"r{k}": np.bincount(back, r * times, len(cell)) for k, r in enumerate(ratios)})

    return run


def mixture_weights(cells: pd.DataFrame, rounds: int = EM_ROUNDS) -> list[np.ndarray]:
    """For every order from the highest, the weight of its estimate against all lower ones, by level of the context.

    Level 0 (never seen) has weight 0. Levels with little held-out data lean on the order's mean weight.
    """
    cell = cells["cell"].to_numpy(np.int64)
    n = cells["n"].to_numpy(float)
    levels = []
    for k in range(ORDER - 1, -1, -1):
        cell = cell // 32
        levels.insert(0, cell % LEVELS if k < ORDER - 1 else np.ones(len(cell), np.int64))
        if k < ORDER - 1:
            cell = cell // LEVELS
    ratio = [cells[f"r{k}"].to_numpy(float) / n for k in range(ORDER)] + [np.ones(len(n))]
    weights = [np.concatenate([[0.0], np.full(LEVELS - 1, 0.5)]) for _ in range(ORDER)]
    for _ in range(rounds):
        rest, parts = np.ones(len(n)), []
        for k in range(ORDER):
            w = weights[k][levels[k]]
            parts.append(rest * w * ratio[k])
            rest = rest * (1 - w)
        parts.append(rest)
        whole = sum(parts)
        share = [p / whole * n for p in parts]
        for k in range(ORDER):
            took, left = (np.bincount(levels[k], x, LEVELS) for x in (share[k], sum(share[k:])))
            mean = (took[1:].sum() + 0.5 * PRIOR) / (left[1:].sum() + PRIOR)
            weights[k] = (took + PRIOR * mean) / (left + PRIOR)
            weights[k][0] = 0.0
    return weights


def interpolate(base: np.ndarray, orders: list, weights: list[np.ndarray]) -> np.ndarray:
    p = base
    for (level, estimate), w in zip(reversed(orders), reversed(weights), strict=True):
        p = w[level] * estimate + (1 - w[level]) * p
    return p


def _scored(sums: dict, weights: list[np.ndarray], bits: list[int]):
    def run(key, left, right):
        g = Group(left["docs"], sum(bits))
        total = _counted(g, right, "totals")
        base, orders = _estimates(g, total, sums["tokens"], sums["distinct"])
        n = len(g.ids)
        known = np.bincount(g.doc, total[g.of[0]] > 0, n).astype(np.int64)
        scores = [np.bincount(g.doc, np.log10(p), n) for p in (base, interpolate(base, orders, weights))]
        out = pd.DataFrame({"doc_id": pd.arrays.IntegerArray(g.ids.copy(), g.no_id), "held_out": g.held, "n_tokens": np.diff(g.first), "n_known": known, "train_tokens": int(sums["tokens"]), "base_score": scores[0], "score": scores[1]})
        return out.loc[np.repeat(np.arange(n), g.times)] if (g.times > 1).any() else out

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    groups = max(HELD_OUT, -(-((size["chars"] or 0) + size["rows"]) // GROUP_CHARS))
    bits = level_bits(groups)
    packed = _packed(docs, groups)
    asked = [packed.groupBy("group").applyInPandas(releasing_group(_requests(bits)), _REQUEST)]
    for level in range(1, len(bits)):
        asked[-1] = stored(asked[-1], f"asked{level}")
        asked.append(asked[-1].groupBy("up", "pre").applyInPandas(releasing_group(_raise(bits, level)), _REQUEST))
    answers = stored(asked[-1].groupBy("up", "pre").applyInPandas(releasing_group(_top(len(bits) == 1)), _ANSWER), "answers")
    found = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "kept_tokens")]).first().asDict()
    for level in range(len(bits) - 1, 0, -1):
        # a bucket's answers come from the parts of its own part of the hash range
        up = answers.withColumn("of", F.shiftright("pre", bits[level]))
        down = asked[level - 1].groupBy("up", "pre").cogroup(up.groupBy("blk", "of")).applyInPandas(releasing_group(_lower(level == 1)), _ANSWER)
        answers = stored(down, "answers")
    totals = answers.select("blk", "pre", "totals")
    held = answers.filter(F.pmod("blk", F.lit(HELD_OUT)) == 1).select("blk", "pre", "kept")
    cells = packed.filter(F.pmod("group", F.lit(HELD_OUT)) == 1).groupBy("group").cogroup(held.groupBy("blk")).applyInPandas(releasing_group(_cells(found, bits)), "cell long, n double, " + ", ".join(f"r{k} double" for k in range(ORDER)))
    counted = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", *(f"r{k}" for k in range(ORDER)))]).orderBy("cell")
    weights = mixture_weights(counted.toPandas())
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("group").cogroup(totals.groupBy("blk")).applyInPandas(releasing_group(_scored(found, weights, bits)), schema)
