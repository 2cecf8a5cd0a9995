"""Spelling variants: frequent words at edit distance one, found by automata of word halves, and the form each one points to.

A word is cut into two segments at half its length. One edit touches one of them only, so of two near words the first one's other
segment stands in the second one at its place: the first segment at the start, the second one at the end. Words are dealt to
shards by their segments. Every shard compiles its segments into one Aho-Corasick automaton and passes through it all words that
could hold one of them; hits are checked for their offset and for lengths that differ by one at most, and what is left of both
words for an edit distance of exactly one, by its strings with one place left out. A pair that both segments find counts
at the first one. A segment that very many words share is dealt to several shards, and what is scanned goes to each of those.
Near words are counted where they are found and leave a shard as one row for each scanned word.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Before they are counted, one code point is left out of
those whose crc32 (of ``<doc_id>:<word>``) 97 divides; a null id counts as the empty text. Texts are read whole, null ones count as
empty; a single text is held in memory as its bytes. Repeated rows count as often as they occur; other columns are ignored; an
empty table gives an empty one. Ties of a form go to the word that is least in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _MIX, _pow_tables, discard, mix64, pieces, releasing, stored, texts_of

SHORTEST, LEAST_COUNT, EVERY, FACTOR = 5, 3, 97, 2
#: Distinct words that a task gathers before it passes them on; words of a shard; longest word whose crc comes from tables.
GATHERED, SHARD_WORDS, TABLE_BYTES = 300_000, 20_000, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # U+00C0 to U+00FF are 0xC3 and one byte more


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _crc_step(state: np.ndarray, byte=0) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def without(word: str, k: int) -> str:
    return word[:k] + word[k + 1 :]


def _count_piece(raw: list[bytes], ids: list[str], counts: Counter) -> None:
    """Adds the words of some texts, as UTF-8, to counts.

    crc32 is linear: that of id and word is that of the id, carried on over as many zero bytes, xor the word's own.
    """
    line = b"\n".join(raw).translate(_LOWER)
    buf = np.frombuffer(line, np.uint8)
    letter = np.zeros(len(buf) + 2, bool)
    letter[1:-1] = _LETTER[buf]
    letter[2:-1] |= buf[:-1] == 0xC3
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    s, e = edge[0::2], edge[1::2]
    leads = np.concatenate([[0], np.cumsum(buf == 0xC3)])
    long = e - s - (leads[e] - leads[s]) >= SHORTEST
    s, e = s[long], e[long]
    if not len(s):
        return
    size = e - s
    up, down = _pow_tables(len(buf) + 1)
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64)])
    _, first, word = np.unique(mix64((c[e] - c[s]) * down[s] + size.astype(np.uint64) * _MIX[0]), return_index=True, return_inverse=True)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
    doc = np.searchsorted(begins, s, "right") - 1
    own = np.zeros(len(first), np.uint32)
    for k in range(min(TABLE_BYTES, int(size.max()))):
        on = np.flatnonzero(size[first] > k)
        own[on] = _crc_step(own[on], buf[s[first[on]] + k])
    states = [~np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)]
    for _ in range(TABLE_BYTES):
        states.append(_crc_step(states[-1]))
    crc = ~(np.stack(states)[np.minimum(size, TABLE_BYTES), doc] ^ own[word])
    for k in np.flatnonzero(size > TABLE_BYTES):
        crc[k] = zlib.crc32(line[s[k] : e[k]], zlib.crc32(f"{ids[doc[k]]}:".encode()))
    cut = crc % EVERY == 0
    whole = np.bincount(word[~cut], minlength=len(first))
    for k, n in zip(first.tolist(), whole.tolist(), strict=True):
        if n:
            counts[line[s[k] : e[k]]] += n
    for k in np.flatnonzero(cut):
        w = line[s[k] : e[k]].decode()
        if len(w) > SHORTEST:
            counts[without(w, int(crc[k]) % len(w)).encode()] += 1


def _count(batches):
    counts: Counter = Counter()

    def gathered():
        words, numbers = pa.array(map(bytes.decode, counts), pa.string()), pa.array(counts.values(), pa.int64())
        counts.clear()
        return pa.record_batch({"word": words, "n": numbers})

    for batch in batches:
        ids = ["" if i is None else str(i) for i in batch.column(batch.schema.get_field_index("doc_id")).to_pylist()]
        for at, raw in pieces(texts_of(batch)):
            _count_piece(raw, ids[at : at + len(raw)], counts)
            if len(counts) > GATHERED:
                yield gathered()
    if counts:
        yield gathered()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs, for words long and frequent enough."""
    found = docs.select("doc_id", "text").mapInArrow(releasing(_count), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Shard:
    """The segments of some words in one automaton, and by segment what is left of the words."""

    def __init__(self):
        self.groups: dict[tuple[int, int, str], dict[str, int]] = defaultdict(dict)

    def add(self, kind: int, word: str, n: int) -> None:
        """kind 0 holds the word's first segment, 1 its second one."""
        half = len(word) // 2
        segment, rest = (word[half:], word[:half]) if kind else (word[:half], word[half:])
        self.groups[kind, len(word), segment][rest] = n

    def compile(self) -> Shard:
        self.automaton = ahocorasick.Automaton()
        places = defaultdict(list)
        self.gaps, self.cuts = defaultdict(list), defaultdict(set)
        for group in self.groups:
            places[group[2]].append(group)
            for rest in self.groups[group]:
                for k in range(len(rest)):
                    self.gaps[group, k, without(rest, k)].append(rest)
                    self.cuts[group, without(rest, k)].add(rest)
        for segment, groups in places.items():
            self.automaton.add_word(segment, groups)
        self.automaton.make_automaton()
        return self

    def _near_rests(self, group, rest: str, longer: int):
        """What is left of a group's words, at distance one from what is left of a scanned word with longer more code points."""
        if longer == 0:
            return {r for k in range(len(rest)) for r in self.gaps.get((group, k, without(rest, k)), ()) if r != rest}
        if longer == 1:
            return {r for k in range(len(rest)) if (r := without(rest, k)) in self.groups[group]}
        return self.cuts.get((group, rest), ())

    def near(self, word: str):
        """(near word, its n) for each of the shard's words."""
        if not self.groups:
            return
        for end, groups in self.automaton.iter(word):
            for group in groups:
                kind, length, segment = group
                longer = len(word) - length
                if abs(longer) > 1:
                    continue
                if kind == 0 and end + 1 == len(segment):
                    for r in self._near_rests(group, word[len(segment) :], longer):
                        yield segment + r, self.groups[group][r]
                elif kind == 1 and end + 1 == len(word):
                    for r in self._near_rests(group, word[: -len(segment)], longer):
                        if not word.startswith(r):  # else the first segment has found it
                            yield r + segment, self.groups[group][r]


def _scan(batches):
    """Rows of shard, role, kind, word and n, sorted: in every shard words it holds (role 0) before those it scans (role 1)."""
    current, shard, out = None, Shard(), []
    for batch in batches:
        for number, role, kind, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != current:
                current, shard, ready = number, Shard(), False
            if role == 0:
                shard.add(kind, word, n)
                continue
            if not ready:
                shard.compile()
                ready = True
            found = list(shard.near(word))
            if found:
                best, most = min(found, key=lambda x: (-x[1], x[0]))
                out.append((word, len(found), best, most))
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()))), names=["word", "k", "best", "most"])
            out = []


def _segments(word: Column, more: int) -> Column:
    """Both segments of words that have so many code points more, as they would stand in this word."""
    length = F.length(word) + more
    half = F.floor(length / 2).cast("int")
    return F.array(*(F.struct(F.lit(kind).alias("kind"), length.alias("length"), part.alias("segment")) for kind, part in ((0, F.left(word, half)), (1, F.right(word, length - half)))))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best and best_n of every word that has near words, for a table of distinct words (word, n)."""
    shards = max(1, 2 * words.count() // SHARD_WORDS)
    key = ["kind", "length", "segment"]
    held = words.select("word", "n", F.explode(_segments(F.col("word"), 0)).alias("x")).select("word", "n", "x.*")
    crowded = held.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SHARD_WORDS).cast("int").alias("parts")).filter("parts > 1")
    crowded = stored(crowded, "crowded-segments")
    parts, number = F.coalesce("parts", F.lit(1)), lambda part: F.pmod(F.xxhash64(*key, part), F.lit(shards)).cast("int").alias("shard")
    held = held.join(crowded, key, "left").select(number(F.pmod(F.xxhash64("word"), parts)), F.lit(0).alias("role"), "kind", "word", "n")
    scanned = words.select("word", F.explode(F.concat(*(_segments(F.col("word"), d) for d in (-1, 0, 1)))).alias("x")).select("word", "x.*")
    scanned = scanned.filter(F.col("length") >= SHORTEST).join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    scanned = scanned.select(number(F.col("part").cast("long")), "word").distinct().select("shard", F.lit(1).alias("role"), F.lit(0).alias("kind"), "word", F.lit(0).cast("long").alias("n"))
    dealt = held.union(scanned).repartition("shard").sortWithinPartitions("shard", "role")
    found = dealt.mapInArrow(releasing(_scan), "word string, k long, best string, most long")
    best = F.min(F.struct((-F.col("most")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where links (word, form) end; every step doubles what a link spans. Forms must not run in circles."""
    links = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("after"))
        longer = stored(links.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "forms")
        discard(links)
        links = longer
        if links.filter("moved").isEmpty():
            return links.select("word", "root")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that is long and frequent enough."""
    words = stored(word_counts(docs), "words")
    near = words.join(near_words(words), "word", "left")
    ahead = F.col("best_n") >= FACTOR * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ahead, F.col("best")).alias("form"), F.when(ahead, F.col("best_n")).alias("form_n")), "near-words")
    out = near.join(roots(near.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
