"""Language identification by a linear-chain conditional random field over the words of a text.

Words are runs of letters. Emission weights come from hashed character n-grams of the word with end marks (so
those at an end are affixes) and from a lexicon of frequent training words; transition weights between the
languages of neighbouring words are learned with them, on sequences of which part switch between languages.
Forward-backward gives every word's marginals; a text's prediction is the language with the most letters in
expectation, its score that language's share; ``label_words`` gives every word with its own label. Long texts are cut into
blocks whose transfer matrices are multiplied first, so the marginals are exact at any length and the cost is linear.

Training reads a bounded sample of the rows with a language outside the held-out fold: ``PER_LANGUAGE`` texts a language, fewer
if they are over ``SAMPLE_TEXTS`` together (but ``LEAST_TEXTS`` of each), and ``WINDOW`` characters at most from a hashed place of a
longer one. All values of lang are learned. One task fits the model; the driver only passes it on. Prediction reads whole
texts, and nothing but texts. Null texts and texts without a letter get ``und`` and score 0, as does everything if there is
nothing to learn from. Ties go to the language that sorts first.

A score says which language is best, not whether any fits: among K languages it is 1/K or more for every text. Whether a
text is in a learned language at all is judged by its n-grams of ``MAX_N`` characters: ``evidence`` is the share of letters
in words of which ``WORD_SEEN`` or more were seen in one language's training texts. It does not depend on K.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, mix64, releasing, texts_of, with_columns

PER_LANGUAGE, WINDOW, SAMPLE_TEXTS, LEAST_TEXTS = 250, 2500, 16_000, 8
#: N-grams are hashed to so many bits; to fewer with over 32 languages, so that the weights stay as many.
HASH_BITS, MAX_N, LEXICON_MIN = 17, 4, 4
#: Words times languages that training holds at once.
CELLS = 8_000_000
SEQUENCE, ROUNDS, BLOCK = 40, 30, 48
WORD_SEEN, LEAST_EVIDENCE = 0.75, 0.5
SHORT_LETTERS, SHORT_EVIDENCE = 40, 1 / 3
UNKNOWN = "und"
PIECE_CHARS = 300_000
_M = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_BOW, _EOW = 0x110000, 0x110001


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter, and its lower-case form."""
    is_letter = np.zeros(0x110002, bool)
    lower = np.arange(0x110002, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            is_letter[c] = True
            if len(x := chr(c).lower()) == 1:
                lower[c] = ord(x)
    return is_letter, lower


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 2**64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


class Words:
    """The words of some texts: per word its number among the distinct ones and its length; first word of each text."""

    def __init__(self, texts: list):
        is_letter, lower = _letters()
        texts = ["" if t is None or t != t else t for t in texts]
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        flag = np.zeros(len(cp) + 2, bool)
        flag[1:-1] = is_letter[cp]
        edge = np.flatnonzero(flag[1:] != flag[:-1])
        s, e = edge[0::2], edge[1::2]
        low = lower[cp]
        up, down = _powers(1 << max(19, int(len(cp) + 1).bit_length()))
        c = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _M[0] * up[: len(cp)], out=c[1:])
        h = mix64((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * _M[1])
        self.hashes, index, self.word = np.unique(h, return_index=True, return_inverse=True)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.first = np.searchsorted(s, begins)
        self.size = (e - s).astype(np.float64)
        self.begin = s - begins[:-1][np.repeat(np.arange(len(texts)), np.diff(self.first))]
        us, ue = s[index], e[index]
        n = ue - us + 2
        self.at = np.concatenate([[0], np.cumsum(n)])
        chars = np.empty(self.at[-1], np.uint64)
        inner = np.ones(len(chars), bool)
        inner[self.at[:-1]] = inner[self.at[1:] - 1] = False
        chars[self.at[:-1]], chars[self.at[1:] - 1] = _BOW, _EOW
        size = ue - us
        src = np.arange(size.sum()) + np.repeat(us - (np.cumsum(size) - size), size)
        chars[inner] = low[src]
        self.chars = chars

    def grams(self, bits: int = HASH_BITS):
        """For every n the hashed n-grams at all places of chars, and how many at the end of a word lack a place."""
        v = (self.chars + np.uint64(1)) * _M[2]
        acc = v
        for n in range(1, MAX_N + 1):
            if n > 1:
                if len(v) < n:
                    return
                acc = acc[:-1] * _M[3] + v[n - 1 :]
            yield n, (mix64(acc + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)

    def long_grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hash, distinct word) of all n-grams of MAX_N inside a word with its marks; a shorter word is its own."""
        n = np.diff(self.at)
        owner = np.repeat(np.arange(len(n)), np.maximum(n - MAX_N + 1, 1))
        rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(n)))[owner]
        place = self.at[:-1][owner] + rank
        h = np.zeros(len(owner), np.uint64)
        for k in range(MAX_N):
            inside = place + k < self.at[1:][owner]
            c = self.chars[np.minimum(place + k, len(self.chars) - 1)] + np.uint64(1)
            h = h * _M[3] + np.where(inside, c, np.uint64(0)) * _M[2]
        return mix64(h), owner

    def gram_sum(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over all n-grams inside each distinct word."""
        out = np.zeros((len(self.hashes), table.shape[1]))
        for n, ids in self.grams(len(table).bit_length() - 1):
            csum = np.zeros((len(ids) + 1, table.shape[1]))
            np.cumsum(table[ids], axis=0, out=csum[1:])
            lo = np.minimum(self.at[:-1], len(ids))
            hi = np.minimum(np.maximum(self.at[1:] - n + 1, lo), len(ids))
            out += csum[hi] - csum[lo]
        return out

    def gram_scatter(self, per_word: np.ndarray, size: int) -> np.ndarray:
        """Transpose of gram_sum: adds each word's row to all its n-grams."""
        out = np.zeros((size, per_word.shape[1]))
        owner = np.repeat(np.arange(len(self.hashes)), np.diff(self.at))
        end = self.at[1:][owner]
        for n, ids in self.grams(size.bit_length() - 1):
            ok = np.flatnonzero(np.arange(len(ids)) + n <= end[: len(ids)])
            for k in range(per_word.shape[1]):
                out[:, k] += np.bincount(ids[ok], per_word[owner[ok], k], size)
        return out


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Exact label marginals of chains. scores: (words, K) log potentials; first: bounds of the chains."""
    return forward_backward(scores, first, trans, pairs=False)[0]


def forward_backward(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(label marginals of every word, with pairs also the expected number of transitions between labels), both exact.

    A chain's probability is in proportion to exp of its words' scores and of trans for each pair of neighbours.
    """
    K = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-300
    T = np.exp(trans - trans.max())
    length = np.diff(first)
    blocks = -(-length // BLOCK)
    chain = np.repeat(np.arange(len(length)), blocks)
    bfirst = np.concatenate([[0], np.cumsum(blocks)])
    rank = np.arange(len(chain)) - bfirst[chain]
    start = first[:-1][chain] + rank * BLOCK
    size = np.minimum(BLOCK, first[1:][chain] - start)
    order = np.argsort(-size, kind="stable")
    start, size, leads = start[order], size[order], rank[order] == 0
    if not len(start):
        return np.zeros((0, K)), np.zeros((K, K))
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(size[0])]
    # transfer matrix of every block; a chain's first word has no transition before it
    M = np.broadcast_to(np.eye(K), (len(start), K, K)).copy()
    if blocks.max() > 1:
        for t, k in enumerate(active):
            step = M[:k] @ T
            if t == 0:
                step[leads] = M[leads]
            M[:k] = step * e[start[:k] + t][:, None, :]
            if t % 8 == 7 or t == len(active) - 1:
                M[:k] /= M[:k].max(axis=(1, 2), keepdims=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # messages at the blocks' borders, all chains in step
    a, b = np.full((len(order), K), 1 / K), np.ones((len(order), K))
    for r in range(1, blocks.max()):
        now = bfirst[:-1][blocks > r] + r
        x = np.einsum("ij,ijk->ik", a[place[now - 1]], M[place[now - 1]])
        a[place[now]] = x / x.sum(axis=1, keepdims=True)
        now = bfirst[1:][blocks > r] - 1 - r
        x = np.einsum("ijk,ik->ij", M[place[now + 1]], b[place[now + 1]])
        b[place[now]] = x / x.sum(axis=1, keepdims=True)
    alpha = np.empty((len(scores), K))
    beta = np.empty((len(scores), K)) if pairs else None  # with the word's own potential
    for t, k in enumerate(active):
        x = a[:k] @ T
        if t == 0:
            x[leads] = 1.0
        a[:k] = x * e[start[:k] + t]
        a[:k] /= a[:k].sum(axis=1, keepdims=True)
        alpha[start[:k] + t] = a[:k]
    out = alpha.copy() if pairs else alpha
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        w = start[:k] + t
        out[w] *= b[:k]
        x = b[:k] * e[w]
        if pairs:
            beta[w] = x
        b[:k] = x @ T.T
        b[:k] /= b[:k].sum(axis=1, keepdims=True)
    out /= out.sum(axis=1, keepdims=True)
    if not pairs:
        return out, None
    inner = np.ones(len(scores), bool)
    inner[first[:-1][length > 0]] = False
    right = np.flatnonzero(inner)
    left = alpha[right - 1]
    z = ((left @ T) * beta[right]).sum(axis=1, keepdims=True)
    return out, T * ((left / z).T @ beta[right])


class Model:
    def __init__(self, labels: list[str]):
        self.labels = labels
        K = len(labels)
        self.bits = HASH_BITS - max(0, (K - 1).bit_length() - 5)
        self.grams = np.zeros((1 << self.bits, K))
        self.trans = np.zeros((K, K))
        self.lexicon = np.zeros(0, np.uint64)
        self.words = np.zeros((1, K))
        self.seen = np.zeros(0, np.uint64)
        self.seen_in = np.zeros((1, K), bool)

    def learn_seen(self, w: Words, label: np.ndarray) -> None:
        """Notes the languages in whose texts each long n-gram occurs."""
        h, owner = w.long_grams()
        self.seen, at = np.unique(h, return_inverse=True)
        self.seen_in = np.zeros((len(self.seen) + 1, len(self.labels)), bool)
        for k in range(len(self.labels)):
            has = np.bincount(w.word[label == k], minlength=len(w.hashes)) > 0
            self.seen_in[at[has[owner]], k] = True

    def seen_share(self, w: Words) -> np.ndarray:
        """For each distinct word the share of its long n-grams that the language with most of them has."""
        h, owner = w.long_grams()
        at = np.searchsorted(self.seen, h)
        ok = at < len(self.seen)
        ok[ok] = self.seen[at[ok]] == h[ok]
        rows = self.seen_in[np.where(ok, at, len(self.seen))]
        most = np.zeros(len(w.hashes))
        for k in range(rows.shape[1]):
            most = np.maximum(most, np.bincount(owner, rows[:, k], len(w.hashes)))
        return most / np.maximum(np.bincount(owner, minlength=len(w.hashes)), 1)

    def is_learned(self, w: Words) -> np.ndarray:
        """Whether each text is in languages of the training. Short texts need a smaller share, of n-grams in place of words."""
        share = self.seen_share(w)[w.word]
        letters, known, grams = (np.diff(np.concatenate([[0.0], np.cumsum(x)])[w.first]) for x in (w.size, w.size * (share >= WORD_SEEN), w.size * share))
        enough = np.where(letters < SHORT_LETTERS, grams >= SHORT_EVIDENCE * letters - 1e-6, known >= LEAST_EVIDENCE * letters - 1e-6)
        return (letters > 0) & enough

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word in the lexicon; the last row, which stays zero, for others."""
        at = np.searchsorted(self.lexicon, hashes)
        ok = at < len(self.lexicon)
        ok[ok] = self.lexicon[at[ok]] == hashes[ok]
        return np.where(ok, at, len(self.lexicon))

    def emissions(self, w: Words) -> np.ndarray:
        return w.gram_sum(self.grams) + self.words[self._known(w.hashes)]

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def label(self, texts: list):
        """For runs of texts: (place of the first, words, marginals of all words)."""
        at = 0
        for run in _runs(texts, len(self.labels)):
            w = Words(run)
            yield at, w, marginals(self.emissions(w)[w.word], w.first, self.trans) if self.labels else np.zeros((len(w.word), 0))
            at += len(run)

    def judge(self, texts: list, evidence: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Name and score of each text's language; with evidence, whether the text is in learned languages."""
        names, scores, learned = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for at, w, p in self.label(texts):
            counts = np.diff(w.first)
            if not self.labels:
                names += [UNKNOWN] * len(counts)
                continue
            csum = np.concatenate([np.zeros((1, len(self.labels))), np.cumsum(p * w.size[:, None], axis=0)])
            total = csum[w.first[1:]] - csum[w.first[:-1]]
            best = np.round(total, 9).argmax(axis=1)
            share = total[np.arange(len(counts)), best] / np.maximum(total.sum(axis=1), 1e-12)
            names += [self.labels[b] if n else UNKNOWN for b, n in zip(best, counts, strict=True)]
            scores[at : at + len(counts)] = np.where(counts > 0, np.clip(share, 0, 1), 0)
            if evidence:
                learned[at : at + len(counts)] = self.is_learned(w)
        return names, scores, learned


def _runs(texts: list, languages: int = 4):
    """Runs of texts; with many languages they are shorter, as every word has a number for each."""
    limit = min(PIECE_CHARS, max(20_000, 4 * PIECE_CHARS // max(1, languages)))
    run, size = [], 0
    for t in texts:
        n = len(t) if isinstance(t, str) else 0
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def train(sample: list[tuple[str, str]], seed: int = 1) -> Model:
    """sample: (language, text). Labels every word with its text's language and learns from cut and mixed sequences."""
    labels = sorted({lang for lang, _ in sample})
    model = Model(labels)
    if not labels:
        return model
    w = Words([t for _, t in sample])
    code = {lang: k for k, lang in enumerate(labels)}
    label = np.repeat([code[lang] for lang, _ in sample], np.diff(w.first))
    model.learn_seen(w, label)
    # segments of one text each; a third of the sequences joins short segments of different texts
    rng = np.random.default_rng(seed)
    cuts = np.unique(np.concatenate([w.first, np.flatnonzero(rng.random(len(label)) < 2 / SEQUENCE)]))
    segments = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rng.shuffle(segments)
    index, first, k = [], [0], 0
    while k < len(segments):
        take = int(rng.integers(2, 5)) if rng.random() < 1 / 3 else 1
        index += [np.arange(a, b) for a, b in segments[k : k + take]]
        first.append(first[-1] + sum(b - a for a, b in segments[k : k + take]))
        k += take
    if not index:
        return model
    index, first = np.concatenate(index), np.array(first)
    y, word = label[index], w.word[index]
    K, V = len(labels), len(w.hashes)
    count = np.bincount(w.word, minlength=V)
    model.lexicon = w.hashes[count >= LEXICON_MIN]
    model.words = np.zeros((len(model.lexicon) + 1, K))
    known = model._known(w.hashes)
    gold = np.zeros((V, K))
    np.add.at(gold, (word, y), 1)
    inner = np.ones(len(y), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    pair = np.zeros((K, K))
    np.add.at(pair, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    limit = max(1, CELLS // K)
    runs = np.unique(np.concatenate([np.searchsorted(first, np.arange(0, first[-1], limit)), [len(first) - 1]]))
    squares = [np.full_like(x, 1.0) for x in (model.grams, model.words, model.trans)]
    for _ in range(ROUNDS):
        emissions = model.emissions(w)
        diff, expected = gold.copy(), np.zeros((K, K))
        for i, j in zip(runs[:-1], runs[1:], strict=True):
            of = word[first[i] : first[j]]
            p, joint = forward_backward(emissions[of], first[i : j + 1] - first[i], model.trans)
            expected += joint
            for k in range(K):
                diff[:, k] -= np.bincount(of, p[:, k], V)
        grad_words = np.zeros_like(model.words)
        for k in range(K):
            grad_words[:, k] = np.bincount(known, diff[:, k], len(model.words))
        grad_words[-1] = 0
        grads = (w.gram_scatter(diff, len(model.grams)) - 1e-2 * model.grams, grad_words - 1e-2 * model.words, pair - expected)
        for x, g, s, rate in zip((model.grams, model.words, model.trans), grads, squares, (0.1, 0.1, 0.1), strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    model.grams = model.grams.astype(np.float32)
    return model


def sample_labelled(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang and text of a bounded sample of the rows with both outside the held-out fold: those of least id hash, by language.

    The driver sees a row count for each language.
    """
    rows = df.select(df[id_col].cast("string").alias("id"), df[text_col].alias("t"), df[lang_col].cast("string").alias("l")).filter("t IS NOT NULL AND l IS NOT NULL").filter(fold("id", 4) != 2)
    counts = rows.groupBy("l").count().collect()
    most = max(LEAST_TEXTS, min(per_language, SAMPLE_TEXTS // max(1, len(counts))))
    limits = [x for r in counts for x in (F.lit(r["l"]), F.lit(min(1.0, (1.3 * most + 60) / r["count"])))]
    limit = F.create_map(*limits)[F.col("l")] if limits else F.lit(0.0)
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    at = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.length("t") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    found = rows.withColumn("h", h).filter(F.col("h") < limit).select("l", "h", "id", F.substring("t", at, F.lit(WINDOW)).alias("t"))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "id", "t"))
    return found.withColumn("k", first).filter(F.col("k") <= most).select(F.col("l").alias("lang"), F.col("t").alias("text"), "k")


def fit(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = PER_LANGUAGE) -> Model:
    """The model for the labelled rows of a table; one task fits it on the bounded sample."""

    @releasing
    def run(batches):
        rows = sorted((lang, k, t) for b in batches for lang, t, k in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.record_batch({"model": pa.array([pickle.dumps(train([(lang, t) for lang, _, t in rows]))], pa.binary())})

    sample = sample_labelled(df, id_col, text_col, lang_col, per_language)
    got = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else Model([])


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    narrow = df.select(df[id_col].alias("id"), (fold(id_col, 4) == 2).alias("held_out"), df[text_col].alias("text"))

    @releasing
    def run(batches):
        for batch in batches:
            names, scores = shared.value.predict(texts_of(batch))
            yield with_columns(batch, ["id", "held_out"], ["lang_pred", "score"], [pa.array(names, pa.string()), pa.array(scores)])

    kind = df.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def label_words(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, word (from 0), begin, end (code points), lang and p (its marginal) of every word; nothing for texts without words.

    Without languages to learn from, lang is ``und`` and p is 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches):
        for batch in batches:
            model = shared.value
            for at, w, p in model.label(texts_of(batch)):
                text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
                if not len(text):
                    continue
                best = p.argmax(axis=1) if model.labels else np.zeros(len(text), np.int64)
                names = np.array(model.labels or [UNKNOWN], object)[best]
                top = p[np.arange(len(text)), best] if model.labels else np.zeros(len(text))
                ends = w.begin + w.size.astype(np.int64)
                columns = [pa.array(np.arange(len(text)) - w.first[text], pa.int64()), pa.array(w.begin, pa.int64()), pa.array(ends, pa.int64()), pa.array(names, pa.string()), pa.array(top)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + text)), *columns], names=["id", "word", "begin", "end", "lang", "p"])

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, word long, begin long, end long, lang string, p double").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: Model, min_score: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows with an identified language; all columns stay as they are.

    A row goes if it has no letter, or if under half of its letters are in words like those of the training texts (see
    evidence above; a text of fewer than SHORT_LETTERS letters goes if under a third of its n-grams are known), or if its best
    language does no better than min_score, if given. Being in two languages is no reason to go.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches):
        for batch in batches:
            names, scores, learned = shared.value.judge(texts_of(batch, text_col), evidence=True)
            keep = (np.array(names) != UNKNOWN) & learned
            yield batch.filter(pa.array(keep if min_score is None else keep & (scores >= min_score)))

    return df.mapInArrow(run, df.schema)
