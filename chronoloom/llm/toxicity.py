"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs. Every word and every character n-gram (3 to 7 bytes, with word marks) of the
training sample has an evidence value: the log of how much oftener toxic documents hold
it than its total would let expect, shrunk towards zero by PRIOR expected sightings, so
that rare ones, seen once or never, count for nothing. A word enters the network as its
own value, the sum over the root of their number, the largest and the least of its
n-grams' values, and a learnt embedding; words of fewer than LEARNT_DOCS documents, seen
or not, share one embedding. So unseen words of a known build are recognised, and
harmless common words can tell by their order.

Evidence is cross-fitted: documents are dealt into FOLDS parts, and a training document
is read with values counted on the other parts, as it would otherwise vouch for its own
words. Scoring uses the counts of all parts.

The network reads windows of 128 words; attention pools a window's states to one logit.
Every document is scored in all its windows, each overlapping the next by half, and
takes the largest logit, scaled to a probability on the training documents as read with
the other parts' values.

Training is plain numpy on the driver, on at most SAMPLE labelled documents of either
kind, the ones whose ids hash lowest among those that the table holds with words in
them, and on no more of either kind than have SAMPLE_BYTES together: a document that
does not fit is passed over, the others are read whole. As labels speak of documents, windows of toxic documents count as toxic at
first; later only those that the network itself finds toxic, and each document's most
toxic one. In half of the windows a random share of the words is read as never seen, of
toxic documents only words that do not speak for toxicity: else words unheard of would
count as toxic where all rare training words are.

Edge cases: null and empty texts score 0; documents under 128 words are one short
window; repeated rows score alike, and train once; labels without a document are left
out before the sample is taken; without labels of both kinds every document scores 0; of
contradicting labels of one document toxic wins; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import give_back, shielded, table, thrifty, utf8, utf8_of

WINDOW = 128
STRIDE = 64
HIDDEN = 8
#: Places of a word's learnt embedding, after its STATIC values.
DIM = 4
STATIC = 4
GRAM_SIZES = (3, 4, 5, 6, 7)
#: Labelled documents of either kind in the training sample, and bytes of their whole texts.
SAMPLE, SAMPLE_BYTES = 2000, 10 << 20
FOLDS = 4
#: Sightings at the expected rate that every word and n-gram is given besides its own.
PRIOR = 10.0
LEARNT_DOCS = 30
STEPS = 200
#: Share of training windows in which some words are read as never seen.
FORGETFUL = 0.5
BATCH = 128
RATE = 0.05
DAMPING = 1e-4
#: How many missed toxic documents a flagged clean one weighs, by share, when the threshold is set.
COST = 2.0
#: Where the threshold lies between the neighbouring clean and toxic document.
BORDER = 0.6
THRESHOLD = 0.7
#: Words whose projections a worker remembers at most; beyond it, it starts afresh.
REMEMBERED = 125_000
CHUNK_BYTES = 1 << 20
#: Words of all windows that are read at once.
WORDS_AT_ONCE = 65_536
EDGE = b".,;:!?\"'()[]{}<>*#$%&|+-=/\\_~`^@"


def tokens(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


@dataclass
class Words:
    """Hashes of distinct words: word has one each, grams those of all words' n-grams, by word; size says how many each word has."""

    word: np.ndarray
    grams: np.ndarray
    size: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)


def features(words: list[bytes]) -> Words:
    """The hashes of distinct words, taken without signs at their edges."""
    bare = [w.strip(EDGE) or w for w in words]
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in bare]), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in bare], np.int32)
    left = np.repeat(np.cumsum(sizes, dtype=np.int32), sizes) - np.arange(len(data), dtype=np.int32)  # bytes up to the word's end
    # a row for each place, so that n-grams come by word
    found, inside = np.zeros((len(data), len(GRAM_SIZES)), np.uint64), left[:, None] >= np.array(GRAM_SIZES, np.int32)
    h = data
    for n in range(2, max(GRAM_SIZES) + 1):
        if len(data) < n:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n in GRAM_SIZES:
            found[: len(h), GRAM_SIZES.index(n)] = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    whole = np.array([zlib.crc32(w) << 32 | zlib.adler32(w) for w in bare], np.uint64)
    return Words(whole, found[inside], sum(np.maximum(sizes - (n - 1), 0) for n in GRAM_SIZES).astype(np.int64))


def in_parts(words: list[bytes], at_once: int = 20_000) -> Iterator[tuple[int, Words]]:
    """features() of many words, a part at a time, each with its first word's number."""
    for i in range(0, len(words), at_once):
        yield i, features(words[i : i + at_once])


def evidence(times: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Values from sightings, shape (FOLDS, 2, keys), and all sightings, (FOLDS, 2): a row without each part, then one of all parts."""
    out = []
    for part in range(FOLDS + 1):
        held, whole = (times.sum(0) - times[part], totals.sum(0) - totals[part]) if part < FOLDS else (times.sum(0), totals.sum(0))
        share = whole[1] / max(whole.sum(), 1)
        out.append(np.log((held[1] + PRIOR * share + 1e-9) / (held.sum(0) * share + PRIOR * share + 1e-9)).astype(np.float32))
    return np.stack(out)


def static(word: np.ndarray, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The STATIC values of words, from their own values and those of their n-grams."""
    out = np.zeros((len(word), STATIC), np.float32)
    out[:, 0] = word
    filled = np.flatnonzero(size)
    if len(filled):
        first = np.cumsum(size)[filled] - size[filled]
        out[filled, 1] = np.add.reduceat(grams, first) / np.sqrt(size[filled])
        out[filled, 2], out[filled, 3] = np.maximum.reduceat(grams, first), np.minimum.reduceat(grams, first)
    return out


def window_starts(n: int) -> np.ndarray:
    """Where windows over n words begin; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    starts[-1] = n - WINDOW
    return starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Index:
    """Sorted 64-bit hashes, found by their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys; their number where it is none."""
        out = np.full(len(hashes), len(self.keys), np.int32)
        first = (hashes >> self.shift).astype(np.int64)
        at, end = self.begins[first], self.begins[first + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.keys[here] == hashes[open_]
            out[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


@dataclass
class Network:
    """Parameters by name; direction 1 of the recurrent ones reads backwards.

    words and grams are the known hashes, word_value and gram_value their evidence (one entry
    more: of any other); place is each word's row in the learnt embedding, where row 0 is of
    all rare words; middle and spread bring static values to a common scale.
    """

    p: dict[str, np.ndarray]
    words: Index
    word_value: np.ndarray
    grams: Index
    gram_value: np.ndarray
    place: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    untrained: bool = False

    @classmethod
    def fresh(cls, rng: np.random.Generator, common: int = 0) -> Network:
        """A network that knows no word yet; common: rows of the learnt embedding besides that of rare words."""

        def normal(*shape: int, size: float) -> np.ndarray:
            return (rng.standard_normal(shape) * size).astype(np.float32)

        h, d, keys, none = HIDDEN, STATIC + DIM, Index(np.zeros(0, np.uint64)), np.zeros(1, np.float32)
        return cls({
            "word": normal(common + 1, DIM, size=0.1),
            "w": normal(2, d, 3 * h, size=0.3), "b": np.zeros((2, 1, 3 * h), np.float32), "u": normal(2, h, 3 * h, size=0.3),
            "wa": normal(2 * h, 2 * h, size=0.3), "ba": np.zeros(2 * h, np.float32), "va": normal(2 * h, size=0.3),
            "wo": normal(2 * h, size=0.3), "bo": np.full(1, -1, np.float32),
        }, keys, none, keys, none, np.zeros(1, np.int64), np.zeros(STATIC, np.float32), np.ones(STATIC, np.float32))

    def embed(self, f: Words) -> np.ndarray:
        """Input rows of words: scaled static values, then learnt ones."""
        word = self.words.rows(f.word)
        values = static(self.word_value[word], self.gram_value[self.grams.rows(f.grams)], f.size)
        return self.inputs((values - self.middle) / self.spread, self.place[word])

    def inputs(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([values, self.p["word"][rows]], 1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of words: shape (words, 2, 3 * HIDDEN)."""
        out = np.empty((len(x), 2, 3 * HIDDEN), np.result_type(x, self.p["w"]))
        for at in range(0, len(x), WORDS_AT_ONCE):
            out[at : at + WORDS_AT_ONCE] = (x[at : at + WORDS_AT_ONCE] @ self.p["w"] + self.p["b"]).transpose(1, 0, 2)
        return out

    def states(self, inputs: np.ndarray, valid: np.ndarray | None, tape: list | None = None) -> np.ndarray:
        """Both directions' states, shape (time, batch, 2 * HIDDEN); inputs: (time, batch, 2, 3 * HIDDEN)."""
        t_max, batch = inputs.shape[:2]
        h, u, k = np.zeros((2, batch, HIDDEN), np.float32), self.p["u"], HIDDEN
        out = np.empty((t_max, batch, 2, k), np.float32)
        for t in range(t_max):
            back = t_max - 1 - t
            x = np.stack([inputs[t, :, 0], inputs[back, :, 1]])
            g = h @ u
            gates = sigmoid(x[..., : 2 * k] + g[..., : 2 * k])
            z, r, gn = gates[..., :k], gates[..., k:], g[..., 2 * k :]
            n = np.tanh(x[..., 2 * k :] + r * gn)
            new = n + z * (h - n)
            m = None
            if valid is not None:
                m = np.stack([valid[t], valid[back]])[..., None]
                new = h + m * (new - h)
            if tape is not None:
                tape.append((h, z, r, n, gn, m))
            h = new
            out[t, :, 0], out[back, :, 1] = h[0], h[1]
        return out.reshape(t_max, batch, 2 * k)

    def pooled(self, states: np.ndarray, valid: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention's hidden layer, its weights, and the logits."""
        a = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = a @ self.p["va"]
        if valid is not None:
            e = np.where(valid > 0, e, np.float32(-30))
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        return a, e, np.einsum("tb,tbk->bk", e, states) @ self.p["wo"] + self.p["bo"]

    def logits(self, projected: np.ndarray, windows: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
        """Of windows (batch, time) of rows of projected."""
        return self.pooled(self.states(projected[windows.T], valid), valid)[2]


@dataclass
class Adam:
    rate: float
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)
    t: int = 0

    def step(self, p: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            p[k] -= (self.rate * self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def gradients(net: Network, x: np.ndarray, windows: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean logistic loss, by parameter, and by row of x (words' features)."""
    p, k, tape = net.p, HIDDEN, []
    projected = net.project(x)
    rows = windows.T
    s = net.states(projected[rows], valid, tape)
    a, e, logit = net.pooled(s, valid)
    chance = sigmoid(logit)
    loss = float(-np.mean(label * np.log(chance + 1e-7) + (1 - label) * np.log(1 - chance + 1e-7)))
    d = ((chance - label) / len(label)).astype(np.float32)
    pool = np.einsum("tb,tbk->bk", e, s)
    grads = {"wo": pool.T @ d, "bo": d.sum(keepdims=True)}
    d_pool = d[:, None] * p["wo"]
    d_e = np.einsum("bk,tbk->tb", d_pool, s)
    d_score = e * (d_e - (e * d_e).sum(0))
    d_s = e[..., None] * d_pool + 0
    d_a = d_score[..., None] * p["va"] * (1 - a * a)
    grads["va"] = np.einsum("tb,tbk->k", d_score, a)
    grads["wa"], grads["ba"] = np.einsum("tbi,tbj->ij", s, d_a), d_a.sum((0, 1))
    d_s = (d_s + d_a @ p["wa"].T).reshape(*s.shape[:2], 2, k)
    d_in = np.zeros((*s.shape[:2], 2, 3 * k), np.float32)
    d_h, d_u = np.zeros((2, len(label), k), np.float32), np.zeros_like(p["u"])
    t_max = len(tape)
    for t in range(t_max - 1, -1, -1):
        back = t_max - 1 - t
        h, z, r, n, gn, m = tape[t]
        d_h = d_h + np.stack([d_s[t, :, 0], d_s[back, :, 1]])
        d_new, d_h = m * d_h, (1 - m) * d_h
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z, d_r = d_new * (h - n) * z * (1 - z), d_n * gn * r * (1 - r)
        d_g = np.concatenate([d_z, d_r, d_n * r], -1)
        d_h = d_h + d_new * z + d_g @ p["u"].transpose(0, 2, 1)
        d_u += h.transpose(0, 2, 1) @ d_g
        d_x = np.concatenate([d_z, d_r, d_n], -1)
        d_in[t, :, 0], d_in[back, :, 1] = d_x[0], d_x[1]
    grads["u"] = d_u
    order = np.argsort(rows.ravel(), kind="stable")
    own = rows.ravel()[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    d_rows = np.zeros((len(x), 2, 3 * k), np.float32)
    d_rows[own[first]] = np.add.reduceat(d_in.reshape(-1, 2, 3 * k)[order], first, axis=0)
    grads["w"] = np.einsum("vi,vdk->dik", x, d_rows)
    grads["b"] = d_rows.sum(0)[:, None]
    return grads, np.einsum("vdk,dik->vi", d_rows, p["w"]), loss


def pieces_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's windows as rows (windows, WINDOW), and which places hold words."""
    at = window_starts(len(ids))[:, None] + np.arange(WINDOW)
    valid = at < len(ids)
    return np.where(valid, ids[np.minimum(at, len(ids) - 1)], 0).astype(np.int32), valid


def train(texts: list[bytes], labels: list[int], seed: int = 0, steps: int = STEPS) -> Network:
    """The network fitted to labelled texts (1: toxic)."""
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    coded, label = [], []
    for t, y in zip(texts, labels, strict=True):
        if words := tokens(t):
            coded.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
            label.append(y)
    label, n_docs = np.array(label), len(coded)
    if len(set(label.tolist())) < 2:
        out = Network.fresh(rng)
        out.untrained = True
        return out
    part = np.zeros(n_docs, np.int64)
    for y in (0, 1):
        part[label == y] = np.arange((label == y).sum()) % FOLDS
    net, coded, values, rows = known_words(rng, list(number), coded, label, part)
    # a row for a word that was never seen, and the words that may become one in toxic documents too
    unseen, harmless = len(values), (values * net.spread + net.middle)[:, :2].max(1) <= 0
    values, rows, harmless = np.concatenate([values, -net.middle[None] / net.spread]), np.append(rows, 0), np.append(harmless, True)
    del number
    cut = [pieces_of(ids) for ids in coded]
    windows, valid = np.concatenate([w for w, _ in cut]), np.concatenate([v for _, v in cut])
    doc = np.repeat(np.arange(n_docs), [len(w) for w, _ in cut])
    del cut, coded
    toxic = label[doc] == 1
    dense, seen = Adam(0.01), np.full(len(net.p["word"]), DAMPING, np.float32)
    positive, negative = np.flatnonzero(toxic), np.flatnonzero(~toxic)

    def judged() -> tuple[np.ndarray, np.ndarray]:
        """All windows' logits and every document's largest."""
        found = all_logits(net, net.inputs(values, rows), windows, valid)
        best = np.full(n_docs, -1e9)
        np.maximum.at(best, doc, found)
        return found, best

    for step in range(steps):
        if step in (steps * 2 // 5, steps * 7 // 10):
            found, best = judged()
            positive = np.flatnonzero(toxic & ((found > 0) | (found == best[doc])))
            hard = negative[np.argsort(-found[negative], kind="stable")[: max(64, len(negative) // 20)]]
            negative = np.concatenate([np.flatnonzero(~toxic), *[hard] * 5])
        take = np.concatenate([rng.choice(positive, BATCH // 2), rng.choice(negative, BATCH // 2)])
        words = windows[take]
        rate = rng.random(len(take)) * (rng.random(len(take)) < FORGETFUL)
        gone = (rng.random(words.shape) < rate[:, None]) & (harmless[words] | ~toxic[take][:, None])
        own, held = np.unique(np.where(gone, unseen, words), return_inverse=True)
        x = net.inputs(values[own], rows[own])
        grads, d_x, _ = gradients(net, x, held.reshape(-1, WINDOW), valid[take].T.astype(np.float32), toxic[take].astype(np.float32))
        dense.step(net.p, grads)
        g = np.zeros_like(net.p["word"])
        np.add.at(g, rows[own], d_x[:, STATIC:].astype(np.float32))
        seen += (g * g).mean(1)
        net.p["word"] -= RATE * g / np.sqrt(seen)[:, None]
    net.scale, net.shift = scaled(judged()[1], label)
    return net


def known_words(rng: np.random.Generator, words: list[bytes], coded: list[np.ndarray], label: np.ndarray, part: np.ndarray) -> tuple[Network, list[np.ndarray], np.ndarray, np.ndarray]:
    """A network that knows the training words, and the documents as the other parts' counts show them.

    Documents come back as numbers of input rows, one for each word of each part; values are
    those rows' static values and rows their places in the learnt embedding.
    """
    # how many documents of each part and kind hold each word
    held, totals = np.zeros((len(words), 2 * FOLDS), np.float32), np.zeros((FOLDS, 2))
    for ids, y, p in zip(coded, label, part, strict=True):
        own = np.unique(ids)
        held[own, 2 * p + y] += 1
        totals[p, y] += len(own)

    def sighted(keys: np.ndarray, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(ids, of[:, k], len(keys)) for k in range(2 * FOLDS)]).astype(np.float32).reshape(FOLDS, 2, -1)

    # all n-grams of all words are many: their hashes are made twice, and only their rows kept
    known = [(f.word, np.unique(f.grams)) for _, f in in_parts(words)]
    word_keys, word_ids = np.unique(np.concatenate([w for w, _ in known]), return_inverse=True)
    gram_keys = np.unique(np.concatenate([g for _, g in known]))
    del known
    index, times, rows_of, sizes = Index(gram_keys), np.zeros((FOLDS, 2, len(gram_keys)), np.float32), [], []
    for first, f in in_parts(words):
        rows_of.append(index.rows(f.grams))
        sizes.append(f.size)
        times += sighted(gram_keys, rows_of[-1], held[first : first + len(f.size)][f.owners()])
    gram_ids, size = np.concatenate(rows_of), np.concatenate(sizes)
    del rows_of, sizes
    word_times = sighted(word_keys, word_ids, held)
    word_values, gram_values = evidence(word_times, totals), evidence(times, totals)
    del times
    common = np.flatnonzero(word_times.sum((0, 1)) >= LEARNT_DOCS)
    net = Network.fresh(rng, len(common))
    net.place = np.zeros(len(word_keys) + 1, np.int64)
    net.place[common] = np.arange(1, len(common) + 1)
    values, rows, out, begun = [], [], list(coded), 0
    for p in range(FOLDS):
        mine = np.flatnonzero(part == p)
        if not len(mine):
            continue
        own = np.unique(np.concatenate([coded[i] for i in mine]))
        chosen = np.zeros(len(words), bool)
        chosen[own] = True
        values.append(static(word_values[p][word_ids[own]], gram_values[p][gram_ids[np.repeat(chosen, size)]], size[own]))
        rows.append(net.place[word_ids[own]])
        for i in mine:
            out[i] = (np.searchsorted(own, coded[i]) + begun).astype(np.int32)
        begun += len(own)
    values = np.concatenate(values)
    net.middle, net.spread = values.mean(0), values.std(0) + np.float32(1e-6)
    # words and n-grams whose value is nothing need no entry
    told = gram_values[-1] != 0
    net.grams, net.gram_value = Index(gram_keys[told]), np.append(gram_values[-1][told], np.float32(0))
    told = (word_values[-1] != 0) | (net.place[:-1] > 0)
    net.words, net.word_value, net.place = Index(word_keys[told]), np.append(word_values[-1][told], np.float32(0)), np.append(net.place[:-1][told], 0)
    return net, out, (values - net.middle) / net.spread, np.concatenate(rows)


def all_logits(net: Network, x: np.ndarray, windows: np.ndarray, valid: np.ndarray) -> np.ndarray:
    projected, n = net.project(x), WORDS_AT_ONCE // WINDOW
    parts = [net.logits(projected, windows[i : i + n], valid[i : i + n].T.astype(np.float32)) for i in range(0, len(windows), n)]
    return np.concatenate(parts) if parts else np.zeros(0)


def scaled(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve over documents' logits.

    THRESHOLD is put into the gap between neighbouring logits that parts the labels best;
    of gaps that do about equally well the widest is taken. A flagged clean document weighs
    COST missed toxic ones.
    """
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], label[order]
    parted = np.cumsum(np.where(y == 0, COST / (y == 0).sum(), -1 / (y == 1).sum()))[:-1]
    gap = np.minimum(np.diff(x) / max(float(x[-1] - x[0]), 1e-6), 0.5)
    at = int(np.argmax(parted + 0.1 * gap))
    border = x[at] + BORDER * (x[at + 1] - x[at])
    slope = 8 / max(float(np.median(x[y == 1]) - np.median(x[y == 0])), 1e-3)
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * border)


def score_texts(net: Network, texts: list[bytes], known: dict) -> np.ndarray:
    """The score of every whole text; known keeps words' projections between calls."""
    out = np.zeros(len(texts))
    if net.untrained:
        return out
    words = [tokens(t) for t in texts]
    number = known.setdefault("number", {})
    fresh = list({w for ws in words for w in ws if w not in number})
    if len(number) + len(fresh) > REMEMBERED and number:
        number.clear()
        known.pop("projected", None)
        fresh = list({w for ws in words for w in ws})
    for at in range(0, len(fresh), 20_000):
        part = fresh[at : at + 20_000]
        rows = net.project(net.embed(features(part)))
        table_ = known.get("projected")
        need = len(number) + len(part)
        if table_ is None or len(table_) < need:
            grown = np.zeros((max(need, 2 * len(table_) if table_ is not None else 65536), 2, 3 * HIDDEN), np.float32)
            if table_ is not None:
                grown[: len(number)] = table_[: len(number)]
            known["projected"] = table_ = grown
        table_[len(number) : need] = rows
        number.update(zip(part, range(len(number), need), strict=True))
    projected = known.get("projected")
    filled = [i for i, ws in enumerate(words) if ws]
    if not filled:
        return out
    coded = [np.fromiter(map(number.__getitem__, words[i]), np.int64, len(words[i])) for i in filled]
    best = np.full(len(texts), -1e9)
    long = [(i, c) for i, c in zip(filled, coded, strict=True) if len(c) >= WINDOW]
    short = [(i, c) for i, c in zip(filled, coded, strict=True) if len(c) < WINDOW]
    if long:
        starts = [window_starts(len(c)) for _, c in long]
        base = np.r_[0, np.cumsum([len(c) for _, c in long])]
        flat = np.concatenate([c for _, c in long])
        begin = np.concatenate([s + b for s, b in zip(starts, base, strict=False)])
        owner = np.repeat([i for i, _ in long], [len(s) for s in starts])
        n = WORDS_AT_ONCE // WINDOW
        for a in range(0, len(begin), n):
            own = begin[a : a + n]
            np.maximum.at(best, owner[a : a + n], net.logits(projected, flat[own[:, None] + np.arange(WINDOW)], None))
    # short ones by length, so that they need little filling
    short.sort(key=lambda x: len(x[1]))
    for a in range(0, len(short), 256):
        part = short[a : a + 256]
        size = len(part[-1][1])
        ids, valid = np.zeros((len(part), size), np.int64), np.zeros((size, len(part)), np.float32)
        for k, (_, c) in enumerate(part):
            ids[k, : len(c)] = c
            valid[: len(c), k] = 1
        best[[i for i, _ in part]] = net.logits(projected, ids, valid)
    out[filled] = np.round(sigmoid(best[filled] * net.scale + net.shift), 6)
    return out


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list:
    """(text, toxic) of the training documents; only these reach the driver, each with its whole text.

    Ids are joined first, so that labels without a document take no place in the sample.
    Of the sample ids of either kind that hash lowest, those are taken one after the other
    whose texts still fit into SAMPLE_BYTES; then only these fetch their texts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).select(F.col("doc_id").alias("__id"), "__toxic")
    filled = docs.filter(F.col("text").rlike(r"[^\s]")).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.octet_length("text")).alias("__bytes"))
    known = known.join(filled, "__id")
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen, ids = known.filter("__toxic = 1").orderBy(*order).limit(sample).union(known.filter("__toxic <> 1").orderBy(*order).limit(sample)), []
    room = {True: SAMPLE_BYTES, False: SAMPLE_BYTES}
    for r in chosen.select("__id", (F.col("__toxic") == 1).alias("toxic"), "__bytes", F.xxhash64("__id").alias("h")).orderBy("h", "__id").collect():
        if r["__bytes"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["__bytes"]
            ids.append((r["__id"], int(r["toxic"])))
    wanted = docs.sparkSession.createDataFrame(ids, f"__id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("__id"))
    found = rows.groupBy("__id").agg(F.max(F.struct(F.octet_length("text").alias("n"), "text"))["text"].alias("text"), F.first("toxic").alias("toxic")).orderBy(*order).collect()
    return [((r["text"] or "").encode(), r["toxic"]) for r in found]


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    rows = training_rows(docs, labels, sample)
    net = train([t for t, _ in rows], [y for _, y in rows])
    del rows
    give_back()  # the driver has other stages to run
    return net


def score_batch(net: Network, texts: pa.Array, known: dict) -> np.ndarray:
    """The scores of a column of texts, a few megabytes at once."""
    score, part, held = [np.zeros(0)], [], 0
    for value in texts:
        part.append(value.as_py())
        held += len(part[-1])
        if held >= CHUNK_BYTES:
            score.append(score_texts(net, part, known))
            part, held = [], 0
    score.append(score_texts(net, part, known))
    return np.concatenate(score)


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every document, in the input's partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_batch(net, batch.column(1), known))], ["doc_id", "score"])

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(thrifty("toxicity", run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    net, inner = fitted(docs, labels), shielded(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            clean = score_batch(net, utf8_of(batch.column(at)), known) < THRESHOLD
            yield batch.filter(pa.array(clean, pa.bool_()))

    at = inner.columns.index("text")
    return inner.mapInArrow(thrifty("toxicity", run), inner.schema).toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, fitted(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
