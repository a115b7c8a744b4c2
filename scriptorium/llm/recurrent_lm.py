"""Language-model scores (operator 10): a gated recurrent network beside a unigram model of the whole corpus.

Words are 64-bit numbers (see word_hashes). Counts come from all training documents. The most frequent words are the network's
vocabulary, which grows with the corpus; one more symbol stands for any other word. The network (numpy, truncated
backpropagation through time, softmax factored by word classes) learns from every training document once: in each round
shards of the documents, dealt by a hash, start from the same weights, and what they learned is averaged; how the input is
split into tasks changes nothing. A document is scored in windows with the state carried from one to the next. A word outside the vocabulary gets the network's probability of
"any other word" times its share among those words by corpus counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, lower_ascii, remainder, table, words_of
from .word_hashes import word_numbers

#: The end of a document; no word contains a blank. Its number among the words' numbers.
END, END_NUMBER = "\n", 0
#: Bounds: words whose counts are sent to all tasks, words of a class, hidden units, least number of classes (they grow with the fourth root of the distinct words).
HEAD, CLASS, HIDDEN, CLASSES = 1 << 18, 32, 24, 64
#: Rounds of averaging, each over another part of the training documents; parallel streams, window, tokens of a shard in all rounds.
ROUNDS, STREAMS, WINDOW, SHARD = 4, 256, 32, 1_000_000
#: Windows that a shard should have in a round at least, as long as that leaves the streams named.
WINDOWS, LEAST_STREAMS = 32, 16
#: Numbers that are a class alone (the end, any other word); logarithm for places without a word; tokens whose classes are foretold at once.
ALONE, NEVER, BLOCK = 2, -60.0, 4096
#: Sums of weights that the driver gets in a round.
_SUMS = 8
#: Weights are summed up as whole numbers of so many steps to one, within a limit: 2^36 tokens of them fit 64 bits.
STEPS, LIMIT = 1 << 20, 64.0
#: Documents that step together when scoring, tokens that are trained on or counted at once, tokens gathered before scoring starts (the more, the more alike the lengths of those that step together).
TOGETHER, GATHERED, SCORED = 1024, 1_000_000, 4_000_000


def tokens_of(text: str | None) -> list[str]:
    return [*words_of(lower_ascii(text)), END] if text else [END]


def _columns(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(table.take(rows, 0).T)


class Gru:
    """A gated recurrent network over word numbers 0..n-1; 0 is the end of a document, 1 any other word. These two are classes of their own.

    Weights: x, u, uc, b of the update gate, the reset gate and the candidate; c of the classes, o of the words in each class
    (the last column of both is the bias). Inside, streams stand side by side in each unit's row, so that numpy's loops are long.
    """

    def __init__(self, n: int, hidden: int = HIDDEN, size: int = CLASS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.n, self.h, self.size, inner = n, hidden, size, max(1, -(-(n - ALONE) // size))
        self.classes = ALONE + inner
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.w = {
            "x": draw(n, 3 * hidden), "u": draw(2 * hidden, hidden), "uc": draw(hidden, hidden), "b": np.zeros(3 * hidden, np.float32),
            "c": draw(self.classes, hidden + 1), "o": draw(inner, size, hidden + 1),
        }
        self.prime(np.ones(n))

    def prime(self, counts: np.ndarray) -> None:
        """Start from the words' frequencies."""
        share = (counts + 0.5) / (counts + 0.5).sum()
        p = np.zeros((self.classes - ALONE) * self.size)
        p[: self.n - ALONE] = share[ALONE:]
        p = p.reshape(-1, self.size)
        held = np.maximum(p.sum(1), 1e-12)
        self.w["c"][:, -1] = np.log([*share[:ALONE], *held])
        self.w["o"][:, :, -1] = np.where(p > 0, np.log(np.maximum(p, 1e-30) / held[:, None]), NEVER)  # places of the last class that no word has

    def _gates(self, a: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state after h. a: what the words add to gates and candidate, which become what the network makes of them."""
        k = self.h
        zr, c = a[: 2 * k], a[2 * k :]
        zr += self.w["u"] @ h
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c += self.w["uc"] @ (zr[k:] * h)
        np.tanh(c, out=c)
        new = c - h
        new *= zr[:k]
        new += h
        return new

    def step(self, word: np.ndarray, h: np.ndarray) -> tuple:
        """Gates, candidate and state after one word of each stream, a row for each stream."""
        a, k = _columns(self.w["x"] + self.w["b"], word), self.h
        new = self._gates(a, h.T)
        return a[:k].T, a[k : 2 * k].T, a[2 * k :].T, new.T

    def log_prob(self, hidden: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target; with grads, also what flows back to hidden."""
        lp, back = self._log_probs(hidden.T, target, grads)
        return lp, None if back is None else back.T

    def _log_probs(self, hidden: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log_prob for states that are columns, in blocks that a processor's cache holds."""
        out, back = np.empty(len(target), hidden.dtype), None if grads is None else np.empty_like(hidden)
        for at in range(0, len(target), BLOCK):
            some = slice(at, at + BLOCK)
            self._log_prob(hidden[:, some], target[some], out[some], None if back is None else back[:, some], grads)
        return out, back

    @staticmethod
    def _shares(logits: np.ndarray, at: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(natural logarithm of the share at each column's place, sums); logits become exponentials."""
        logits -= logits.max(0)
        picked = logits[at, columns]
        np.exp(logits, out=logits)
        total = logits.sum(0)
        return picked - np.log(total), total

    def _log_prob(self, hidden: np.ndarray, target: np.ndarray, out: np.ndarray, back: np.ndarray | None, grads: dict | None) -> None:
        w = self.w
        one = np.ones((self.h + 1, len(target)), hidden.dtype)
        one[:-1] = hidden
        cls = np.where(target < ALONE, target, (target - ALONE) // self.size + ALONE)
        columns = np.arange(len(target))
        logits = w["c"] @ one
        out[:], total = self._shares(logits, cls, columns)
        if grads is not None:
            logits /= total
            logits[cls, columns] -= 1
            grads["c"] += logits @ one.T
            back[:] = w["c"][:, :-1].T @ logits
        # words of one class stand together, so that each class is one product and the rest is done for all at once
        order = np.argsort(cls.astype(np.int16) if self.classes < 1 << 15 else cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(ALONE, self.classes + 1))
        order = order[edges[0] :]
        if not len(order):
            return
        edges = (edges - edges[0]).tolist()
        held = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        own, at, columns = one.take(order, 1), (target[order] - ALONE) % self.size, columns[: len(order)]
        logits = np.empty((self.size, len(order)), hidden.dtype)
        for k, a, b in held:
            logits[:, a:b] = w["o"][k] @ own[:, a:b]
        lp, total = self._shares(logits, at, columns)
        out[order] += lp
        if grads is not None:
            logits /= total
            logits[at, columns] -= 1
            flow = np.empty((self.h, len(order)), hidden.dtype)
            for k, a, b in held:
                grads["o"][k] += logits[:, a:b] @ own[:, a:b].T
                flow[:, a:b] = w["o"][k][:, :-1].T @ logits[:, a:b]
            back[:, order] += flow

    def train(self, flat: np.ndarray, rate: float, streams: int = STREAMS, window: int = WINDOW, adam: dict | None = None) -> float:
        """Truncated backpropagation through time with Adam over documents that follow each other, each closed by its end, dealt to streams; the state starts anew after an end. Returns the mean loss."""
        streams = max(1, min(streams, max(LEAST_STREAMS, len(flat) // (WINDOWS * window)), len(flat) // (2 * window)))
        steps = len(flat) // streams
        if steps < 2:
            return 0.0
        grid = np.ascontiguousarray(flat[: steps * streams].reshape(streams, steps).T)
        inputs = np.vstack([np.zeros((1, streams), grid.dtype), grid[:-1]])
        adam = {} if adam is None else adam
        if not adam:
            adam |= {"t": 0, "m": {k: np.zeros_like(v) for k, v in self.w.items()}, "v": {k: np.zeros_like(v) for k, v in self.w.items()}}
        h, loss = np.zeros((streams, self.h), np.float32), 0.0
        for at in range(0, steps, window):
            y = grid[at : at + window]
            g, lost, h = self.gradient(inputs[at : at + window], y, h)
            loss += lost
            adam["t"] += 1
            t, scale = adam["t"], np.float32(1 / y.size)
            for k, p in self.w.items():
                d, m, v = g[k], adam["m"][k], adam["v"][k]
                d *= scale
                m += np.float32(0.1) * (d - m)
                v += np.float32(0.01) * (d * d - v)
                p -= np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-6))
        return loss / grid.size

    def gradient(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, float, np.ndarray]:
        """Gradients of the summed loss of a window, the loss, and the state after it. x and y: words before and words to foretell, a row for each step."""
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        inputs, live, h = self.w["x"] + self.w["b"], (x != 0).astype(h.dtype), np.ascontiguousarray(h.T)
        a = np.empty((len(x), 3 * self.h, x.shape[1]), h.dtype)
        before, after = np.empty((len(x), *h.shape), h.dtype), np.empty((self.h, *x.shape), h.dtype)
        for t in range(len(x)):
            a[t] = inputs.take(x[t], 0).T
            np.multiply(h, live[t], out=before[t])
            after[:, t] = h = self._gates(a[t], before[t])
        lp, back = self._log_probs(after.reshape(self.h, -1), y.reshape(-1), g)
        self._back(x, a, before, live, back.reshape(after.shape), g)
        return g, -float(lp.sum()), h.T

    def _back(self, x: np.ndarray, a: np.ndarray, before: np.ndarray, live: np.ndarray, back: np.ndarray, g: dict) -> None:
        k, u, uc = self.h, self.w["u"].T, self.w["uc"].T
        da, reset, dh = np.empty((3 * k, *x.shape), a.dtype), np.empty((k, *x.shape), a.dtype), np.zeros_like(before[0])
        own = np.empty_like(a[0])
        for t in range(len(x) - 1, -1, -1):
            z, r, c, h = a[t, :k], a[t, k : 2 * k], a[t, 2 * k :], before[t]
            d, dz, dr, dc = back[:, t] + dh, own[:k], own[k : 2 * k], own[2 * k :]
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= z
            dc *= d
            drh = uc @ dc
            keep = 1 - z
            np.subtract(c, h, out=dz)
            dz *= z
            dz *= keep
            dz *= d
            d *= keep
            drh *= r
            d += drh
            drh *= h
            np.multiply(drh, 1 - r, out=dr)
            d += u @ own[: 2 * k]
            dh = d
            dh *= live[t]
            da[:, t] = own
            np.multiply(r, h, out=reset[:, t])
        da = da.reshape(3 * k, -1)
        g["u"] += da[: 2 * k] @ before.transpose(1, 0, 2).reshape(k, -1).T
        g["uc"] += da[2 * k :] @ reset.reshape(k, -1).T
        rows = x.reshape(-1)
        for i in range(ALONE):  # more than half of all tokens
            g["x"][i] = da @ (rows == i).astype(da.dtype)
        order = np.flatnonzero(rows >= ALONE)
        if len(order):
            order = order[np.argsort(rows[order].astype(np.int16) if self.n < 1 << 15 else rows[order], kind="stable")]
            rows = rows[order]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            g["x"][rows[first]] = np.add.reduceat(da.take(order, 1), first, axis=1).T
        g["b"] += g["x"].sum(0)

    def score(self, docs: list[np.ndarray], together: int = TOGETHER, window: int = WINDOW) -> np.ndarray:
        """log10 probability of each whole document. Documents of like length step together; states live through all windows."""
        out, inputs = np.zeros(len(docs)), self.w["x"] + self.w["b"]
        order = np.argsort([-len(d) for d in docs], kind="stable")
        for at in range(0, len(order), together):
            some = order[at : at + together]
            sizes = np.array([len(docs[i]) for i in some])
            flat, first = np.concatenate([docs[i] for i in some]), np.cumsum(sizes) - sizes
            h, last, total = np.zeros((self.h, len(some)), inputs.dtype), np.zeros(len(some), flat.dtype), np.zeros(len(some))
            for start in range(0, sizes[0], window):
                hs, who, targets = [], [], []
                for t in range(start, min(start + window, sizes[0])):
                    n = int(np.searchsorted(-sizes, -t))  # sizes fall: those with more than t tokens
                    h = self._gates(_columns(inputs, last[:n]), h[:, :n])
                    last = flat[first[:n] + t]
                    hs.append(h)
                    who.append(np.arange(n))
                    targets.append(last)
                lp, _ = self._log_probs(np.concatenate(hs, axis=1), np.concatenate(targets))
                total += np.bincount(np.concatenate(who), lp, minlength=len(some))
            out[some] = total
        return out / math.log(10)


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, numbers of their tokens, tokens before each row and at the end)."""
    for first, after, words, edges in word_numbers(batch.column("text")):
        yield first, after, np.insert(words, edges[1:], np.uint64(END_NUMBER)), edges + np.arange(len(edges))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token, by its number, occurs in texts(text), added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting = np.empty(0, np.uint64), np.empty(0, np.int64), []

        def merged():
            h, c = np.concatenate([keys, *(w[0] for w in waiting)]), np.concatenate([sums, *(w[1] for w in waiting)])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.concatenate([h[:1] == h[:1], h[1:] != h[:-1]]))
            return h[first], np.add.reduceat(c, first) if len(first) else c

        def out():
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(sums[at : at + 100_000])], names=["h", "c"])

        for batch in batches:
            for _, _, words, _ in _numbered(batch):
                waiting.append(np.unique(words, return_counts=True))
                if sum(len(w[0]) for w in waiting) > GATHERED:
                    (keys, sums), waiting = merged(), []
                    if len(keys) > 2 * GATHERED:
                        yield from out()
                        keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        yield from out()

    return _texts(texts).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, head: int) -> list[tuple[int, int]]:
    """(h, c) of the end and the most frequent words, as many classes of like counts as hold no more than `head` words; what a task sends follows from that bound."""
    level = F.floor(F.log2("c") * 16)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # a thousand classes at most
    least, held = math.inf, 0
    for r in sizes:
        held += r.n
        if held > head:
            break
        least = r.level
    some = F.lit(False) if least == math.inf else level >= F.lit(int(least))
    return [(r.h, r.c) for r in counts.where(some | (F.col("h") == END_NUMBER)).select("h", "c").collect()]


class Vocabulary:
    """The head of the word counts, sorted by the words' numbers: count of each, and its number in the network; 0 there is the end, 1 any other word."""

    def __init__(self, head: list[tuple[int, int]], total: int, distinct: int, size: int | None = None):
        size = size or CLASS * max(CLASSES, round(distinct**0.25))
        numbers = np.array([h for h, _ in head], np.int64).view(np.uint64)
        counts = np.array([c for _, c in head], np.int64)
        order = np.argsort(numbers)
        self.total, self.distinct, self.h, self.c = total, distinct, numbers[order], counts[order]
        word = self.h != END_NUMBER
        best = np.flatnonzero(word)[np.lexsort((self.h[word], -self.c[word]))][: size - 2]
        self.size = len(best) + 2
        self.number = np.ones(len(self.h), np.int32)
        self.number[best] = np.arange(2, len(best) + 2)
        self.number[~word] = 0
        ends = int(self.c[~word].sum())
        held = ends + int(self.c[best].sum())
        kinds = len(best) + int((~word).sum())
        #: Corpus weight of all words outside the network's vocabulary, with one unknown kind.
        self.other = total - held + 0.5 * (distinct - kinds + 1)
        self.counts = np.array([ends, total - held, *self.c[best]], float)
        self.log = np.log10(self.c + 0.5)

    def network(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of the network, sorted, their numbers there)."""
        inside = self.number != 1
        return np.append(self.h[inside], np.uint64(END_NUMBER)) if not inside.any() else self.h[inside], np.zeros(1, np.int32) if not inside.any() else self.number[inside]

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the head, -1 where it is not there."""
        if not len(self.h):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.h, words), len(self.h) - 1)
        return np.where(self.h[at] == words, at, -1)

    def numbers(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), np.int32)
        out[places >= 0] = self.number[places[places >= 0]]
        out[words == END_NUMBER] = 0
        return out


def _flat(model: Gru) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in model.w.values()])


def _unflat(model: Gru, flat: np.ndarray) -> None:
    at = 0
    for k, v in model.w.items():
        model.w[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size


def shards_of(vocabulary: Vocabulary) -> int:
    return max(1, vocabulary.total // SHARD)


def shard_tasks(spark: SparkSession, shards: int) -> int:
    return min(shards, max(shards // 8, 4 * spark.sparkContext.defaultParallelism))


def training_shards(training: DataFrame, vocabulary: Vocabulary, rounds: int) -> DataFrame:
    """(turn, shard, docs): the numbers of the training documents' tokens, written once.

    A hash of id and text deals each document to one round and one shard, and orders it there, so that what a shard learns
    does not depend on how the input is split. A shard of a round has about SHARD / rounds tokens, two or four bytes each.
    """
    shards = shards_of(vocabulary)
    sent = training.sparkSession.sparkContext.broadcast(vocabulary.network())
    kind = np.int16 if vocabulary.size < 1 << 15 else np.int32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = sent.value
        for batch in batches:
            for first, after, tokens, edges in _numbered(batch):
                at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
                ids = np.where(words[at] == tokens, numbers[at], 1).astype(kind)
                ids[tokens == END_NUMBER] = 0
                docs = pa.Array.from_buffers(pa.large_binary(), after - first, [None, pa.py_buffer((edges * ids.itemsize).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, after - first), docs.cast(pa.binary())], names=["key", "ids"])

    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    encoded = training.select(key.alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "key long, ids binary")
    place = F.pmod("key", F.lit(rounds * shards))
    dealt = encoded.select((place % rounds).cast("int").alias("turn"), F.floor(place / rounds).alias("shard"), "key", "ids")
    gathered = dealt.repartition(shard_tasks(training.sparkSession, shards), "shard").groupBy("turn", "shard").agg(F.array_sort(F.collect_list(F.struct("key", "ids"))).alias("docs"))
    return cut(gathered.select("turn", "shard", F.col("docs.ids").alias("docs")), "turn")


def train_model(training: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = 0.04) -> Gru:
    """The network, trained on all documents of training(doc_id, text).

    All rounds together take each document once. In a round each shard starts from the same weights; the shards' results,
    weighted by tokens, are summed up as whole numbers, so that the sums are the same in any order, first in the tasks, then
    16 tasks at a time, and the sums averaged.
    """
    sc = training.sparkSession.sparkContext
    model = Gru(vocabulary.size)
    model.prime(vocabulary.counts)
    shards, size = training_shards(training, vocabulary, rounds), vocabulary.size
    kind, tasks = np.int16 if size < 1 << 15 else np.int32, shard_tasks(training.sparkSession, shards_of(vocabulary))
    for i in range(rounds):
        now, speed = sc.broadcast(_flat(model)), rate * (1 - i / rounds)

        def learn(batches: Iterator[pa.RecordBatch], now=now, speed=speed) -> Iterator[pa.RecordBatch]:
            net, n, total = Gru(size), 0, None
            for batch in batches:
                for docs in batch.column("docs"):
                    tokens = np.concatenate([np.frombuffer(d.as_buffer(), kind) for d in docs.values])
                    _unflat(net, now.value)
                    adam = {}
                    for at in range(0, len(tokens), GATHERED):
                        net.train(tokens[at : at + GATHERED], speed, adam=adam)
                    own = np.rint(np.clip(_flat(net).astype(np.float64), -LIMIT, LIMIT) * STEPS).astype(np.int64) * len(tokens)
                    n, total = n + len(tokens), own if total is None else total + own
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, None
            for batch in batches:
                for k, w in zip(batch.column("n").to_pylist(), batch.column("w").to_pylist(), strict=True):
                    own = np.frombuffer(w, np.int64)
                    n, total = n + k, own if total is None else total + own
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])

        # dealt anew, so that tasks are even and no longer at larger inputs; the order of shards does not matter
        learned = shards.where(F.col("turn") == i).select("docs").repartition(tasks).mapInArrow(learn, "n long, w binary")
        left = tasks
        while left > _SUMS:
            left = max(_SUMS, left // 16)
            learned = learned.repartition(left).mapInArrow(add, "n long, w binary")
        sums = learned.collect()  # _SUMS at most
        if sums:
            _unflat(model, sum(np.frombuffer(r.w, np.int64) for r in sums) / (sum(r.n for r in sums) * STEPS))
        now.unpersist()
    discard(shards)
    return model


def lm_scores(docs: DataFrame, training: DataFrame, vocabulary: int | None = None, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """Score docs(doc_id, text, ...) with models of training(doc_id, text).

    Returns the columns of docs but for text, which is not carried along, and n_tokens, n_known (tokens seen in training),
    train_tokens (all long), base_score (unigram log10 probability) and score (the network's log10 probability of the whole
    text). Null, empty and blank texts are the end token alone. Rows are scored one by one, repeats alike; other columns pass
    through, columns named like the new ones are replaced. Without training rows every token is unknown and all words share one
    kind; an empty docs table gives an empty table. Words are told apart by 64-bit numbers.
    """
    spark = docs.sparkSession
    counts = cut(count_words(training))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words = Vocabulary(head_of(counts, head), sums.n, sums.v, vocabulary)
    model = train_model(training, words, rounds)
    sent = spark.sparkContext.broadcast((words, model))
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = docs.drop("text", *new)
    inner = spark.createDataFrame([], "n long, head long, base double, other long, other_base double, net double, tail array<long>").schema
    rows = docs.select(F.struct(*kept.columns).alias("row") if kept.columns else F.lit(None).cast("int").alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = sent.value
        waiting, size = [], 0
        for batch in batches:
            for part in _first_pass(batch, vocab):
                waiting.append(part)
                size += len(part[2])
                if size > SCORED:
                    yield from _second_pass(waiting, net)
                    waiting, size = [], 0
        if waiting:
            yield from _second_pass(waiting, net)

    schema = rows.select("row").schema
    for field in inner.fields:
        schema = schema.add(field)
    scored = cut(rows.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id()))
    tail = scored.select("id", F.explode("tail").alias("h"))
    found = tail.join(counts, "h").groupBy("id").agg(F.count("*").alias("seen"), F.sum(F.log10(F.col("c") + 0.5)).alias("seen_base"))
    # tokens of the tail that training never saw count 0.5
    unseen = F.col("n") - F.col("head") - F.coalesce("seen", F.lit(0))
    tail_base = F.coalesce("seen_base", F.lit(0.0)) + unseen * math.log10(0.5)
    end_base = 0.0 if (words.h == END_NUMBER).any() else math.log10(0.5)  # the network foretells ends whether training saw any or not
    whole = math.log10(words.total + 0.5 * (words.distinct + 1))
    out = scored.drop("tail").join(found, "id", "left")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in kept.columns],
        F.col("n").alias("n_tokens"),
        (F.col("head") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + tail_base - F.col("n") * whole).alias("base_score"),
        (F.col("net") + F.col("other_base") + tail_base - F.lit(end_base) - F.col("other") * math.log10(words.other)).alias("score"),
    )


def _first_pass(batch: pa.RecordBatch, vocab: Vocabulary) -> Iterator[tuple]:
    """(rows as they came, tokens before each, numbers in the network, sums by row, words outside the head)."""
    for first, after, words, edges in _numbered(batch):
        places = vocab.find(words)
        ids = vocab.numbers(words, places)
        inside = places >= 0
        log = np.where(inside, vocab.log[places] if len(vocab.log) else 0.0, 0.0)
        add = lambda x, edges=edges: np.add.reduceat(x, edges[:-1])  # noqa: E731  (a row has its end at least)
        tail = ~inside & (words != END_NUMBER)
        sums = {
            "n": np.diff(edges), "head": add(inside.astype(np.int64)), "base": add(log), "other": add((ids == 1).astype(np.int64)),
            "other_base": add(np.where(ids == 1, log, 0.0)),
        }
        ends = np.concatenate([[0], np.cumsum(tail)])[edges]
        yield batch.column("row").slice(first, after - first), edges, ids, sums, (words[tail].view(np.int64), ends)


def _second_pass(waiting: list[tuple], net: Gru) -> Iterator[pa.RecordBatch]:
    ids = [x for _, edges, numbers, _, _ in waiting for x in np.split(numbers, edges[1:-1])]
    scores, at = net.score(ids), 0
    for row, edges, _, sums, (tail, ends) in waiting:
        n = len(edges) - 1
        yield pa.RecordBatch.from_arrays(
            [row, pa.array(sums["n"]), pa.array(sums["head"]), pa.array(sums["base"]), pa.array(sums["other"]), pa.array(sums["other_base"]), pa.array(scores[at : at + n]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tail, pa.int64()))],
            names=["row", "n", "head", "base", "other", "other_base", "net", "tail"],
        )
        at += n


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scores(docs, docs.where(remainder() != 1))
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
