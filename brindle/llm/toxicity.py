"""Toxicity: a bidirectional gated recurrent network with attention, in numpy.

A word comes in as the vector of its hash and the mean vector of its hashed
character n-grams.  Two gated recurrent layers read a window of WINDOW words from
both ends, attention pools their states and a logistic unit scores the window.
Every text is covered by overlapping windows, STRIDE words apart; its score is the
greatest of them.

Labels hold for whole texts, so training picks each text's highest windows with
the present weights, learns from those, and picks again.  It is fitted on the
driver to a bounded sample: at most SAMPLE labelled texts of each class, those of
least hashed id, and at most SAMPLE_CHARS characters in all (a text that would exceed
them is passed over).  Scoring covers every word of every text, in the tasks.

Edge cases: a null text, an empty one and one without words are one empty window;
texts shorter than a window are padded; with one class or none to learn from the
score is the share of toxic labels (0 if there are none); null labels and texts
are not learned from; repeated rows count as often as they come; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.arrow import slices

WINDOW, STRIDE, SAMPLE = 20, 10, 1500
WORDS, GRAMS, WIDTH, HIDDEN = 32768, 65536, 8, 8
SAMPLE_CHARS = 40_000_000
EPOCHS, BATCH, RATE, SEED = 8, 128, 0.01, 5
#: Share of a batch's words that are read by their characters alone while learning.
BLANKED = 0.5
#: Words remembered by a task at most; windows, or words, worked on at a time.
MEMORY, BLOCK = 200_000, 4096
_WORD = re.compile(r"\w+")
_NONE = np.zeros(0, dtype=np.int64)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word; buckets of all its n-grams (3 to 5 characters,
    edges included) and the number of the word that each n-gram is of."""
    joined = np.frombuffer("".join(f"\x02{w}\x03\x00\x00\x00" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), sizes + 5)
    grams, owners, code = [], [], np.zeros(len(joined), dtype=np.uint64)
    for n in range(5):
        code[: len(joined) - n] = code[: len(joined) - n] * np.uint64(0x9E3779B97F4A7C15) + joined[n:]
        if n >= 2:
            good = np.flatnonzero((joined[n:] != 0) & (joined[: len(joined) - n] != 0) & (owner[n:] == owner[: len(joined) - n]))
            c = code[good] * np.uint64(0xD1B54A32D192ED03)
            grams.append((c >> np.uint64(40)) % np.uint64(GRAMS))
            owners.append(owner[good])
    starts = np.concatenate(([0], np.cumsum(sizes + 5)[:-1])) if len(words) else _NONE
    place = np.arange(len(joined)) - np.repeat(starts, sizes + 5)
    whole = np.zeros(len(words), dtype=np.uint64)
    np.add.at(whole, owner, joined * np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 6, 0xC4CEB9FE1A85EC53, dtype=np.uint64))[place])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return ((whole >> np.uint64(37)) % np.uint64(WORDS)).astype(np.int64), np.concatenate(grams)[order].astype(np.int64), np.concatenate(owners)[order]


def features_in_blocks(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many words, with the scratch memory of a block of them."""
    parts = [features(words[i : i + BLOCK]) for i in range(0, len(words), BLOCK)]
    owners = [o + i * BLOCK for i, (_, _, o) in enumerate(parts)]
    return tuple(np.concatenate(x).astype(np.int32) if parts else _NONE for x in ([b for b, _, _ in parts], [g for _, g, _ in parts], owners))


def starts_of(n: int) -> np.ndarray:
    """First words of the windows over n words; the last window ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights, the forward pass, and its gradient."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"word": normal(WORDS, WIDTH, scale=0.1), "gram": normal(GRAMS, WIDTH, scale=0.1), "att": normal(2 * HIDDEN, HIDDEN), "key": normal(HIDDEN), "out": normal(2 * HIDDEN), "bias": np.zeros(1, dtype=np.float32)}
        for d in "lr":
            self.w |= {f"x{d}": normal(2 * WIDTH, 3 * HIDDEN), f"h{d}": normal(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, dtype=np.float32)}

    def inputs(self, buckets: np.ndarray, grams: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """The input vector of each word; every word has an n-gram."""
        counts = np.bincount(owners, minlength=len(buckets)).astype(np.float32)
        first = np.concatenate(([0], np.cumsum(counts[:-1]))).astype(np.int64)
        chars = np.add.reduceat(self.w["gram"][grams], first, axis=0) / counts[:, None] if len(grams) else np.zeros((0, WIDTH), dtype=np.float32)
        return np.concatenate((self.w["word"][buckets], chars), axis=1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.w[f"x{d}"] + self.w[f"b{d}"] for d in "lr"}

    def _layer(self, d: str, p: np.ndarray, ids: np.ndarray, real: np.ndarray | None, keep: list | None) -> np.ndarray:
        n, length = ids.shape
        h, states = np.zeros((n, HIDDEN), dtype=np.float32), np.empty((length, n, HIDDEN), dtype=np.float32)
        wh = self.w[f"h{d}"]
        for t in range(length) if d == "l" else range(length - 1, -1, -1):
            x, g = p[ids[:, t]], h @ wh
            gates = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            after = new + z * (h - new)
            if real is not None:
                after = np.where(real[:, t, None], after, h)
            if keep is not None:
                keep.append((t, h, r, z, new, g[:, 2 * HIDDEN :]))
            h = states[t] = after
        return states

    def forward(self, p: dict[str, np.ndarray], ids: np.ndarray, real: np.ndarray | None, tape: dict | None = None) -> np.ndarray:
        """Logit of each window; ids index rows of p; real marks words that are no padding."""
        keep = {d: [] if tape is not None else None for d in "lr"}
        states = np.concatenate([self._layer(d, p[d], ids, real, keep[d]) for d in "lr"], axis=2)
        seen = np.tanh(states @ self.w["att"])
        score = seen @ self.w["key"]
        weight = np.exp(np.clip(score, -30, 30))
        if real is not None:
            weight = weight * real.T
        weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (states * weight[:, :, None]).sum(axis=0)
        if tape is not None:
            tape |= {"keep": keep, "states": states, "seen": seen, "weight": weight, "pooled": pooled}
        return pooled @ self.w["out"] + self.w["bias"]

    def gradient(self, x: np.ndarray, ids: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss by weight, and by input vector."""
        w, tape = self.w, {}
        logit = self.forward(self.projected(x), ids, real, tape)
        dl = ((_sigmoid(logit) - target) / len(ids)).astype(np.float32)
        states, seen, weight = tape["states"], tape["seen"], tape["weight"]
        g = {"out": tape["pooled"].T @ dl, "bias": dl.sum(keepdims=True)}
        dpool = dl[:, None] * w["out"]
        dweight = (states * dpool).sum(axis=2)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["key"] = np.einsum("tnh,tn->h", seen, dscore)
        dseen = dscore[:, :, None] * w["key"] * (1 - seen * seen)
        g["att"] = np.einsum("tni,tnj->ij", states, dseen)
        dstates = weight[:, :, None] * dpool + dseen @ w["att"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("lr"):
            gx, gh, gb = (np.zeros_like(w[f"{c}{d}"]) for c in "xhb")
            carried = np.zeros((len(ids), HIDDEN), dtype=np.float32)
            for t, h, r, z, new, rec in reversed(tape["keep"][d]):
                on = real[:, t, None]
                total = dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carried
                da = total * on
                dnew = da * (1 - z) * (1 - new * new)
                dz = da * (h - new) * z * (1 - z)
                dr = dnew * rec * r * (1 - r)
                dg = np.concatenate((dr, dz, dnew * r), axis=1)
                dp = np.concatenate((dr, dz, dnew), axis=1)
                gh += h.T @ dg
                gb += dp.sum(axis=0)
                gx += x[ids[:, t]].T @ dp
                np.add.at(dx, ids[:, t], dp @ w[f"x{d}"].T)
                carried = dg @ w[f"h{d}"].T + da * z + total * ~on
            g |= {f"x{d}": gx, f"h{d}": gh, f"b{d}": gb}
        return g, dx


def scan(net: Network, rows: dict[str, np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Logit and text number of every window; texts hold the numbers of their words' rows."""
    flat = np.concatenate(texts) if texts else _NONE
    begin = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    logits, owners = [], []
    full = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
    if full:
        starts = [starts_of(len(texts[i])) + begin[i] for i in full]
        at = np.concatenate(starts)
        for i in range(0, len(at), BLOCK):
            logits.append(net.forward(rows, flat[at[i : i + BLOCK, None] + np.arange(WINDOW)], None))
        owners.append(np.repeat(full, [len(s) for s in starts]))
    short = [i for i, t in enumerate(texts) if len(t) < WINDOW]
    for i in range(0, len(short), BLOCK):
        some = short[i : i + BLOCK]
        real = np.arange(WINDOW) < np.asarray([len(texts[j]) for j in some])[:, None]
        ids = np.zeros(real.shape, dtype=np.int64)
        ids[real] = np.concatenate([texts[j] for j in some])
        padded = rows if len(rows["l"]) else {d: np.zeros((1, 3 * HIDDEN), dtype=np.float32) for d in "lr"}
        logits.append(net.forward(padded, ids, real))
        owners.append(np.asarray(some))
    return np.concatenate(logits), np.concatenate(owners)


class Scorer:
    """Scores whole texts; remembers the projections of the words met."""

    def __init__(self, network: Network):
        self.net = network
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = {d: np.zeros((0, 3 * HIDDEN), dtype=np.float32) for d in "lr"}

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and text number of every window."""
        fresh = list(set(chain.from_iterable(texts)) - self.number.keys())
        if len(self.number) + len(fresh) > MEMORY:
            self.forget()
            fresh = list(set(chain.from_iterable(texts)))
        if fresh:
            self.number |= zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True)
            new = self.net.projected(self.net.inputs(*features(fresh)))
            self.rows = {d: np.concatenate((self.rows[d], new[d])) for d in "lr"}
        return scan(self.net, self.rows, [np.fromiter(map(self.number.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts])

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """The greatest window score of each text."""
        best = np.full(len(texts), -np.inf)
        logits, owners = self.windows(texts)
        np.maximum.at(best, owners, logits)
        return _sigmoid(best)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | float:
    """A network for labelled texts, or the share of toxic ones if that is 0 or 1."""
    y = np.asarray(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    # words as numbers, text by text: the words themselves are held once
    number: dict[str, int] = {}
    ids = [np.asarray([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int64) for t in texts]
    names = sorted(number)
    place_of = np.empty(len(names), dtype=np.int64)
    place_of[[number[w] for w in names]] = np.arange(len(names))
    ids = [place_of[d] for d in ids]
    buckets, grams, owners = features_in_blocks(names)
    n_names = len(names)
    del number, names, place_of
    net = Network(seed)

    # first vectors: how much oftener a bucket occurs in toxic texts
    edges = np.searchsorted(owners, np.arange(n_names + 1))
    for key, size, of in (("word", WORDS, lambda u: buckets[u]), ("gram", GRAMS, lambda u: np.concatenate([grams[edges[i] : edges[i + 1]] for i in u]) if len(u) else _NONE)):
        seen = np.zeros((2, size))
        for d, label in zip(ids, y, strict=True):
            seen[int(label), np.unique(of(np.unique(d)))] += 1
        rate = (seen + 0.5) / (np.asarray([(y == 0).sum(), (y == 1).sum()])[:, None] + 1)
        odds = np.log(rate[1]) - np.log(rate[0])
        error = np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
        net.w[key][:, 0] = np.clip(odds / error, -4, 4) / 2
    strength = net.w["word"][buckets, 0] + np.add.reduceat(net.w["gram"][grams, 0], edges[:-1]) / np.diff(edges)

    starts = [starts_of(len(d)) for d in ids]
    rng, step = np.random.default_rng(seed), 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}

    def projections() -> dict[str, np.ndarray]:
        parts = []
        for i in range(0, n_names, BLOCK):
            j = min(i + BLOCK, n_names)
            parts.append(net.projected(net.inputs(buckets[i:j], grams[edges[i] : edges[j]], owners[edges[i] : edges[j]] - i)))
        return {d: np.concatenate([p[d] for p in parts]) if parts else np.zeros((0, 3 * HIDDEN), dtype=np.float32) for d in "lr"}

    for epoch in range(epochs):
        if epoch:
            logits, owner = scan(net, projections(), ids)
            order = np.split(logits[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(ids)))[:-1])
        else:
            order = [np.asarray([strength[d[s : s + WINDOW]].max() if len(d) else 0 for s in st]) for d, st in zip(ids, starts, strict=True)]
        chosen: list[tuple[int, int]] = []
        for i, scores in enumerate(order):
            top = np.argsort(-scores)
            picks = [top[0]] if y[i] else [*top[:2], rng.integers(len(scores))]
            chosen += [(i, int(starts[i][k])) for k in picks]
        rng.shuffle(chosen)
        for b in range(0, len(chosen), BATCH):
            some = chosen[b : b + BATCH]
            rows = [ids[i][s : s + WINDOW] for i, s in some]
            real = np.arange(WINDOW) < np.asarray([len(r) for r in rows])[:, None]
            used, where = np.unique(np.concatenate(rows), return_inverse=True)
            if not len(used):
                continue
            place = np.zeros(real.shape, dtype=np.int64)
            place[real] = where
            pick = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in used])
            sizes = edges[used + 1] - edges[used]
            x = net.inputs(buckets[used], grams[pick], np.repeat(np.arange(len(used)), sizes))
            blank = rng.random(len(used)) < BLANKED
            x[blank, :WIDTH] = 0
            g, dx = net.gradient(x, place, real, y[[i for i, _ in some]])
            dx[blank, :WIDTH] = 0
            g["word"], g["gram"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["gram"])
            np.add.at(g["word"], buckets[used], dx[:, :WIDTH])
            np.add.at(g["gram"], grams[pick], np.repeat(dx[:, WIDTH:] / sizes[:, None], sizes, axis=0))
            step += 1
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                net.w[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def held_out() -> Column:
    """True for the fifth of the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``size`` documents of each class and ``chars``
    characters, taken from the classes in turn."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").filter(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    by_class = [[r["doc_id"] for r in known.filter(F.col("toxic") == c).orderBy(*order).limit(size).collect()] for c in (0, 1)]
    picked = {i: c for pair in zip_longest(*by_class) for c, i in enumerate(pair) if i is not None}
    if not picked:
        return [], []
    # at most twice ``size`` rows are sent
    wanted = lambda ids: docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id", "left_semi")
    long = {r["doc_id"]: r["n"] for r in wanted(picked).groupBy("doc_id").agg(F.sum(F.char_length("text")).alias("n")).collect()}
    chosen, held = [], 0
    for i in picked:
        if i in long and held + long[i] <= chars:
            chosen.append(i)
            held += long[i]
    if not chosen:
        return [], []
    rows = wanted(chosen).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [picked[r["doc_id"]] for r in rows]


def score(docs: DataFrame, model: Network | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) for every row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(sent.value) if isinstance(sent.value, Network) else None
        for batch, texts in slices(batches, text):
            scores = own.texts([words_of(t) for t in texts]) if own else np.full(len(texts), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(scores.astype(np.float64))], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
