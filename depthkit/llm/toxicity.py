"""Toxicity scoring by a bidirectional gated recurrent network (op 4).

A word is read twice: as a word embedding, and by a small bidirectional GRU over its
bytes whose states are pooled by attention.  A bidirectional GRU over the words of a window, again
pooled by attention, gives the window's score.  Every text is covered by windows of ``WINDOW``
words that overlap by half; the text's score is that of its worst window.

The network is trained in numpy on a bounded sample of labelled texts.  Labels belong to texts
and not to windows, so each epoch trains on the worst window of every text (and on random ones
of clean texts); toxic texts start with all their windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit.llm.base import WIDE_SLICE, fold, labelled_sample, letter_words, mix, prefix_sums, ragged, raw_hash, ship, text_slices

WINDOW, STEP = 32, 16
#: Bytes that the byte network reads at once.  Longer runs of letters, whole texts without blanks
#: included, are cut into pieces of at most so many bytes; each begins PIECE_STEP after the one before,
#: give or take a character, and counts as a word.
BYTES, PIECE_STEP = 10, 4
#: Words with an embedding of their own: those in at least so many texts of the sample.  All
#: others share one, so what is not known as a word is judged by its bytes.
WORD_TEXTS = 10
#: Bounds of the training sample: texts of each label, windows cut from a text.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 1000, 48
#: Bytes whose words are hashed at once: running sums take 40 bytes for each.
HASHED = 1 << 18
#: Rows whose states are computed at once, so that what a step reads and writes stays in a core's cache.
BLOCK = 512
_U = np.uint64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Params(dict):
    """Named float32 arrays with Adam updates."""

    def __init__(self, **arrays):
        super().__init__(arrays)
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.t = 0

    def step(self, grads: dict, rate: float) -> None:
        self.t += 1
        for k, g in grads.items():
            if k not in self.m:
                self.m[k], self.v[k] = np.zeros_like(self[k]), np.zeros_like(self[k])
            rows = slice(None)
            if isinstance(g, tuple):  # (rows, gradient) of an embedding
                rows, g = g
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            v = self.v[k][rows] = 0.99 * self.v[k][rows] + 0.01 * g * g
            self[k][rows] -= rate * m / (np.sqrt(v) + 1e-6)


def new_params(known: np.ndarray, seed: int = 11, word: int = 12, byte: int = 8, inner: int = 8, outer: int = 12) -> Params:
    rng = np.random.default_rng(seed)
    f = lambda *s, k=0.0: (rng.normal(size=s) * (k or 1 / np.sqrt(s[0]))).astype(np.float32)
    p = Params(byte=f(257, byte, k=0.3), word=f(len(known) + 1, word, k=0.1), known=known)
    for name, size, hidden in (("c", byte, inner), ("w", word + 2 * inner, outer)):
        for way in "fb":
            p[name + way + "x"], p[name + way + "h"] = f(size, 3 * hidden), f(hidden, 3 * hidden)
            p[name + way + "b"] = np.zeros(3 * hidden, np.float32)
        p[name + "a"], p[name + "v"] = f(2 * hidden, 2 * hidden), f(2 * hidden, k=0.3)
    p["o"], p["ob"] = f(2 * outer, k=0.3), np.zeros(1, np.float32)
    return p


def _gru(xp: np.ndarray, mask: np.ndarray, wh: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
    """States (time x rows x hidden) of a GRU over projected inputs; masked steps keep the state."""
    steps, rows, wide = xp.shape
    n = wide // 3
    h = np.zeros((rows, n), np.float32)
    out = np.empty((steps, rows, n), np.float32)
    kept = []
    for t in range(steps)[::-1 if back else 1]:
        hp = h @ wh
        x = xp[t]
        zr = _sigmoid(x[:, :2 * n] + hp[:, :2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[:, 2 * n:] + r * hp[:, 2 * n:])
        new = np.where(mask[t][:, None], c + z * (h - c), h)
        kept.append((t, h, hp[:, 2 * n:], z, r, c))
        h = out[t] = new
    return out, kept


def _gru_back(dout: np.ndarray, kept: list, mask: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    steps, rows, n = dout.shape
    dxp, dwh = np.zeros((steps, rows, 3 * n), np.float32), np.zeros_like(wh)
    dh = np.zeros((rows, n), np.float32)
    for t, h, hc, z, r, c in reversed(kept):
        dh = dh + dout[t]
        live = mask[t][:, None]
        dn = np.where(live, dh, 0)
        dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
        dr = dc * hc * r * (1 - r)
        g = np.concatenate([dz, dr, dc * r], 1)
        dxp[t] = np.concatenate([dz, dr, dc], 1)
        dwh += h.T @ g
        dh = np.where(live, dn * z, dh) + g @ wh.T
    return dxp, dwh


def bigru_pool(p: Params, name: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Bidirectional GRU with attention pooling over time x rows x size inputs: rows x 2 * hidden."""
    hf, kf = _gru(x @ p[name + "fx"] + p[name + "fb"], mask, p[name + "fh"], False)
    hb, kb = _gru(x @ p[name + "bx"] + p[name + "bb"], mask, p[name + "bh"], True)
    h = np.concatenate([hf, hb], 2)
    u = np.tanh(h @ p[name + "a"])
    s = np.where(mask, u @ p[name + "v"], np.float32(-1e9))
    s = np.exp(s - s.max(0))
    a = s / s.sum(0)
    out = (a[:, :, None] * h).sum(0)
    return (out, (x, mask, h, u, a, kf, kb)) if keep else out


def bigru_pool_back(p: Params, name: str, dout: np.ndarray, saved, grads: dict) -> np.ndarray:
    x, mask, h, u, a, kf, kb = saved
    da = (h * dout[None]).sum(2)
    ds = a * (da - (a * da).sum(0))
    dh = a[:, :, None] * dout[None]
    grads[name + "v"] = (u * ds[:, :, None]).sum((0, 1))
    du = ds[:, :, None] * p[name + "v"] * (1 - u * u)
    grads[name + "a"] = np.einsum("tri,trj->ij", h, du)
    dh = dh + du @ p[name + "a"].T
    n = h.shape[2] // 2
    dx = 0
    for way, part, kept in (("f", dh[:, :, :n], kf), ("b", dh[:, :, n:], kb)):
        g, grads[name + way + "h"] = _gru_back(np.ascontiguousarray(part), kept, mask, p[name + way + "h"])
        grads[name + way + "x"] = np.einsum("tri,trj->ij", x, g)
        grads[name + way + "b"] = g.sum((0, 1))
        dx = dx + g @ p[name + way + "x"].T
    return dx


def gates(p: Params, way: str, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projected inputs and recurrent weights of a GRU (``name`` + way), gate by gate: 3 x inputs x hidden and 3 x hidden x hidden."""
    split = lambda x: np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))
    return split(inputs @ p[way + "x"] + p[way + "b"]), split(p[way + "h"])


def _states(gated: tuple[np.ndarray, np.ndarray], place: np.ndarray, dead: np.ndarray, back: bool, out: np.ndarray) -> None:
    """The states of ``_gru`` for rows by ascending length, written to ``out``; the first ``dead[t]`` rows have ended before step t.

    What a step needs lies in buffers that all steps share, a gate in one piece."""
    xp, wh = gated
    steps, rows, n = out.shape
    h = np.zeros((rows, n), np.float32)
    own, rec = np.empty(3 * rows * n, np.float32), np.empty(3 * rows * n, np.float32)
    half, one = np.float32(0.5), np.float32(1)
    for t in range(steps)[::-1 if back else 1]:
        a = int(dead[t])
        m = rows - a
        x, hp, live = own[:3 * m * n].reshape(3, m, n), rec[:3 * m * n].reshape(3, m, n), h[a:]
        np.take(xp, place[t, a:], axis=1, out=x, mode="clip")
        np.matmul(live, wh, out=hp)
        zr, c = x[:2], hp[2]
        zr += hp[:2]
        zr *= half
        np.tanh(zr, out=zr)
        zr += one
        zr *= half
        c *= zr[1]
        c += x[2]
        np.tanh(c, out=c)
        live -= c
        live *= zr[0]
        live += c
        out[t] = h


def pool_sorted(p: Params, name: str, forth: tuple, back: tuple, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``bigru_pool`` for rows by ascending ``count`` of steps, BLOCK rows at a time; ``place`` (time x rows) are numbers of inputs."""
    n = forth[1].shape[1]
    pooled = np.empty((len(count), 2 * n), np.float32)
    for k in range(0, len(count), BLOCK):
        some = count[k:k + BLOCK]
        steps = int(some[-1])
        at, dead = place[:steps, k:k + BLOCK], np.searchsorted(some, np.arange(steps), "right")
        h = np.empty((steps, len(some), 2 * n), np.float32)
        _states(forth, at, dead, False, h[:, :, :n])
        _states(back, at, dead, True, h[:, :, n:])
        u = h @ p[name + "a"]
        np.tanh(u, out=u)
        s = u @ p[name + "v"]
        for t in range(steps):
            s[t, :dead[t]] = -1e9
        s -= s.max(0)
        np.exp(s, out=s)
        s /= s.sum(0)
        h *= s[:, :, None]
        h.sum(0, out=pooled[k:k + BLOCK])
    return pooled


# ---- words and windows ---------------------------------------------------------------------
def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``letter_words``, with runs longer than BYTES cut into overlapping pieces at character borders."""
    low, s, e, row = letter_words(data, offs)
    per = 1 + np.maximum(0, -(-(e - s - BYTES) // PIECE_STEP))
    if not (per > 1).any():
        return low, s, e, row
    of = np.repeat(np.arange(len(s)), per)
    k = ragged(np.zeros(len(s), np.int64), per)
    start, end, last = s[of] + k * PIECE_STEP, e[of], k == per[of] - 1
    cut = per[of] > 1
    start = np.where(cut & last, end - BYTES, start)
    inside = (low & 0xC0) == 0x80  # bytes that continue a character
    for _ in range(3):  # the last piece begins at the next character, the others at the one they cut
        start = np.where(cut & inside[start], np.where(last, np.minimum(start + 1, end - 1), np.maximum(start - 1, s[of])), start)
    stop = np.where(last, end, np.minimum(start + BYTES, end))
    for _ in range(3):
        stop = np.where(~last & inside[np.minimum(stop, len(low) - 1)], stop - 1, stop)
    return low, start, stop, row[of]


def word_inputs(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, their bytes (256: none), number of each word among them)."""
    key = np.empty(len(s), np.uint64)
    cuts = np.searchsorted(s, np.arange(0, len(data) + HASHED, HASHED))  # words begin in ascending places
    for i, j in zip(cuts[:-1], cuts[1:]):
        if i < j:
            lo = s[i]
            key[i:j] = mix(raw_hash(prefix_sums(data[lo:e[i:j].max()]), s[i:j] - lo, e[i:j] - lo))
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    a, n = s[first], (e - s)[first]
    at = np.arange(BYTES)
    letters = np.where(at < n[:, None], data[np.minimum(a[:, None] + at, max(len(data) - 1, 0))], 256)
    return key[first], letters.astype(np.int64), back


def word_numbers(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Embedding rows of words; row 0 for those that are not known."""
    if not len(known):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, at + 1, 0)


def window_words(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of the windows that cover rows of ``n`` adjacent words, a half apart."""
    per = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STEP)), 0)
    row = np.repeat(np.arange(len(n)), per)
    at = ragged(np.zeros(len(n), np.int64), per) * STEP
    first = np.cumsum(n) - n
    return row, first[row] + at, np.minimum(WINDOW, n[row] - at)


def encode_words(p: Params, bucket: np.ndarray, letters: np.ndarray, keep: bool = False):
    if keep:
        c, saved = bigru_pool(p, "c", p["byte"][letters.T], letters.T < 256, True)
        return np.concatenate([p["word"][bucket], c], 1), saved
    wide = p["word"].shape[1]
    out = np.empty((len(bucket), wide + p["ca"].shape[0]), np.float32)
    out[:, :wide] = p["word"][bucket]
    size = (letters < 256).sum(1)
    order = np.argsort(size, kind="stable")  # words of similar length together
    forth, back = gates(p, "cf", p["byte"]), gates(p, "cb", p["byte"])
    for k in range(0, len(order), 8192):
        some = order[k:k + 8192]
        out[some, wide:] = pool_sorted(p, "c", forth, back, np.ascontiguousarray(letters[some, :int(size[some[-1]])].T), size[some])
    return out


def window_logits(p: Params, words: np.ndarray, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Scores of windows of adjacent words; ``ids`` are rows of ``words``."""
    out = np.empty(len(first), np.float32)
    forth, back = gates(p, "wf", words), gates(p, "wb", words)
    order = np.argsort(count, kind="stable")
    for k in range(0, len(order), 2048):
        some = order[k:k + 2048]
        at = np.arange(int(count[some[-1]]))[:, None]
        place = ids[np.minimum(first[some] + at, len(ids) - 1)]
        out[some] = pool_sorted(p, "w", forth, back, place, count[some]) @ p["o"] + p["ob"]
    return out


def score_slice(p: Params, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, windows) of each row of a slice."""
    rows = len(offs) - 1
    low, s, e, row = pieces(data, offs)
    n = np.bincount(row, minlength=rows)
    score = np.full(rows, -np.inf, np.float32)
    if not len(s):
        return np.zeros(rows), np.zeros(rows, np.int64)
    key, letters, ids = word_inputs(low, s, e)
    words = encode_words(p, word_numbers(p["known"], key), letters)
    w_row, first, count = window_words(n)
    np.maximum.at(score, w_row, window_logits(p, words, ids, first, count))
    value = 1 / (1 + np.exp(-score.astype(np.float64)))
    return np.where(n > 0, value, 0.0), np.bincount(w_row, minlength=rows)


# ---- training --------------------------------------------------------------------------------
def train(texts: list[tuple[int, str]], epochs: int = 12, batch: int = 96, rate: float = 0.01, seed: int = 5) -> Params:
    """Fit on (label, text) pairs; the number of steps follows the bounded sample."""
    texts = [(y, t) for y, t in texts if t.split()]
    if not {y for y, _ in texts} >= {0, 1}:
        p = new_params(np.zeros(0, np.uint64))
        p["ob"][:] = 4.0 if any(y for y, _ in texts) else -4.0  # one label, or none, to learn from
        p["o"][:] = 0
        return p
    raw = [t.encode() for _, t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    low, s, e, row = pieces(data, offs)
    n = np.bincount(row, minlength=len(texts))
    key, letters, ids = word_inputs(low, s, e)
    seen = np.bincount(np.unique(row * np.int64(len(key)) + ids) % len(key), minlength=len(key))
    p = new_params(np.sort(key[seen >= WORD_TEXTS]))
    bucket = word_numbers(p["known"], key)
    w_row, first, count = window_words(n)
    label = np.array([y for y, _ in texts])
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        if epoch < 3:
            chosen = np.flatnonzero(label[w_row] == 1)
            clean = np.flatnonzero(label[w_row] == 0)
            chosen = np.concatenate([rng.choice(chosen, min(len(chosen), 3000), False), rng.choice(clean, min(len(clean), 3000), False)])
        else:
            logit = window_logits(p, encode_words(p, bucket, letters), ids, first, count)
            order = np.lexsort((-logit, w_row))
            worst = order[np.unique(w_row[order], return_index=True)[1]]
            clean = np.flatnonzero(label[w_row] == 0)
            high = clean[np.argsort(-logit[clean])[:len(texts)]]
            chosen = np.unique(np.concatenate([worst, high, rng.choice(clean, min(len(clean), len(texts) // 3), False)]))
        rng.shuffle(chosen)
        for k in range(0, len(chosen), batch):
            some = chosen[k:k + batch]
            at = np.arange(int(count[some].max()))[:, None]
            mask = at < count[some]
            place = ids[np.minimum(first[some] + at, len(ids) - 1)]
            used, back = np.unique(place, return_inverse=True)
            back = back.reshape(place.shape)
            vec, saved_c = encode_words(p, bucket[used], letters[used], True)
            pooled, saved_w = bigru_pool(p, "w", vec[back], mask, True)
            logit = pooled @ p["o"] + p["ob"]
            y = label[w_row[some]]
            d = ((1 / (1 + np.exp(-logit))) - y).astype(np.float32) / len(some)
            grads = {"o": pooled.T @ d, "ob": d.sum(keepdims=True)}
            dx = bigru_pool_back(p, "w", d[:, None] * p["o"][None], saved_w, grads)
            size = dx.shape[2]
            dvec = np.stack([np.bincount(back.reshape(-1), dx[:, :, j].reshape(-1), len(used)) for j in range(size)], 1).astype(np.float32)
            wide = p["word"].shape[1]
            rows, at_row = np.unique(bucket[used], return_inverse=True)
            g = np.zeros((len(rows), wide), np.float32)
            np.add.at(g, at_row, dvec[:, :wide])
            grads["word"] = (rows, g)
            db = bigru_pool_back(p, "c", dvec[:, wide:], saved_c, grads)
            at_byte = letters[used].T.reshape(-1)
            grads["byte"] = np.stack([np.bincount(at_byte, db[:, :, j].reshape(-1), 257) for j in range(db.shape[2])], 1).astype(np.float32)
            grads["byte"][256] = 0
            norm = np.sqrt(sum(float((x[1] if isinstance(x, tuple) else x).astype(np.float64).ravel() @ (x[1] if isinstance(x, tuple) else x).astype(np.float64).ravel()) for x in grads.values()))
            if norm > 1:
                grads = {k2: (x[0], x[1] / norm) if isinstance(x, tuple) else x / norm for k2, x in grads.items()}
            p.step(grads, rate * 0.75 ** max(0, epoch - 2))
    # move the bias if another place than 0.5 parts the sample's texts better
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, w_row, window_logits(p, encode_words(p, bucket, letters), ids, first, count))
    order = np.argsort(worst)
    hit, miss = label[order] == 1, label[order] == 0
    errors = np.concatenate([[0], np.cumsum(hit)]) / hit.sum() + (miss.sum() - np.concatenate([[0], np.cumsum(miss)])) / miss.sum()
    best = np.flatnonzero(errors == errors.min())
    cut = best[len(best) // 2]
    if 0 < cut < len(order) and errors[np.searchsorted(worst[order], 0)] > errors.min():
        p["ob"] -= np.float32((worst[order[cut - 1]] + worst[order[cut]]) / 2)
    return p


def sample_texts(rows: DataFrame) -> list[tuple[int, str]]:
    """(label, words) of a bounded number of rows (l, t): of each text, evenly spread stretches of SAMPLE_WINDOWS windows' length."""
    ship(rows.sparkSession)
    stretch, stretches = 4 * WINDOW, max(1, SAMPLE_WINDOWS // 7)

    def run(batches):
        for batch in batches:
            l, w = [], []
            for lo, hi, data, offs in text_slices(batch.column(1), WIDE_SLICE):
                low, s, e, row = pieces(data, offs)
                raw, cut = low.tobytes(), np.searchsorted(row, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    a, b = int(cut[r]), int(cut[r + 1])
                    if b - a <= stretch * stretches:
                        some = range(a, b)
                    else:
                        some = [i for at in np.linspace(a, b - stretch, stretches).astype(int) for i in range(at, at + stretch)]
                    l.append(batch.column(0)[lo + r].as_py())
                    w.append(" ".join(raw[s[i]:e[i]].decode("utf-8", "replace") for i in some))
            yield pa.RecordBatch.from_arrays([pa.array(l, pa.int32()), pa.array(w, pa.string())], ["l", "w"])

    return sorted((r[0], r[1]) for r in rows.mapInArrow(run, "l int, w string").collect())


def predict(df: DataFrame, p: Params, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_windows) of every row's whole text; null, empty and wordless texts score 0."""
    ship(df.sparkSession)
    model = dict(p)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(1), WIDE_SLICE):
                score, windows = score_slice(model, data, offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(windows, pa.int64())],
                    ["doc_id", "score", "predicted", "n_windows"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, n_windows long")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Params:
    """Train on labelled rows outside the held-out fold: about SAMPLE_TEXTS ids of each label, so
    the ids are broadcast and texts are not shuffled."""
    known = labels.where((fold(F.col("doc_id"), folds) != held) & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    chosen = labelled_sample(known, "toxic", SAMPLE_TEXTS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    return train(sample_texts(texts.join(F.broadcast(chosen), "doc_id").select(F.col("toxic").alias("l"), "t")))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows) of every row of ``docs``."""
    out = predict(docs, fit(docs, labels, folds, held))
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_windows")


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    ship(docs.sparkSession)
    model, at = dict(fit(docs, labels)), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(at), WIDE_SLICE):
                value, _ = score_slice(model, data, offs)
                yield batch.slice(lo, hi - lo).filter(pa.array(value < 0.5))

    return docs.mapInArrow(run, docs.schema)
