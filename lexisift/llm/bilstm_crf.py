"""Character-level bidirectional LSTM with CRF transitions, in numpy. The gates of input and forgetting are coupled: what comes in
replaces what is forgotten.

Characters have embeddings; a step is one matrix product over the state before, the embedding and a constant. ``Tagger`` holds the weights; ``train`` fits them by stochastic gradient descent (Adam) on labelled windows.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Characters with an id of their own; any other falls into a class by its Unicode category.
ALPHABET = (
    "\n !\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"
    "ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜŒÁÍÓÚÑßàâäçèéêëîïôöùûüœáíóúñ¿¡ºª’–—«»"
)
_CLASSES = {"Lu": 1, "Ll": 2, "Lo": 3, "Nd": 4, "Zs": 5, "Mn": 6, "Cf": 6}
OFFSET = 8
VOCAB = OFFSET + len(ALPHABET)
_IDS: dict[str, int] = {c: OFFSET + i for i, c in enumerate(ALPHABET)}


def _char_id(c: str) -> int:
    got = _IDS.get(c)
    if got is None:
        wide = unicodedata.normalize("NFKC", c)
        got = _IDS.get(wide) if len(wide) == 1 else None
        if got is None:
            got = _CLASSES.get(unicodedata.category(c), 7)
        _IDS[c] = got
    return got


_LOW = np.array([_char_id(chr(o)) for o in range(0x3000)], np.uint8)


def encode(text: str) -> np.ndarray:
    """One id (below 256) per character; offsets stay those of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.take(_LOW, points, mode="clip")
    for k in np.flatnonzero(points >= len(_LOW)):
        out[k] = _char_id(text[k])
    return out


def encode_all(texts: list[str]) -> list[np.ndarray]:
    """The ids of many texts, as views of one array."""
    ends = np.cumsum([len(x) for x in texts]).tolist()
    whole = encode("".join(texts))
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """E: embedding of each character, W: from embedding (and a constant) to the gates, U: from the state before, O and b: to the
    scores of the tags, T: transitions. W, U and O hold both directions."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.hidden = weights["U"].shape[1]
        self.tags = weights["T"].shape[0]
        self._ready: tuple | None = None
        self._rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array that is used again by the next block: fresh memory costs more than the sums that go into it."""
        size = int(np.prod(shape))
        if name not in self._rooms or self._rooms[name].size < size:
            self._rooms[name] = np.empty(size, np.float32)
        return self._rooms[name][:size].reshape(shape)

    @classmethod
    def new(cls, hidden: int, tags: int, seed: int, width: int = 16) -> "Tagger":
        r = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        w = f(2, width + 1, 3 * hidden, k=width**-0.5)
        w[:, -1] = 0
        w[:, -1, :hidden] = -1.0  # the state begins by lasting
        return cls({"E": f(VOCAB, width, k=0.5), "W": w, "U": f(2, hidden, 3 * hidden, k=hidden**-0.5), "O": f(2, hidden, tags, k=(2 * hidden) ** -0.5), "b": np.zeros(tags, np.float32), "T": f(tags, tags, k=0.1)})

    def _prepared(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Weights with features first. Sigmoids run as tanh of half the sum, so the halves are taken into the weights; the
        hidden state is kept doubled."""
        if self._ready is None:
            h_ = self.hidden
            half = np.ones((3 * h_, 1), np.float32)
            half[: 2 * h_] = 0.5
            w = self.w
            both = [(np.ascontiguousarray(half * np.concatenate([0.5 * w["U"][d].T, w["W"][d].T], 1)), np.ascontiguousarray(0.5 * w["O"][d].T)) for d in (0, 1)]
            self._ready = (np.ascontiguousarray(w["E"].T), both)
        return self._ready

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids (steps, rows), 0 where padded at the end -> scores (steps, tags, rows), until the next call."""
        steps, n = ids.shape
        h_ = self.hidden
        embedding, ((gates0, weights0), (gates1, weights1)) = self._prepared()
        width = len(embedding)
        out = self._room("scores", steps, self.tags, n)
        got = np.empty((self.tags, n), np.float32)
        # both directions side by side: the first columns go forwards, the others backwards
        z = np.empty((3 * h_, 2 * n), np.float32)
        i, o, a = (z[k * h_ : (k + 1) * h_] for k in range(3))
        ids = np.concatenate([ids, ids[::-1]], 1).astype(np.intp)
        padded = (ids[:, n:] == 0).any(1)
        fed = np.ones((h_ + width + 1, 2 * n), np.float32)  # the state before, the embedding, a constant
        h, x = fed[:h_], fed[h_ : h_ + width]
        h[:] = 0
        c = np.zeros((h_, 2 * n), np.float32)
        for k in range(steps):
            np.take(embedding, ids[k], axis=1, out=x, mode="clip")
            np.matmul(gates0, fed[:, :n], out=z[:, :n])
            np.matmul(gates1, fed[:, n:], out=z[:, n:])
            np.tanh(z, out=z)
            a -= c
            i += 1
            i *= a
            i *= 0.5
            c += i
            np.tanh(c, out=h)
            o += 1
            h *= o
            if padded[k]:  # padding lies before the text when read backwards
                pad = np.flatnonzero(ids[k, n:] == 0) + n
                h[:, pad] = 0
                c[:, pad] = 0
            j = steps - 1 - k
            if k <= j:  # the first to come to a character
                np.matmul(weights0, h[:, :n], out=out[k])
            else:
                np.matmul(weights0, h[:, :n], out=got)
                out[k] += got
            if k < j:
                np.matmul(weights1, h[:, n:], out=out[j])
            else:
                np.matmul(weights1, h[:, n:], out=got)
                out[j] += got
        out += self.w["b"][:, None]
        return out

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag sequence of each row under the transitions. scores: (steps, tags, rows), so rows are contiguous.

        Odd tags begin an item and follow tag 0 only or open the text; even ones go on with their own item, or open a text that
        begins inside one; an item has two characters at least. So three ways lead on: into 0 from 0 or an inside, into a begin
        from 0, and inside from its own two tags.
        """
        steps, tags, n = scores.shape
        t = self.w["T"]
        stay, out, begin = t[0, 0], t[2::2, 0][:, None], t[0, 1::2][:, None]
        first, on = t[np.arange(1, tags, 2), np.arange(2, tags, 2)][:, None], t[np.arange(2, tags, 2), np.arange(2, tags, 2)][:, None]
        sums = self._room("sums", steps, tags, n)
        left = np.zeros((steps, n), bool)  # 0 is best reached from an item
        opened = np.zeros((steps, len(first), n), bool)  # an inside is best reached from its begin
        sums[0] = scores[0]
        start, going, zero = np.empty((len(first), n), np.float32), np.empty((len(first), n), np.float32), np.empty(n, np.float32)
        for k in range(1, steps):
            before, now = sums[k - 1], sums[k]
            np.add(before[2::2], out, out=going)
            best = going.max(0)
            np.add(before[0], stay, out=zero)
            np.greater(best, zero, out=left[k])
            np.maximum(best, zero, out=now[0])
            np.add(before[0], begin, out=now[1::2])
            np.add(before[1::2], first, out=start)
            np.add(before[2::2], on, out=going)
            np.greater(start, going, out=opened[k])
            np.maximum(start, going, out=now[2::2])
            now += scores[k]
        rows = np.arange(n)
        ends = (sums[lengths - 1, :, rows] + t[:, 0]).T  # behind the text nothing goes on
        ends[1::2] = -np.inf
        ends = ends.argmax(0)
        some = np.flatnonzero((ends > 0) | (left & (np.arange(steps)[:, None] < lengths)).any(0))  # others hold no item
        size, final = lengths[some], ends[some]
        last = np.where(size == steps, final, 0)
        ending: dict[int, list[int]] = {}
        for j in np.flatnonzero((final > 0) & (size < steps)).tolist():
            ending.setdefault(int(size[j]) - 1, []).append(j)
        flags = left[:, some] & (np.arange(steps)[:, None] < size)
        way = np.zeros((steps, len(some)), np.int8)
        for k in range(steps - 1, -1, -1):
            if k in ending:
                last[ending[k]] = final[ending[k]]
            way[k] = last
            if not k:
                break
            turn = ((last > 0) | flags[k]).nonzero()[0]  # whoever is in an item, or enters 0 from one
            if len(turn):
                tag, row = last[turn], some[turn]
                back = np.where(tag % 2 == 1, 0, np.where(opened[k, np.maximum(tag // 2 - 1, 0), row], tag - 1, tag))
                close = tag == 0
                if close.any():
                    back[close] = 2 + 2 * (sums[k - 1, 2::2, row[close]] + out.T).argmax(1)
                last[turn] = back
        path = np.zeros((n, steps), np.int8)
        path[some] = way.T
        return path


def _forward_backward(t: Tagger, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log-likelihood per character and its gradients; windows are all of one length."""
    w, h_ = t.w, t.hidden
    n, steps = ids.shape
    rows = np.arange(n)
    order = np.stack([np.arange(steps), np.arange(steps - 1, -1, -1)])
    hs = np.zeros((steps + 1, 2, n, h_), np.float32)
    cs = np.zeros_like(hs)
    gates = np.empty((steps, 2, n, 3 * h_), np.float32)
    width = w["E"].shape[1]
    real = (ids != 0).astype(np.float32)[:, :, None]
    fed = np.ones((2, steps * n, width + 1), np.float32)  # embeddings in the order of each direction, and a constant
    for d in (0, 1):
        fed[d, :, :width] = w["E"][ids[:, order[d]].T.reshape(-1)]
    came = (fed @ w["W"]).reshape(2, steps, n, 3 * h_)
    for k in range(steps):
        z = hs[k] @ w["U"]
        z += came[:, k]
        z[..., : 2 * h_] = _sigmoid(z[..., : 2 * h_])
        z[..., 2 * h_ :] = np.tanh(z[..., 2 * h_ :])
        gates[k] = z
        cs[k + 1] = cs[k] + z[..., :h_] * (z[..., 2 * h_ :] - cs[k])
        hs[k + 1] = np.tanh(cs[k + 1]) * z[..., h_ : 2 * h_]
        # read backwards, the text begins where its padding ends
        cs[k + 1, 1] *= real[:, steps - 1 - k]
        hs[k + 1, 1] *= real[:, steps - 1 - k]
    hf, hb = hs[1:, 0], hs[1:, 1][::-1]
    em = hf @ w["O"][0] + hb @ w["O"][1] + w["b"]  # steps, n, tags
    # CRF: forward and backward sums, each step scaled to add up to 1
    trans = w["T"]
    top, most = em.max(2, keepdims=True), trans.max()
    e, move = np.exp(em - top), np.exp(trans - most)
    alpha, beta, sums = np.empty_like(em), np.ones_like(em), np.empty((steps, n, 1), em.dtype)
    for k in range(steps):
        alpha[k] = e[k] * (alpha[k - 1] @ move if k else 1)
        sums[k] = alpha[k].sum(1, keepdims=True)
        alpha[k] /= sums[k]
    for k in range(steps - 2, -1, -1):
        beta[k] = (e[k + 1] * beta[k + 1] / sums[k + 1]) @ move.T
    z = np.log(sums).sum((0, 2)) + top.sum((0, 2)) + (steps - 1) * most
    g = gold.T
    score = np.take_along_axis(em, g[:, :, None], 2).sum((0, 2)) + trans[g[:-1], g[1:]].sum(0)
    d_trans = move * np.tensordot(alpha[:-1], e[1:] * beta[1:] / sums[1:], ((0, 1), (0, 1)))
    np.subtract.at(d_trans, (g[:-1], g[1:]), 1)
    loss = float((z - score).sum() / (n * steps))
    d_em = alpha * beta
    d_em[np.arange(steps)[:, None], rows[None], g] -= 1
    scale = 1.0 / (n * steps)
    d_em = (d_em * scale).astype(np.float32)
    grads = {"T": d_trans * scale, "b": d_em.sum((0, 1)), "O": np.stack([np.tensordot(hf, d_em, ((0, 1), (0, 1))), np.tensordot(hb, d_em, ((0, 1), (0, 1)))])}
    dh_out = np.stack([d_em @ w["O"][0].T, (d_em @ w["O"][1].T)[::-1]], 1)  # steps, 2, n, h
    dz = np.empty_like(gates)
    dh = np.zeros((2, n, h_), np.float32)
    dc = np.zeros_like(dh)
    ut = w["U"].transpose(0, 2, 1)
    for k in range(steps - 1, -1, -1):
        gk, th = gates[k], np.tanh(cs[k + 1])
        i, o, a = gk[..., :h_], gk[..., h_ : 2 * h_], gk[..., 2 * h_ :]
        dh = dh + dh_out[k]
        dh[1] *= real[:, steps - 1 - k]
        dc = dc + dh * o * (1 - th * th)
        dc[1] *= real[:, steps - 1 - k]
        q = dz[k]
        q[..., :h_] = dc * (a - cs[k]) * i * (1 - i)
        q[..., h_ : 2 * h_] = dh * th * o * (1 - o)
        q[..., 2 * h_ :] = dc * i * (1 - a * a)
        dh = q @ ut
        dc = dc * (1 - i)
    grads["U"] = np.stack([np.tensordot(hs[:-1, d], dz[:, d], ((0, 1), (0, 1))) for d in (0, 1)])
    flat = dz.transpose(1, 0, 2, 3).reshape(2, steps * n, -1)
    grads["W"] = fed.transpose(0, 2, 1) @ flat
    ge = np.zeros_like(w["E"])
    for d in (0, 1):
        one = np.zeros((steps * n, VOCAB), np.float32)
        one[np.arange(steps * n), ids[:, order[d]].T.reshape(-1)] = 1
        ge += one.T @ (flat[d] @ w["W"][d, :width].T)
    grads["E"] = ge
    return loss, grads


def _job(args: tuple) -> tuple[float, dict[str, np.ndarray]]:
    weights, seed, size = args
    return _forward_backward(Tagger(weights), *_WINDOWS[0](np.random.default_rng(seed), size))


_WINDOWS: list = []


def train(windows, hidden: int, tags: int, steps: int, batch: int, seed: int, rate: float = 8e-3, workers: int = 1, log=None) -> Tagger:
    """windows(rng, rows) -> (ids, gold), both (rows, length). A step adds up the gradients of ``workers`` processes."""
    from multiprocessing import get_context

    t = Tagger.new(hidden, tags, seed)
    m = {k: np.zeros_like(v) for k, v in t.w.items()}
    v = {k: np.zeros_like(x) for k, x in t.w.items()}
    _WINDOWS[:] = [windows]
    with get_context("fork").Pool(workers) as pool:
        for k in range(1, steps + 1):
            parts = pool.map(_job, [(t.w, (seed, k, j), batch // workers) for j in range(workers)], 1)
            loss = sum(p[0] for p in parts) / workers
            grads = {name: sum(p[1][name] for p in parts) / workers for name in t.w}
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
            lr = rate * min(1, k / 100) * (0.5 * (1 + np.cos(np.pi * k / steps)) + 0.02)
            for name, g in grads.items():
                g = g * min(1, 0.5 / max(norm, 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                t.w[name] = (t.w[name] - lr * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-7)).astype(np.float32)
            if log and k % 200 == 0:
                log(k, loss)
    return t
