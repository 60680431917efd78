"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by back-propagation and batched decoding.

Each step takes the embeddings of a frame of four characters and emits the tag scores of each of the four, so the
recurrence is run a quarter as often as there are characters; the CRF runs over the characters themselves.
"""

from __future__ import annotations

import unicodedata

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: A step of the network reads a frame of so many characters, and gives the emissions of each of them.
EMBED, HIDDEN, FRAME = 16, 32, 4
#: Hidden units of the network that training begins with; the least useful ones are taken out on the way.
WIDE = 40


def _classes() -> np.ndarray:
    """Code point to input class: printable ASCII as such, letters without their accents, the rest by category."""
    table = np.full(0x10000, 4, np.uint8)
    for code in range(0x10000):
        char = chr(code)
        base = unicodedata.normalize("NFKD", char)[:1] or char
        if 32 <= ord(base) < 127:
            table[code] = 10 + ord(base) - 32
            continue
        kind = unicodedata.category(char)
        if char in "\n\r":
            table[code] = 6
        elif kind[0] == "Z" or char == "\t":
            table[code] = 10
        elif kind == "Nd":
            table[code] = 10 + 16 + unicodedata.digit(char)
        elif kind[0] == "L":
            table[code] = 2 if kind == "Lu" else 1
        elif char == "ß":
            table[code] = 10 + ord("s") - 32
    return table


CLASSES = 10 + 95
_table: np.ndarray | None = None


def encode(text: str) -> np.ndarray:
    global _table
    if _table is None:
        _table = _classes()
    if text.isascii():
        return _table[np.frombuffer(text.encode(), np.uint8)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 0x10000, _table[np.minimum(codes, 0xFFFF)], 4).astype(np.uint8)


def start(seed: int = 7, embed: int = EMBED, hidden: int = HIDDEN, frame: int = FRAME) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)

    def w(*shape: int) -> np.ndarray:
        return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    wide, tags = frame * embed, frame * TAGS
    p = {"embed": w(CLASSES, embed) * 2, "out": w(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "near": w(wide, tags) * 0.1}
    p |= {"trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
    for d in "fb":
        p |= {f"w{d}": w(wide + hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
        p[f"b{d}"][hidden : 2 * hidden] = 1
    return p


def _frame(p: dict) -> int:
    return p["near"].shape[0] // p["embed"].shape[1]


def _halved(p: dict, d: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights whose input, forget and output gates come by half a tanh."""
    n = p["b" + d].shape[0] // 4
    scale = np.ones(4 * n, np.float32)
    scale[: 3 * n] = 0.5
    return p["w" + d] * scale, p["b" + d] * scale


def _run(p: dict, d: str, ids: np.ndarray, emit: np.ndarray, cache: list) -> None:
    """One direction over ids [B, T], a frame of characters a step; its share of the emissions is added to emit.

    Gates: input, forget, output, candidate. cache takes what the gradient needs. Decoding has a form of its own, _forward.
    """
    embed, frame = p["embed"], _frame(p)
    weights, shift = _halved(p, d)
    n, batch = shift.shape[0] // 4, ids.shape[0]
    wide = frame * embed.shape[1]
    out = p["out"][:n] if d == "f" else p["out"][n:]
    kind = weights.dtype
    h, c = np.zeros((batch, n), kind), np.zeros((batch, n), kind)
    steps = range(ids.shape[1] // frame)
    for t in steps if d == "f" else reversed(steps):
        into = np.concatenate([embed[ids[:, t * frame : (t + 1) * frame]].reshape(batch, wide), h], 1)
        z = np.tanh(into @ weights + shift)
        z[:, : 3 * n] = z[:, : 3 * n] * 0.5 + 0.5
        before = c
        c = c * z[:, n : 2 * n] + z[:, :n] * z[:, 3 * n :]
        squashed = np.tanh(c)
        cache.append((t, into, before, z, squashed))
        h = squashed * z[:, 2 * n : 3 * n]
        if d == "f":
            emit[t] += into[:, :wide] @ p["near"]
        emit[t] += h @ out


def tables(p: dict) -> dict:
    """What decoding needs of a network, computed once: the share of every pair of characters in the gates, per place of the
    pair in its frame, and the recurrent and output weights.

    The gates are left at tanh + 1, twice their value: the cell is halved once, and the hidden state, also twice its value,
    meets weights of half theirs.
    """
    embed, out = p["embed"], {}
    size, frame = embed.shape[1], _frame(p)
    for d in "fb":
        weights, shift = _halved(p, d)
        n = shift.shape[0] // 4
        pairs = []
        for at in range(0, frame, 2):
            one, two = (embed @ weights[(at + k) * size : (at + k + 1) * size] for k in (0, 1))
            both = (one[:, None] + two[None]).reshape(CLASSES * CLASSES, -1)
            pairs.append(np.ascontiguousarray(both + shift if at == 0 else both))
        own = p["out"][:n] if d == "f" else p["out"][n:]
        out[d] = (pairs, np.ascontiguousarray(weights[frame * size :] * 0.5), np.ascontiguousarray(own.T * 0.5))
    return out


def _forward(p: dict, known: dict, d: str, pairs: np.ndarray, ids: np.ndarray, emit: np.ndarray, active: list[int]) -> None:
    """One direction, in as few passes over memory as there can be. The forward one sets emit [frames, tags, B], with what
    the characters themselves and the bias give; the other adds to it.

    pairs [frames, pairs of a frame, B] numbers the pairs of characters, ids [frames, B, frame] the characters; active tells
    how many rows are as long as each frame. The longest come first, and nothing is read behind a row's end.
    """
    inputs, recurrent, out = known[d]
    n, batch = recurrent.shape[0], pairs.shape[2]
    kind, forward = recurrent.dtype, d == "f"
    wide = p["near"].shape[0] if forward else 0
    # hidden state, embeddings and a one side by side: one product gives the emissions
    state = np.zeros((batch, n + wide + forward), kind)
    if forward:
        state[:, -1] = 1
        out = np.ascontiguousarray(np.concatenate([out.T, p["near"], p["bias"][None]]).T.astype(kind))
    c_all, part_all = np.zeros((batch, n), kind), np.zeros((batch, n), kind)
    z_all, term_all = np.empty((batch, 4 * n), kind), np.empty((batch, 4 * n), kind)
    more_all = np.empty(out.shape[0] * batch, kind)
    seen_all = np.empty((batch, ids.shape[2], p["embed"].shape[1]), kind)
    # one for the gates and none for the candidate: a whole block is added faster than a part of each row
    lift_all = np.zeros((batch, 4 * n), kind)
    lift_all[:, : 3 * n] = 1
    steps, rows = range(len(pairs)), -1
    for t in steps if forward else reversed(steps):
        if active[t] != rows:
            rows = active[t]
            h, c, part, z, term, seen, lift = (x[:rows] for x in (state[:, :n], c_all, part_all, z_all, term_all, seen_all, lift_all))
            own, more = state[:rows], more_all[: out.shape[0] * rows].reshape(-1, rows)
            first, second, third, last = (z[:, k * n : (k + 1) * n] for k in range(4))
        np.matmul(h, recurrent, out=z)
        for table, which in zip(inputs, pairs[t]):
            table.take(which[:rows], 0, term, "clip")
            np.add(z, term, out=z)
        np.tanh(z, out=z)
        np.add(z, lift, out=z)
        np.multiply(c, second, out=c)
        np.multiply(first, last, out=part)
        np.add(c, part, out=c)
        np.multiply(c, 0.5, out=c)
        np.tanh(c, out=part)
        np.multiply(part, third, out=h)
        here = emit[t, :, :rows]
        if forward:
            p["embed"].take(ids[t, :rows], 0, seen, "clip")
            own[:, n:-1] = seen.reshape(rows, wide)
            np.matmul(out, own.T, out=here)
        else:
            np.matmul(out, h.T, out=more)
            np.add(here, more, out=here)


def _active(lengths: np.ndarray, steps: int) -> list[int]:
    """How many rows, the longest first, are as long as each step."""
    return np.searchsorted(-lengths, -np.arange(steps)).tolist()


def emissions(p: dict, ids: np.ndarray, known: dict | None = None, lengths: np.ndarray | None = None) -> np.ndarray:
    """[T, B, tags] of ids [B, T]; T is a multiple of the frame. It lies in memory as the search wants it: [T, tags, B].

    known are the network's tables, where a caller has them. lengths, which must not rise, tell where the rows end: a row's
    emissions do not depend on the others', and those behind its last frame are undefined.
    """
    batch, steps = ids.shape
    frame = _frame(p)
    frames = np.ascontiguousarray(ids.reshape(batch, steps // frame, frame).swapaxes(0, 1)).astype(np.intp)
    pairs = np.ascontiguousarray((frames[:, :, ::2] * CLASSES + frames[:, :, 1::2]).swapaxes(1, 2))
    emit = np.empty((steps // frame, frame * TAGS, batch), p["out"].dtype)
    known = known or tables(p)
    active = _active(np.full(batch, steps) if lengths is None else -(-lengths // frame) * frame, steps)[::frame]
    for d in "fb":
        _forward(p, known, d, pairs, frames, emit, active)
    return emit.reshape(steps, TAGS, batch).swapaxes(1, 2)


def viterbi(p: dict, scores: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Best tags [T, B] of scores [T, B, tags]; lengths are those of the columns, which must not rise, and O stands behind.

    The best scores are carried forward for all columns, with a note of where O comes from O. Traced back are only columns
    whose best path is not O throughout, from one span of other tags to the next.
    """
    steps, batch, n = scores.shape
    across = scores.swapaxes(1, 2)
    lengths = np.full(batch, steps) if lengths is None else lengths
    # written out for all columns, as short rows of one number each are slow to add
    trans_all = np.repeat(p["trans"][:, :, None], batch, 2)
    best = np.empty((steps, n, batch), scores.dtype)
    np.add(across[0], p["first"][:, None], out=best[0])
    path_all = np.empty(n * n * batch, scores.dtype)
    stays = np.ones((steps, batch), bool)
    rows = -1
    for t, now in enumerate(_active(lengths, steps)):
        if not t:
            continue
        if now != rows:
            rows = now
            path, trans = path_all[: n * n * rows].reshape(n, n, rows), trans_all[:, :, :rows]
        here = best[t, :, :rows]
        np.add(best[t - 1, :, None, :rows], trans, out=path)
        np.maximum.reduce(path, axis=0, out=here)
        np.equal(path[0, 0], here[0], out=stays[t, :rows])
        np.add(here, across[t, :, :rows], out=here)
    last = best[lengths - 1, :, np.arange(batch)].argmax(1)
    tags = np.zeros((steps, batch), np.int8)
    back = np.ascontiguousarray(p["trans"].T)
    for column in np.flatnonzero((last > 0) | ~stays.all(0)).tolist():
        left = np.flatnonzero(~stays[:, column]).tolist()
        own, t, tag = best[:, :, column], int(lengths[column]) - 1, int(last[column])
        while True:
            if tag:
                tags[t, column] = tag
            else:
                while left and left[-1] > t:
                    left.pop()
                t = left[-1] if left else 0
            if not t:
                break
            tag = int((own[t - 1] + back[tag]).argmax())
            t -= 1
    return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def loss_and_gradient(p: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood a sequence, and its gradient. ids and tags are [B, T]."""
    batch, steps = ids.shape
    tags = tags.T
    frame, wide, n = _frame(p), p["near"].shape[0], p["bf"].shape[0] // 4
    g = {k: np.zeros_like(v) for k, v in p.items()}
    frames = steps // frame
    emit = np.empty((frames, batch, frame * TAGS), p["out"].dtype)
    emit[:] = p["bias"]
    caches: dict[str, list] = {"f": [], "b": []}
    for d in "fb":
        _run(p, d, ids, emit, caches[d])
    scores = emit.reshape(frames, batch, frame, TAGS).swapaxes(1, 2).reshape(steps, batch, TAGS)
    trans = p["trans"]
    alpha = np.empty_like(scores)
    alpha[0] = scores[0] + p["first"]
    for t in range(1, steps):
        alpha[t] = _through(alpha[t - 1], trans) + scores[t]
    total = _logsum(alpha[-1], 1)
    beta = np.zeros_like(scores)
    pair = np.zeros_like(trans)
    for t in range(steps - 2, -1, -1):
        ahead = scores[t + 1] + beta[t + 1]
        beta[t] = _through(ahead, trans.T)
        # sums over the batch of exp(alpha + trans + ahead - total), with both factors kept near 1
        left, right = alpha[t] - alpha[t].max(1, keepdims=True), ahead - ahead.max(1, keepdims=True)
        level = alpha[t].max(1) + ahead.max(1) - total
        pair += (np.exp(left) * np.exp(level)[:, None]).T @ np.exp(right) * np.exp(trans)
    marginal = np.exp(alpha + beta - total[None, :, None])
    time, row = np.arange(steps)[:, None], np.arange(batch)[None]
    gold = scores[time, row, tags].sum() + trans[tags[:-1], tags[1:]].sum() + p["first"][tags[0]].sum()
    loss = (total.sum() - gold) / batch
    delta = marginal
    delta[time, row, tags] -= 1
    delta /= batch
    seen = np.zeros_like(trans)
    np.add.at(seen, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    g["trans"] = ((pair - seen) / batch).astype(trans.dtype)
    g["first"] = delta[0].sum(0)
    delta = delta.reshape(frames, frame, batch, TAGS).swapaxes(1, 2).reshape(frames, batch, frame * TAGS)
    g["bias"] = delta.sum((0, 1))
    d_input = np.zeros((frames, batch, wide), p["out"].dtype)
    for d, out, at in (("f", p["out"][:n], slice(0, n)), ("b", p["out"][n:], slice(n, 2 * n))):
        into_h = delta @ out.T
        dh = np.zeros((batch, n), out.dtype)
        dc = np.zeros((batch, n), out.dtype)
        dz = np.empty((batch, 4 * n), out.dtype)
        weights = p["w" + d]
        for t, into, before_c, z, squashed in reversed(caches[d]):
            i, f, o, c = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
            g["out"][at] += (squashed * o).T @ delta[t]
            dh = dh + into_h[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz[:, :n] = dc * c * i * (1 - i)
            dz[:, n : 2 * n] = dc * before_c * f * (1 - f)
            dz[:, 2 * n : 3 * n] = dh * squashed * o * (1 - o)
            dz[:, 3 * n :] = dc * i * (1 - c**2)
            g["w" + d] += into.T @ dz
            g["b" + d] += dz.sum(0)
            back = dz @ weights.T
            d_input[t] += back[:, :wide]
            dh = back[:, wide:]
            dc = dc * f
            if d == "f":
                g["near"] += into[:, :wide].T @ delta[t]
                d_input[t] += delta[t] @ p["near"].T
    flat = d_input.reshape(frames, batch, frame, -1).swapaxes(0, 1).reshape(batch * steps, -1)
    order = np.argsort(ids.ravel(), kind="stable")
    classes, first = np.unique(ids.ravel()[order], return_index=True)
    g["embed"][classes] = np.add.reduceat(flat[order], first, axis=0)
    return float(loss), g


def _through(before: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """log of the sum over the tag before, as a product of matrices."""
    top = before.max(1, keepdims=True)
    return np.log(np.exp(before - top) @ np.exp(trans) + 1e-30) + top


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.turn = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict, g: dict, rate: float | None = None) -> None:
        self.turn += 1
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k in p:
            x = g[k] * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            m = self.m[k] / (1 - 0.9**self.turn)
            v = self.v[k] / (1 - 0.999**self.turn)
            p[k] -= ((rate or self.rate) * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
