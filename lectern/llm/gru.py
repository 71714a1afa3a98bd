"""A gated recurrent language model in numpy: windows of many lanes, class-factored softmax, truncated backpropagation."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

END, RARE = 0, 1
#: Words of a class; words are dealt to classes in the order of their frequency.
CLASS_SIZE = 32
#: Where the sums of squared gradients start.
START = 1e-5
#: Weights travel as whole multiples of this, so that sums over tasks don't depend on their order.
GRAIN = 2.0**-16


@dataclass
class Shape:
    words: int
    hidden: int

    @property
    def classes(self) -> int:
        return -(-self.words // CLASS_SIZE)

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        w, h, c = self.words, self.hidden, self.classes
        return [("inputs", (w, 3 * h)), ("turn", (h, 3 * h)), ("class_w", (h, c)), ("class_b", (c,)), ("word_w", (c, h, CLASS_SIZE)), ("word_b", (c, CLASS_SIZE))]

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The weights by name, as views."""
        out, at = {}, 0
        for name, dims in self.parts():
            n = int(np.prod(dims))
            out[name] = flat[at : at + n].reshape(dims)
            at += n
        return out

    def size(self) -> int:
        return sum(int(np.prod(dims)) for _, dims in self.parts())


def first_weights(shape: Shape, counts: np.ndarray, seed: int) -> np.ndarray:
    """Random inner weights; the output's biases give each word its share among the training tokens."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.size(), np.float32)
    w = shape.unpack(flat)
    w["inputs"][:] = rng.normal(scale=0.1, size=w["inputs"].shape)
    w["turn"][:] = rng.normal(scale=1 / np.sqrt(shape.hidden), size=w["turn"].shape)
    share = np.zeros(shape.classes * CLASS_SIZE)
    share[: shape.words] = counts + 1.0
    share = share.reshape(shape.classes, CLASS_SIZE)
    w["class_b"][:] = np.log(share.sum(1) / share.sum())
    w["word_b"][:] = np.where(share > 0, np.log(np.maximum(share, 1e-300) / share.sum(1, keepdims=True)), -60)
    return flat


@dataclass
class Lanes:
    """Documents dealt to lanes that are read side by side; a lane holds whole documents, one after the other."""

    tokens: np.ndarray  # all lanes, one after the other
    inputs: np.ndarray  # the token before; END before a document's first one
    fresh: np.ndarray  # at a document's first token
    starts: np.ndarray  # of the lanes, the longest lane first
    sizes: np.ndarray
    docs: np.ndarray  # the documents in the order of their first tokens
    doc_starts: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray], most: int) -> Lanes:
        sizes = np.array([len(d) for d in docs], np.int64)
        lanes: list[list[int]] = [[] for _ in range(min(most, len(docs)))]
        heap = [(0, i) for i in range(len(lanes))]
        for d in np.argsort(-sizes, kind="stable"):  # the longest document to the shortest lane
            load, lane = heap[0]
            heapq.heapreplace(heap, (load + int(sizes[d]), lane))
            lanes[lane].append(int(d))
        rng = np.random.default_rng(len(docs))
        lanes = [[lane[i] for i in rng.permutation(len(lane))] for lane in lanes]
        loads = np.array([sizes[lane].sum() for lane in lanes], np.int64)
        order = np.argsort(-loads, kind="stable")
        flat = np.array([d for i in order for d in lanes[i]], np.int64)
        tokens = np.concatenate([docs[d] for d in flat]).astype(np.int64)
        ends = np.cumsum(sizes[flat])
        begins = ends - sizes[flat]
        fresh = np.zeros(len(tokens), bool)
        fresh[begins] = True
        inputs = np.empty_like(tokens)
        inputs[1:] = tokens[:-1]
        inputs[begins] = END
        loads = loads[order]
        return cls(tokens, inputs, fresh, np.cumsum(loads) - loads, loads, flat, begins)

    @classmethod
    def stream(cls, docs: list[np.ndarray], most: int, least: int) -> Lanes:
        """All documents, in a mixed order, as one row of tokens cut into lanes of equal size, of at least `least` tokens
        where there are as many: for training, where a lane may begin inside a document."""
        order = np.random.default_rng(len(docs)).permutation(len(docs))
        tokens = np.concatenate([docs[d] for d in order]).astype(np.int64)
        begins = np.cumsum([0, *(len(docs[d]) for d in order)])[:-1]
        lanes = int(np.clip(len(tokens) // least, 1, most))
        starts = np.arange(lanes + 1) * len(tokens) // lanes
        sizes = np.diff(starts)
        by = np.argsort(-sizes, kind="stable")
        fresh = np.zeros(len(tokens), bool)
        fresh[begins] = True
        inputs = np.concatenate([[END], tokens[:-1]])
        inputs[begins] = END
        return cls(tokens, inputs, fresh, starts[:-1][by], sizes[by], order, begins)

    def windows(self, steps: int):
        """(number of lanes still open, places of shape steps x lanes, which of them are real), window by window."""
        for begin in range(0, int(self.sizes[0]) if len(self.sizes) else 0, steps):
            n = int(np.searchsorted(-self.sizes, -begin, side="left"))
            at = begin + np.arange(min(steps, int(self.sizes[0]) - begin))[:, None]
            real = at < self.sizes[None, :n]
            yield n, np.where(real, self.starts[None, :n] + at, self.starts[None, :n]), real


def squash(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += 1
    x *= np.float32(0.5)
    return x


def run(w: dict, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool):
    """States after each step of a window (steps x lanes), and what the way back needs."""
    steps, lanes = inputs.shape
    h = state.shape[1]
    states, kept = np.empty((steps, lanes, h), state.dtype), []
    from_inputs = w["inputs"].take(inputs, axis=0)
    for t in range(steps):
        if fresh[t].any():
            state = np.where(fresh[t][:, None], state.dtype.type(0), state)
        from_state = state @ w["turn"]
        gates = from_inputs[t, :, : 2 * h] + from_state[:, : 2 * h]
        squash(gates)
        reset, update = gates[:, :h], gates[:, h:]
        turned = from_state[:, 2 * h :]
        new = reset * turned
        new += from_inputs[t, :, 2 * h :]
        np.tanh(new, out=new)
        if keep:
            kept.append((state, reset, update, turned, new))
        np.subtract(state, new, out=states[t])
        states[t] *= update
        states[t] += new
        state = states[t]
    return states, state, kept


def exps(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, targets: np.ndarray):
    """The targets' logits, all logits' exponentials and their sums; logits stay within +-60."""
    logits = states @ weights
    logits += bias
    np.clip(logits, -60, 60, out=logits)
    own = logits[np.arange(len(targets)), targets]
    np.exp(logits, out=logits)
    return own, logits, logits @ np.ones(logits.shape[1], logits.dtype)


def by_class(targets: np.ndarray):
    """Each target's class, places sorted by class, and (class, first, next) of each class that occurs."""
    classes = (targets // CLASS_SIZE).astype(np.int16)
    order = np.argsort(classes, kind="stable")
    ends = np.cumsum(np.bincount(classes))
    return classes, order, [(c, int(b - n), int(b)) for c, (b, n) in enumerate(zip(ends, np.diff(ends, prepend=0))) if n]


def log_probabilities(w: dict, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of each target's probability: its class' times its own within the class."""
    classes, order, runs = by_class(targets)
    own, _, total = exps(states, w["class_w"], w["class_b"], classes)
    out = own.astype(np.float64) - np.log(total)
    dealt, within = states[order], (targets % CLASS_SIZE)[order]
    inner = np.empty(len(targets))
    for c, a, b in runs:
        own, _, total = exps(dealt[a:b], w["word_w"][c], w["word_b"][c], within[a:b])
        inner[a:b] = own - np.log(total)
    out[order] += inner
    return out


def score(w: dict, docs: list[np.ndarray], lanes: int, steps: int) -> np.ndarray:
    """Natural log-probability of each whole document; the state is carried from window to window."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    plan = Lanes.of(docs, lanes)
    found = np.zeros(len(plan.tokens))
    state = np.zeros((len(plan.sizes), w["turn"].shape[0]), np.float32)
    for n, at, real in plan.windows(steps):
        states, state, _ = run(w, plan.inputs[at], plan.fresh[at], state[:n], False)
        at = at[real]
        found[at] = log_probabilities(w, states[real], plan.tokens[at])
    out[plan.docs] = np.add.reduceat(found, plan.doc_starts)
    return out


def gradients(w: dict, inputs, fresh, real, targets, state, n: int):
    """Gradients of one window's negative log-probability over `n`, and the state after it.

    Input and word weights come with the rows or classes that they belong to.
    """
    states, after, kept = run(w, inputs, fresh, state, True)
    flat, h = states[real], state.shape[1]
    classes, order, runs = by_class(targets)

    def errors(own, soft, total, at):
        soft /= (total * n)[:, None]
        soft[np.arange(len(at)), at] -= soft.dtype.type(1 / n)
        return soft

    soft = errors(*exps(flat, w["class_w"], w["class_b"], classes), classes)
    grads = {"class_w": flat.T @ soft, "class_b": soft.sum(0)}
    back = soft @ w["class_w"].T
    word_w, word_b = np.empty((len(runs), h, CLASS_SIZE), flat.dtype), np.empty((len(runs), CLASS_SIZE), flat.dtype)
    dealt, within, inner_back = flat[order], (targets % CLASS_SIZE)[order], np.empty_like(flat)
    for k, (c, a, b) in enumerate(runs):
        mine = dealt[a:b]
        inner = errors(*exps(mine, w["word_w"][c], w["word_b"][c], within[a:b]), within[a:b])
        word_w[k], word_b[k] = mine.T @ inner, inner.sum(0)
        np.matmul(inner, w["word_w"][c].T, out=inner_back[a:b])
    back[order] += inner_back
    some = np.array([c for c, _, _ in runs])
    grads["word_w"], grads["word_b"] = (some, word_w), (some, word_b)

    above = np.zeros(states.shape, flat.dtype)
    above[real] = back
    into = np.empty((*inputs.shape, 3 * h), flat.dtype)
    turn, carry = np.zeros_like(w["turn"]), np.zeros_like(state)
    turn_back = np.ascontiguousarray(w["turn"].T)
    through = np.empty((inputs.shape[1], 3 * h), flat.dtype)
    for t in range(len(inputs) - 1, -1, -1):
        before, reset, update, turned, new = kept[t]
        carry = carry + above[t]
        d_new = carry * (1 - update)
        d_new *= 1 - new * new
        gate = into[t]
        gate[:, :h] = d_new * turned * reset * (1 - reset)
        gate[:, h : 2 * h] = carry * (before - new) * update * (1 - update)
        gate[:, 2 * h :] = d_new
        through[:, : 2 * h] = gate[:, : 2 * h]
        np.multiply(d_new, reset, out=through[:, 2 * h :])
        turn += before.T @ through
        carry *= update
        carry += through @ turn_back
        if fresh[t].any():
            carry[fresh[t]] = 0
    grads["turn"] = turn
    rows = inputs.ravel().astype(np.uint16)
    order = np.argsort(rows, kind="stable")
    rows, first = np.unique(rows[order], return_index=True)
    grads["inputs"] = (rows, np.add.reduceat(into.reshape(-1, 3 * h)[order], first, axis=0))
    return grads, after


def train(shape: Shape, flat: np.ndarray, docs: list[np.ndarray], lanes: int, steps: int, rate: float, clip: float = 1.0) -> tuple[np.ndarray, int]:
    """One pass over `docs` by adaptive gradient steps, a step for each window; new weights and the number of steps.

    Gradients stop at a window's first step, the state goes on. A window counts by its tokens, so one of few lanes moves little.
    """
    flat = flat.astype(np.float32).copy()
    w, seen = shape.unpack(flat), shape.unpack(np.full(len(flat), START, np.float32))
    done = 0
    if not docs:
        return flat, done
    plan = Lanes.stream(docs, lanes, 4 * steps)
    state = np.zeros((len(plan.sizes), shape.hidden), np.float32)
    full = lanes * steps
    for n, at, real in plan.windows(steps):
        grads, state = gradients(w, plan.inputs[at], plan.fresh[at], real, plan.tokens[at[real]], state[:n], full)
        size = np.sqrt(sum(float((g[1] if isinstance(g, tuple) else g).ravel() @ (g[1] if isinstance(g, tuple) else g).ravel()) for g in grads.values()))
        scale = np.float32(min(1.0, clip / max(size, 1e-12)))
        for name, g in grads.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            g = g * scale
            squares = seen[name][rows] + g * g
            seen[name][rows] = squares
            w[name][rows] -= rate * g / np.sqrt(squares)
        done += 1
    return flat, done


def whole(flat: np.ndarray) -> np.ndarray:
    return np.round(np.clip(flat.astype(np.float64), -3e4, 3e4) / GRAIN).astype(np.int32)
