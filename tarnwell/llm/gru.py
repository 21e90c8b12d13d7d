"""A gated recurrent language model in numpy, with a class-factored softmax.

P(word) = P(class of the word | state) * P(word | class, state). Words of one class have like frequencies; classes are
cut so that a text costs few logits. Biases start at the words' own frequencies, so an untrained model is a unigram
model. Training is truncated backpropagation: gradients stay inside a window, the state goes on into the next one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Word numbers with a meaning of their own: all words outside the vocabulary, and the end of a text.
UNKNOWN, END = 0, 1
STATE, CLASSES = 16, 24
WINDOW = 24
LANES = 256
TRAIN_LANES, STEPS, LEARNING = 512, 100, 0.4
SEED = 5


class Shape:
    """How words fall into classes: unknown alone, then words by falling frequency in runs of equal root frequency."""

    def __init__(self, counts: np.ndarray) -> None:
        share = (counts + 1.0) / (counts + 1.0).sum()
        order = 1 + np.argsort(-share[1:], kind="stable")
        mass = np.cumsum(np.sqrt(share[order]))
        of = np.zeros(len(counts), np.uint8)
        of[order] = 1 + np.minimum((mass / mass[-1] * (CLASSES - 1)).astype(int), CLASSES - 2)
        self.of = of
        self.members = [np.flatnonzero(of == c) for c in range(CLASSES)]
        #: The members as a slice, which copies nothing, where they are one run.
        self.run = [slice(int(m[0]), int(m[-1]) + 1) if len(m) and m[-1] - m[0] + 1 == len(m) else m for m in self.members]
        self.place = np.zeros(len(counts), np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        self.share = share


def start(shape: Shape) -> dict[str, np.ndarray]:
    random = np.random.default_rng(SEED)
    words = len(shape.of)
    mass = np.array([max(shape.share[m].sum(), 1e-9) for m in shape.members])
    # The gates (reset, mix, new state) come first, so that each one's numbers lie together.
    small = lambda size: np.ascontiguousarray(random.normal(0, 0.1, (size, 3, STATE)).astype(np.float32).transpose(1, 0, 2))
    return {
        "input": small(words),
        "state": small(STATE),
        "classes": np.zeros((STATE, CLASSES), np.float32),
        "class_bias": np.log(mass).astype(np.float32),
        "words": np.zeros((words, STATE), np.float32),
        "word_bias": np.log(shape.share).astype(np.float32),
    }


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in model.values()]).astype(np.float32)


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _forward(model: dict, words: np.ndarray, opens: np.ndarray, before: np.ndarray, h: np.ndarray) -> tuple:
    """A window of steps x lanes: the words read, the states before and after each step, and the gates, new states and reset
    parts that lead from one to the other. Where a text opens, the state starts anew."""
    steps, lanes = words.shape
    opened = opens.any(axis=1).tolist()
    inputs = np.where(opens, END, np.concatenate([before[None], words[:-1]]))
    seen = np.take(model["input"], inputs, axis=1)  # becomes the gates and the new states in place
    kind = seen.dtype
    gates, news = seen[:2], seen[2]
    states, after, kepts = (np.empty((steps, lanes, STATE), kind) for _ in range(3))
    kept, step = np.empty((3, lanes, STATE), kind), np.empty((lanes, STATE), kind)
    for t in range(steps):
        state, gate, new = states[t], gates[:, t], news[t]
        state[...] = after[t - 1] if t else h
        if opened[t]:
            state[opens[t]] = 0
        np.matmul(state, model["state"], out=kept)
        gate += kept[:2]
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        kepts[t] = kept[2]
        np.multiply(gate[0], kept[2], out=step)
        new += step
        np.tanh(new, out=new)
        np.subtract(new, state, out=step)
        step *= gate[1]
        np.add(state, step, out=after[t])
    return inputs, states, after, gates, news, kepts


def _masses(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) and its sums by row, up to a factor; ``x`` loses the logarithm of that factor."""
    top = x.max(initial=-1e30)
    if top > 40:  # exp stays finite below
        x -= top  # every caller's x is its own
    mass = np.exp(x)
    sums = mass @ np.ones(x.shape[1], x.dtype)
    if not sums.min(initial=1) > 1e-30:  # rows far below the largest value
        x -= x.max(axis=1, keepdims=True)
        mass = np.exp(x)
        sums = mass.sum(axis=1)
    return mass, sums


def _chosen(x: np.ndarray, at: tuple) -> np.ndarray:
    """Log softmax of ``x`` at one place of each row."""
    sums = _masses(x)[1]
    return x[at] - np.log(sums)


def _chosen_and_slope(x: np.ndarray, at: tuple) -> tuple[float, np.ndarray]:
    """Sum of the log softmax at one place of each row, and its gradient by ``x``."""
    mass, sums = _masses(x)
    total = float((x[at] - np.log(sums)).sum())
    mass *= (-1 / sums)[:, None]
    mass[at] += 1
    return total, mass


def _by_class(shape: Shape, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """The order that brings targets of one class together; in it the classes, the places in them, and each class's run."""
    of = np.take(shape.of, target)
    order = np.argsort(of, kind="stable")  # radix sort, as classes are bytes
    edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=CLASSES))]).tolist()
    runs = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]
    return order, of[order], np.take(shape.place, target[order]), runs


def log_odds(model: dict, shape: Shape, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after each state."""
    order, of, place, runs = _by_class(shape, target)
    h, each = np.take(h, order, axis=0), np.arange(len(h))
    logits = h @ model["classes"]
    logits += model["class_bias"]
    logs = _chosen(logits, (each, of)).astype(np.float64)
    for c, rows in runs:
        members = shape.run[c]
        if len(shape.members[c]) > 1:
            logits = h[rows] @ model["words"][members].T
            logits += model["word_bias"][members]
            logs[rows] += _chosen(logits, (each[: len(logits)], place[rows]))
    out = np.empty_like(logs)
    out[order] = logs
    return out


def _windows(texts: list[np.ndarray], order: list[int], count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end, in ``order``, on ``count`` lanes of about equal length, cut into windows of WINDOW steps: each
    place's word, its text, whether a text opens there, and whether the lane lasts so long. The longest lane comes first and
    lanes that have ended are left out, so memory goes by the number of words, however long a text is."""
    lanes: list[list[int]] = [[] for _ in range(count)]
    heap = [(0, k) for k in range(count)]
    for i in order:
        length, k = heapq.heappop(heap)
        lanes[k].append(i)
        heapq.heappush(heap, (length + len(texts[i]), k))
    lengths = np.array([sum(len(texts[i]) for i in lane) for lane in lanes])
    longest_first = np.argsort(-lengths, kind="stable")
    lengths = lengths[longest_first]
    laid = [i for k in longest_first for i in lanes[k]]
    sizes = np.array([len(texts[i]) for i in laid])
    word = np.concatenate([texts[i] for i in laid])
    owner = np.repeat(np.array(laid, np.int32), sizes)
    opens = np.zeros(len(word), bool)
    opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    base = np.cumsum(lengths) - lengths
    for low in range(0, int(lengths.max(initial=0)), WINDOW):
        n = int(np.searchsorted(-lengths, -low, "left"))
        steps = np.arange(low, min(low + WINDOW, int(lengths[0])))[:, None]
        live = steps < lengths[:n]
        at = base[:n] + np.minimum(steps, lengths[:n] - 1)
        yield word[at].astype(np.int32), owner[at], opens[at] & live, live


def score(model: dict, shape: Shape, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text (word numbers, END last).

    Windows of all lanes are read at once; each lane's state goes on from window to window and starts anew with each text.
    """
    total = np.zeros(len(texts))
    longest_first = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    count = min(LANES, len(texts))
    h, before = np.zeros((count, STATE), np.float32), np.full(count, END, np.int32)
    for word, owner, opens, live in _windows(texts, longest_first, count) if texts else ():
        n = word.shape[1]
        after = _forward(model, word, opens, before[:n], h[:n])[2]
        h, before = after[-1], word[-1]
        at = np.flatnonzero(live)
        logs = log_odds(model, shape, after.reshape(-1, STATE)[at], word.ravel()[at])
        total += np.bincount(owner.ravel()[at], logs, len(texts))
    return total


def _sum_rows(parts: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows``, ascending, and for each part the sums of its values by them."""
    order = np.argsort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, kind="stable")  # radix sort where short
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[first], np.stack([np.add.reduceat(np.take(p, order, axis=0), first, axis=0) for p in parts])


def gradients(model: dict, shape: Shape, words: np.ndarray, opens: np.ndarray, before: np.ndarray, h: np.ndarray, mask: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of a window's log probability (words: steps x lanes), the state after it, and that log probability."""
    out, (read, of_read), h, total = _gradients(model, shape, words, opens, before, h, mask)
    out["input"] = np.zeros_like(model["input"])
    out["input"][:, read] = of_read
    return {k: out[k] for k in model}, h, total


def _gradients(model: dict, shape: Shape, words: np.ndarray, opens: np.ndarray, before: np.ndarray, h: np.ndarray, mask: np.ndarray) -> tuple[dict, tuple, np.ndarray, float]:
    """As ``gradients``, but those of ``input`` only for the words read, after these words.

    What doesn't depend on the recurrence is done for all steps at once, on places in order of their words' classes.
    """
    steps, lanes = words.shape
    inputs, states, after, gates, news, kepts = _forward(model, words, opens, before, h)
    kind = after.dtype
    live = np.flatnonzero(mask)
    order, of, place, runs = _by_class(shape, words.ravel()[live])
    live = live[order]
    at, each, ones = np.take(after.reshape(-1, STATE), live, axis=0), np.arange(len(live)), np.ones(len(live), kind)
    logits = at @ model["classes"]
    logits += model["class_bias"]
    total, slope = _chosen_and_slope(logits, (each, of))
    out = {k: np.zeros_like(model[k]) for k in ("words", "word_bias")}
    out["classes"], out["class_bias"] = at.T @ slope, ones @ slope
    back = slope @ model["classes"].T
    for c, rows in runs:
        members = shape.run[c]
        if len(shape.members[c]) > 1:
            mine, theirs = at[rows], model["words"][members]
            logits = mine @ theirs.T
            logits += model["word_bias"][members]
            part, slope = _chosen_and_slope(logits, (each[: len(mine)], place[rows]))
            total += part
            out["words"][members], out["word_bias"][members] = slope.T @ mine, ones[rows] @ slope
            back[rows] += slope @ theirs
    to_state = np.zeros((steps * lanes, STATE), kind)
    to_state[live] = back
    to_state = to_state.reshape(steps, lanes, STATE)
    inner, of_new = np.empty((3, steps, lanes, STATE), kind), np.empty((steps, lanes, STATE), kind)
    carried, through, keep, part = np.zeros((lanes, STATE), kind), np.empty((3, lanes, STATE), kind), np.empty((lanes, STATE), kind), np.empty((lanes, STATE), kind)
    back_state = np.ascontiguousarray(model["state"].transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        (r, z), new, slope = gates[:, t], news[t], of_new[t]
        carried += to_state[t]
        np.subtract(1, z, out=keep)
        np.multiply(new, new, out=part)
        np.subtract(1, part, out=part)
        part *= z
        np.multiply(carried, part, out=slope)
        np.subtract(new, states[t], out=part)
        part *= z
        part *= keep
        np.multiply(carried, part, out=inner[1, t])
        np.multiply(slope, r, out=inner[2, t])
        np.subtract(1, r, out=part)
        part *= kepts[t]
        np.multiply(part, inner[2, t], out=inner[0, t])
        np.matmul(inner[:, t], back_state, out=through)
        carried *= keep
        for kept in through:
            carried += kept
        if opens[t].any():
            carried[opens[t]] = 0
    out["state"] = np.matmul(states.reshape(-1, STATE).T, inner.reshape(3, -1, STATE))
    read = _sum_rows([p.reshape(-1, STATE) for p in (inner[0], inner[1], of_new)], inputs.ravel())
    return out, read, after[-1], total


def _climb(value: np.ndarray, past: np.ndarray, slope: np.ndarray, rate: float) -> None:
    """One step of ``value`` along ``slope`` (lost), as long as its ``past`` steps let it be."""
    slope *= 1 / WINDOW
    np.clip(slope, -5, 5, out=slope)
    size = slope * slope
    past += size
    np.sqrt(past, out=size)
    slope *= rate
    slope /= size
    value += slope


def train(model: dict, shape: Shape, texts: list[np.ndarray], epochs: int = 1) -> dict:
    """The model after so many passes over the texts, which lie on lanes in random order; adaptive step sizes, so that a
    window of few live tokens moves little, which fall to nothing at the end. Few tokens get fewer lanes, so that there are
    STEPS windows."""
    model = {k: v.copy() for k, v in model.items()}
    past = {k: np.full_like(v, 1e-2) for k, v in model.items()}
    random = np.random.default_rng(SEED)
    size = sum(map(len, texts))
    count = int(np.clip(size // (STEPS * WINDOW), 1, min(TRAIN_LANES, len(texts))))
    seen = 0
    for _ in range(epochs):
        h, before = np.zeros((count, STATE), np.float32), np.full(count, END, np.int32)
        for words, _, opens, mask in _windows(texts, random.permutation(len(texts)).tolist(), count):
            n = words.shape[1]
            slopes, (read, of_read), h, _ = _gradients(model, shape, words, opens, before[:n], h[:n], mask)
            before = words[-1]
            rate = LEARNING * (1 - seen / (epochs * size))
            seen += int(mask.sum())
            for k, g in slopes.items():
                _climb(model[k], past[k], g, rate)
            # Words that weren't read have no gradient and stay as they are.
            value, steps = model["input"][:, read], past["input"][:, read]
            _climb(value, steps, of_read, rate)
            model["input"][:, read], past["input"][:, read] = value, steps
    return model
