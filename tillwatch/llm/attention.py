"""A small causal self-attention model over symbol numbers, in numpy.

One attention head with a learned bias per distance, a residual path and one hidden layer. The
output has two levels, a softmax over groups of symbols and one within the symbol's group, so that a
probability costs two short softmaxes rather than one over all symbols. Windows overlap: each holds ``context`` symbols, of which the last
``stride`` are scored, so every symbol is scored once with at least ``context - stride`` symbols
before it (fewer only at the beginning of a text).
"""

from __future__ import annotations

import numpy as np

DEFAULTS = {"width": 24, "keys": 12, "hidden": 48, "context": 32, "stride": 20}
_LOW = np.float32(-1e9)
_HIGH = np.float32(60)  # above it attention scores and output values are cut, so exponentials need no maximum first
_THREADLESS = 1 << 17  # multiplications of one product


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    np.minimum(z, _HIGH, out=z)
    own = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], z.dtype))


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` in blocks of rows so small that the BLAS library starts no threads of its own. On matrices as thin
    as these its threads double the CPU time and gain nothing; Spark runs tasks side by side anyway."""
    rows = max(1, _THREADLESS // (w.shape[0] * w.shape[1]))
    whole = len(x) // rows * rows
    out = np.empty((len(x), w.shape[1]), np.result_type(x, w))
    if whole:
        np.matmul(x[:whole].reshape(-1, rows, x.shape[1]), w, out=out[:whole].reshape(-1, rows, w.shape[1]))
    if whole < len(x):
        np.matmul(x[whole:], w, out=out[whole:])
    return out


def _each(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` for windows x places x width: products of many rows instead of one per window."""
    return product(x.reshape(-1, x.shape[2]), w).reshape(*x.shape[:2], w.shape[1])


class Attention:
    def __init__(self, symbols: int, seed: int = 42, **sizes):
        self.sizes = DEFAULTS | sizes
        d, k, h, t = (self.sizes[n] for n in ("width", "keys", "hidden", "context"))
        rng = np.random.default_rng(seed)
        self.groups = int(np.ceil(np.sqrt(symbols)))
        self.members = -(-symbols // self.groups)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {
            "embed": draw(symbols + 1, d, scale=0.3), "query": draw(d, k, scale=d**-0.5), "key": draw(d, k, scale=d**-0.5),
            "value": draw(d, d, scale=d**-0.5), "near": np.zeros(t, np.float32),
            "hidden": draw(d, h, scale=d**-0.5), "hidden0": np.zeros(h, np.float32), "back": draw(h, d, scale=h**-0.5),
            "group": draw(d, self.groups, scale=0.1), "group0": np.zeros(self.groups, np.float32),
            "out": draw(d, self.groups * self.members, scale=0.1), "out0": np.zeros(self.groups * self.members, np.float32),
        }
        self.weights["out0"][symbols:] = _LOW  # places that no symbol fills
        self.start = symbols  # the symbol before a text

    def windows(self, symbols: np.ndarray, bounds: np.ndarray):
        """(inputs, valid, targets, scored) of all texts' windows: inputs and valid are windows x context,
        targets and scored windows x stride; targets are places in ``symbols``."""
        t, s = self.sizes["context"], self.sizes["stride"]
        n = np.diff(bounds)
        per = -(-n // s)
        text = np.repeat(np.arange(len(n)), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        first = nth * s  # of the scored places within the text
        place = first[:, None] + np.arange(s)
        scored = place < n[text][:, None]
        seen = first[:, None] + np.arange(s - t, s) - 1  # the input at a place is the symbol before it
        valid = (seen >= -1) & (seen < n[text][:, None])
        at = np.clip(bounds[:-1][text][:, None] + seen, 0, max(0, len(symbols) - 1))
        inputs = np.where(seen < 0, self.start, symbols[at] if len(symbols) else 0)
        return inputs, valid, np.where(scored, bounds[:-1][text][:, None] + place, 0), scored

    def _bias(self) -> np.ndarray:
        """What is added to the attention scores by distance: a low number for what lies ahead."""
        t, s = self.sizes["context"], self.sizes["stride"]
        back = np.arange(t - s, t)[:, None] - np.arange(t)[None, :]
        return np.where(back >= 0, self.weights["near"][np.maximum(back, 0)], _LOW)

    def forward(self, inputs: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
        w, s = self.weights, self.sizes["stride"]
        own = w["embed"].take(inputs[:, -s:], axis=0)
        q = (w["embed"] @ w["query"]).take(inputs[:, -s:], axis=0)  # queries, keys and values depend on the symbol alone
        k, v = (w["embed"] @ w[name] for name in ("key", "value"))
        k, v = k.take(inputs, axis=0), v.take(inputs, axis=0)
        a = q @ k.transpose(0, 2, 1)
        a *= np.float32(self.sizes["keys"] ** -0.5)
        a += self._bias()
        a += np.where(valid, np.float32(0), _LOW)[:, None, :]
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        mid = own + a @ v
        pre = _each(mid, w["hidden"]) + w["hidden0"]
        act = np.maximum(pre, 0)
        top = mid + _each(act, w["back"])
        return {"own": own, "q": q, "k": k, "v": v, "a": a, "mid": mid, "act": act, "top": top}

    def score(self, symbols: np.ndarray, bounds: np.ndarray, batch: int = 512) -> np.ndarray:
        """The natural log probability of every symbol, as in ``forward``.

        The texts are laid out one behind the other in blocks of ``stride`` places, each behind enough filling
        that windows begin at equal distances, so their keys and values are overlapping views of one array. Queries,
        keys and values depend on the symbol alone and are looked up; a further key component hides the filling,
        a further value component adds the attention up.
        """
        w, t, s = self.weights, self.sizes["context"], self.sizes["stride"]
        scale = np.float32(self.sizes["keys"] ** -0.5)
        embed = np.vstack([w["embed"], np.zeros((1, self.sizes["width"]), np.float32)])  # the last one is the filling
        column = lambda *x: np.concatenate([np.full(len(embed) - 1, x[0]), x[1:]]).astype(np.float32)[:, None]
        query = np.hstack([embed @ w["query"] * scale, column(1, 1)])
        key = np.hstack([embed @ w["key"], column(0, _LOW)])
        value = np.hstack([embed @ w["value"], column(1, 1)])
        bias = self._bias().astype(np.float32)

        n = np.diff(bounds)
        lead = -(-(t - s) // s) * s
        room = lead + -(-n // s) * s
        base = np.cumsum(room) - room + lead  # a text's first place
        places = np.repeat(base - bounds[:-1], n) + np.arange(len(symbols))
        layout = np.full(int(room.sum()) if len(room) else 0, self.start + 1, np.int32)
        layout[places[1:]] = symbols[:-1]  # the input at a place is the symbol before it
        layout[base[n > 0]] = self.start
        windows = max(0, (len(layout) - lead) // s)
        out = np.zeros(len(symbols), np.float64)
        for first in range(0, windows, batch):
            count = min(batch, windows - first)
            seen = layout[first * s + lead - (t - s) : (first + count) * s + lead]
            own = seen[t - s :]
            some = slice(*np.searchsorted(places, [first * s + lead, (first + count) * s + lead]))
            if some.start == some.stop:
                continue
            view = lambda x: np.lib.stride_tricks.as_strided(
                x, (count, t, x.shape[1]), (s * x.strides[0], *x.strides), writeable=False
            )
            a = query[own].reshape(count, s, -1) @ view(key[seen]).transpose(0, 2, 1)
            a += bias
            np.minimum(a, _HIGH, out=a)
            np.exp(a, out=a)
            summed = (a @ view(value[seen])).reshape(count * s, -1)[places[some] - (first * s + lead)]
            mid = summed[:, :-1] / summed[:, -1:]
            mid += embed[layout[places[some]]]
            act = product(mid, w["hidden"]) + w["hidden0"]
            np.maximum(act, 0, out=act)
            mid += product(act, w["back"])
            out[some] = self._log_probs(mid, symbols[some])
        return out

    def _log_probs(self, top: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Log probability of each row's symbol; rows of one group are done together."""
        w, m = self.weights, self.members
        group, member = np.divmod(symbols.astype(np.int16), np.int16(m))
        found = _log_softmax_at(product(top, w["group"]) + w["group0"], group)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=self.groups))
        for g in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            rows = order[ends[g - 1] if g else 0 : ends[g]]
            own = slice(g * m, (g + 1) * m)
            found[rows] += _log_softmax_at(product(top[rows], w["out"][:, own]) + w["out0"][own], member[rows])
        return found

    def gradients(self, inputs, valid, symbols, scored) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch of windows and its gradients; ``symbols`` are the target symbols."""
        w, s = self.weights, self.sizes["stride"]
        f = self.forward(inputs, valid)
        group, member = np.divmod(symbols[scored], self.members)
        order = np.argsort(group.astype(np.min_scalar_type(self.groups)), kind="stable")  # rows of one group stand together
        place, group, member = np.flatnonzero(scored)[order], group[order], member[order]
        top = f["top"].reshape(-1, f["top"].shape[2]).take(place, axis=0)
        rows, n = np.arange(len(place)), max(1, len(place))
        ends = np.cumsum(np.bincount(group, minlength=self.groups)).tolist()
        parts = [
            (slice(a, b), slice(k * self.members, (k + 1) * self.members)) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b
        ]
        first = _softmax(top @ w["group"] + w["group0"])
        second = np.empty((len(place), self.members), top.dtype)
        for some, own in parts:
            second[some] = top[some] @ w["out"][:, own] + w["out0"][own]
        second = _softmax(second)
        chance = first[rows, group].astype(np.float64) * second[rows, member]
        loss = float(-np.log(np.maximum(chance, 1e-30)).sum() / n)
        first[rows, group] -= 1
        second[rows, member] -= 1
        first /= n
        second /= n
        g: dict[str, np.ndarray] = {"group": top.T @ first, "group0": first.sum(axis=0)}
        g["out"], g["out0"] = np.zeros_like(w["out"]), np.zeros_like(w["out0"])
        d_scored = first @ w["group"].T
        for some, own in parts:
            g["out"][:, own] = top[some].T @ second[some]
            g["out0"][own] = second[some].sum(axis=0)
            d_scored[some] += second[some] @ w["out"][:, own].T
        d_top = np.zeros_like(f["top"])
        d_top.reshape(-1, d_top.shape[2])[place] = d_scored
        flat = lambda m: m.reshape(-1, m.shape[-1])
        d_act = _each(d_top, w["back"].T) * (f["act"] > 0)
        g["back"] = flat(f["act"]).T @ flat(d_top)
        g["hidden"], g["hidden0"] = flat(f["mid"]).T @ flat(d_act), flat(d_act).sum(axis=0)
        d_mid = d_top + _each(d_act, w["hidden"].T)
        d_a = d_mid @ f["v"].transpose(0, 2, 1)
        d_v = f["a"].transpose(0, 2, 1) @ d_mid
        d_logit = f["a"] * (d_a - (d_a * f["a"]).sum(axis=2, keepdims=True))
        t = self.sizes["context"]
        back = np.arange(t - s, t)[:, None] - np.arange(t)[None, :]
        g["near"] = np.bincount(back[back >= 0], d_logit.sum(axis=0)[back >= 0], t).astype(np.float32)
        d_logit *= np.float32(self.sizes["keys"] ** -0.5)
        d_q, d_k = d_logit @ f["k"], d_logit.transpose(0, 2, 1) @ f["q"]
        d_key, d_value = self._by_symbol(inputs, d_k, d_v)
        g["embed"], d_query = self._by_symbol(inputs[:, -s:], d_mid, d_q)
        for name, d in ("query", d_query), ("key", d_key), ("value", d_value):
            g[name] = w["embed"].T @ d
            g["embed"] += d @ w[name].T
        return loss, g

    def _by_symbol(self, inputs: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of ``a`` and of ``b`` (windows x places x width) over all places of each symbol."""
        both = np.concatenate([a, b], axis=2).reshape(-1, a.shape[2] + b.shape[2])
        symbols = inputs.ravel().astype(np.min_scalar_type(self.start))
        total = np.zeros((self.start + 1, both.shape[1]), both.dtype)
        n = np.bincount(symbols, minlength=len(total))
        if used := np.flatnonzero(n).tolist():
            order = np.argsort(symbols, kind="stable")
            total[used] = np.add.reduceat(both.take(order, axis=0), (np.cumsum(n) - n)[used], axis=0)
        return total[:, : a.shape[2]], total[:, a.shape[2] :]

    def fit(self, symbols: np.ndarray, bounds: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 4e-3,
            seed: int = 7) -> list[float]:
        """Adam over all windows; returns the mean loss of each epoch."""
        inputs, valid, targets, scored = self.windows(symbols, bounds)
        if not len(inputs):
            return []
        rng = np.random.default_rng(seed)
        every = np.concatenate([v.ravel() for v in self.weights.values()])  # all weights in one row, which the model's are views of
        ends = np.cumsum([v.size for v in self.weights.values()]).tolist()
        self.weights = {k: every[b - v.size : b].reshape(v.shape) for (k, v), b in zip(self.weights.items(), ends)}
        first, second = np.zeros_like(every), np.zeros_like(every)
        losses, step = [], 0
        total = epochs * -(-len(inputs) // batch)
        for _ in range(epochs):
            order, mean = rng.permutation(len(inputs)), []
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                loss, g = self.gradients(inputs[some], valid[some], symbols[targets[some]], scored[some])
                mean.append(loss)
                step += 1
                now = rate * (1 - step / (total + 1)) + rate * 0.02
                d = np.concatenate([g[k].ravel() for k in self.weights])
                first += 0.1 * (d - first)
                second += 0.01 * (d * d - second)
                m, v = first / (1 - 0.9**step), second / (1 - 0.99**step)
                every -= (now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(mean)))
        return losses
