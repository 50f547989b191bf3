"""A character LSTM in NumPy: embedding, stacked LSTM layers, linear output, cross-entropy, full backward pass, Adam.

Gates are in the order input, forget, cell, output. State starts at zero in every batch. Dropout applies between layers
only, as a mask that the caller seeds. Parameters are a flat dict of named arrays, so that they travel as table rows.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def init_params(vocab_size: int, embed: int = 128, hidden: int = 256, layers: int = 2, seed: int = 0) -> Params:
    """Uniform weights within 1/sqrt(hidden), a normal embedding."""
    rng = np.random.default_rng(seed)
    bound = 1 / np.sqrt(hidden)
    params: Params = {"embedding.weight": rng.normal(size=(vocab_size, embed))}
    for k in range(layers):
        width = embed if k == 0 else hidden
        for name, shape in (("w_ih", (4 * hidden, width)), ("w_hh", (4 * hidden, hidden)), ("b_ih", (4 * hidden,)), ("b_hh", (4 * hidden,))):
            params[f"lstm.{k}.{name}"] = rng.uniform(-bound, bound, size=shape)
    params["fc.weight"] = rng.uniform(-bound, bound, size=(vocab_size, hidden))
    params["fc.bias"] = rng.uniform(-bound, bound, size=vocab_size)
    return params


def count_params(params: Params) -> int:
    return sum(p.size for p in params.values())


def layer_count(params: Params) -> int:
    return sum(name.endswith(".w_ih") for name in params)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def forward(params: Params, x: np.ndarray, masks: list[np.ndarray] | None = None, state: list[tuple[np.ndarray, np.ndarray]] | None = None):
    """Logits (batch, length, vocabulary), the final state of each layer, and what the backward pass needs."""
    batch, length = x.shape
    inputs, caches, final = params["embedding.weight"][x], [], []
    for k in range(layer_count(params)):
        w, u = params[f"lstm.{k}.w_ih"], params[f"lstm.{k}.w_hh"]
        hidden = u.shape[1]
        pre = inputs @ w.T + params[f"lstm.{k}.b_ih"] + params[f"lstm.{k}.b_hh"]
        h, c = state[k] if state else (np.zeros((batch, hidden)), np.zeros((batch, hidden)))
        hs, cs, gates = [h], [c], []
        for t in range(length):
            z = pre[:, t] + hs[-1] @ u.T
            i, f, o = (_sigmoid(z[:, j * hidden : (j + 1) * hidden]) for j in (0, 1, 3))
            g = np.tanh(z[:, 2 * hidden : 3 * hidden])
            cs.append(f * cs[-1] + i * g)
            hs.append(o * np.tanh(cs[-1]))
            gates.append((i, f, g, o))
        caches.append((inputs, hs, cs, gates))
        final.append((hs[-1], cs[-1]))
        inputs = np.stack(hs[1:], axis=1)
        if masks and k + 1 < layer_count(params):
            inputs = inputs * masks[k]
    logits = inputs @ params["fc.weight"].T + params["fc.bias"]
    return logits, final, (x, inputs, caches, masks)


def cross_entropy(logits: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood over all tokens, and its gradient."""
    flat = logits - logits.max(axis=-1, keepdims=True)
    total = np.exp(flat).sum(axis=-1, keepdims=True)
    logp = flat - np.log(total)
    loss = -np.take_along_axis(logp, y[..., None], axis=-1).mean()
    grad = np.exp(logp)
    np.put_along_axis(grad, y[..., None], np.take_along_axis(grad, y[..., None], axis=-1) - 1, axis=-1)
    return float(loss), grad / y.size


def backward(params: Params, cache, grad: np.ndarray) -> Params:
    """Gradients of all parameters, back through every step of the window."""
    x, top, caches, masks = cache
    out: Params = {"fc.weight": np.einsum("btv,bth->vh", grad, top), "fc.bias": grad.sum(axis=(0, 1))}
    flowing = grad @ params["fc.weight"]
    for k in reversed(range(layer_count(params))):
        if masks and k + 1 < layer_count(params):
            flowing = flowing * masks[k]
        inputs, hs, cs, gates = caches[k]
        u = params[f"lstm.{k}.w_hh"]
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(cs[0])
        dz = np.empty((*inputs.shape[:2], u.shape[0]))
        for t in reversed(range(inputs.shape[1])):
            i, f, g, o = gates[t]
            squashed = np.tanh(cs[t + 1])
            dh = dh + flowing[:, t]
            dc = dc + dh * o * (1 - squashed**2)
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * cs[t] * f * (1 - f), dc * i * (1 - g**2), dh * squashed * o * (1 - o)], axis=1)
            dh, dc = dz[:, t] @ u, dc * f
        before = np.stack(hs[:-1], axis=1)
        out[f"lstm.{k}.w_ih"] = np.einsum("btz,bti->zi", dz, inputs)
        out[f"lstm.{k}.w_hh"] = np.einsum("btz,bth->zh", dz, before)
        out[f"lstm.{k}.b_ih"] = out[f"lstm.{k}.b_hh"] = dz.sum(axis=(0, 1))
        flowing = dz @ params[f"lstm.{k}.w_ih"]
    embedding = np.zeros_like(params["embedding.weight"])
    np.add.at(embedding, x, flowing)
    out["embedding.weight"] = embedding
    return out


def loss_and_gradients(params: Params, x: np.ndarray, y: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[float, Params]:
    logits, _, cache = forward(params, x, masks)
    loss, grad = cross_entropy(logits, y)
    return loss, backward(params, cache, grad)


def dropout_masks(params: Params, batch: int, length: int, rate: float, rng: np.random.Generator) -> list[np.ndarray] | None:
    """Scaled masks for all layers but the last; none for a single layer."""
    layers, hidden = layer_count(params), params["lstm.0.w_hh"].shape[1]
    if layers < 2 or not rate:
        return None
    return [(rng.random((batch, length, hidden)) >= rate) / (1 - rate) for _ in range(layers - 1)]


def gradient_norm(gradients: Params) -> float:
    return float(np.sqrt(sum((g**2).sum() for g in gradients.values())))


def clipped(gradients: Params, most: float = 1.0) -> Params:
    factor = min(1.0, most / (gradient_norm(gradients) + 1e-6))
    return {name: g * factor for name, g in gradients.items()}


class Adam:
    """Adam with the usual defaults; a parameter without a gradient stays as it is."""

    def __init__(self, lr: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.lr, self.betas, self.eps, self.steps = lr, betas, eps, 0
        self.first: Params = {}
        self.second: Params = {}

    def step(self, params: Params, gradients: Params) -> Params:
        self.steps += 1
        (a, b), out = self.betas, dict(params)
        for name, g in gradients.items():
            self.first[name] = a * self.first.get(name, 0.0) + (1 - a) * g
            self.second[name] = b * self.second.get(name, 0.0) + (1 - b) * g**2
            m, v = self.first[name] / (1 - a**self.steps), self.second[name] / (1 - b**self.steps)
            out[name] = params[name] - self.lr * m / (np.sqrt(v) + self.eps)
        return out
