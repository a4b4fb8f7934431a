"""Joint intent and slot model in numpy: causal TCN or GRU encoder, two linear heads. Weights are a dict of arrays."""

from __future__ import annotations

import math

import numpy as np

from brightloom.core.canonical import make_rng, stable_hash

KERNEL = 3


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2.0)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class JointModel:
    """``spec``: kind (tcn or gru), n_mels, hidden, layers, intents, tags."""

    def __init__(self, spec: dict, weights: dict[str, np.ndarray] | None = None, seed: int = 0):
        self.spec, self.weights = spec, weights or self._start(spec, seed)

    @staticmethod
    def _start(spec: dict, seed: int) -> dict[str, np.ndarray]:
        rng, h, w = make_rng(seed), spec["hidden"], {}
        new = lambda *shape: rng.uniform(-1, 1, shape) / math.sqrt(shape[-1])
        if spec["kind"] == "tcn":
            w |= {"in.w": new(h, spec["n_mels"]), "in.b": np.zeros(h)}
            for i in range(spec["layers"]):
                w |= {f"conv{i}.w": new(KERNEL, h, h), f"conv{i}.b": np.zeros(h)}
        else:
            for i in range(spec["layers"]):
                w |= {f"gru{i}.x": new(3 * h, spec["n_mels"] if i == 0 else h), f"gru{i}.h": new(3 * h, h), f"gru{i}.bx": np.zeros(3 * h), f"gru{i}.bh": np.zeros(3 * h)}
        for name, n in (("intent", len(spec["intents"])), ("slot", len(spec["tags"]))):
            w |= {f"{name}.w": new(n, h), f"{name}.b": np.zeros(n)}
        return w

    @property
    def receptive_field(self) -> int | None:
        return 1 + sum((KERNEL - 1) * 2**i for i in range(self.spec["layers"])) if self.spec["kind"] == "tcn" else None

    @property
    def model_hash(self) -> str:
        """Of the spec, not the weights."""
        return stable_hash(self.spec)

    def encode(self, mel: np.ndarray, hidden: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray] | None]:
        """States [T, hidden] of frames [T, n_mels]; no state depends on a later frame."""
        w, x = self.weights, np.asarray(mel, float)
        if self.spec["kind"] == "tcn":
            x = x @ w["in.w"].T + w["in.b"]
            for i in range(self.spec["layers"]):
                step = 2**i
                padded = np.concatenate([np.zeros(((KERNEL - 1) * step, x.shape[1])), x])
                x = gelu(sum(padded[k * step : k * step + len(x)] @ w[f"conv{i}.w"][k].T for k in range(KERNEL)) + w[f"conv{i}.b"])
            return x, None
        n, h = self.spec["layers"], self.spec["hidden"]
        hidden = [np.zeros(h) for _ in range(n)] if hidden is None else list(hidden)
        sig = lambda v: 1 / (1 + np.exp(-v))
        for i in range(n):
            out, state = [], hidden[i]
            for row in x @ w[f"gru{i}.x"].T + w[f"gru{i}.bx"]:
                rec = w[f"gru{i}.h"] @ state + w[f"gru{i}.bh"]
                r, z = sig(row[:h] + rec[:h]), sig(row[h : 2 * h] + rec[h : 2 * h])
                state = (1 - z) * np.tanh(row[2 * h :] + r * rec[2 * h :]) + z * state
                out.append(state)
            x, hidden[i] = np.array(out).reshape(-1, h), state
        return x, hidden

    def intent_logits(self, state_sum: np.ndarray, count: int) -> np.ndarray:
        return self.weights["intent.w"] @ (state_sum / max(1, count)) + self.weights["intent.b"]

    def slot_logits(self, states: np.ndarray) -> np.ndarray:
        return states @ self.weights["slot.w"].T + self.weights["slot.b"]

    def predict(self, mel: np.ndarray) -> tuple[str, list[str]]:
        states, _ = self.encode(mel)
        best = int(self.intent_logits(states.sum(axis=0), len(states)).argmax())
        return self.spec["intents"][best], [self.spec["tags"][i] for i in self.slot_logits(states).argmax(axis=1)]

    def fit_heads(self, examples: list[tuple[np.ndarray, int, np.ndarray]], epochs: int = 60, rate: float = 0.05) -> list[float]:
        """Trains both heads on fixed encoder states by Adam on the sum of their cross-entropies; the loss of each epoch."""
        states = [self.encode(mel)[0] for mel, _, _ in examples]
        pooled = np.array([s.mean(axis=0) for s in states])
        frames, tags = np.concatenate(states), np.concatenate([t for _, _, t in examples])
        intents = np.array([i for _, i, _ in examples])
        names, moments, losses = ("intent.w", "intent.b", "slot.w", "slot.b"), {}, []
        for step in range(1, epochs + 1):
            grads, loss = {}, 0.0
            for name, x, y in (("intent", pooled, intents), ("slot", frames, tags)):
                p = softmax(x @ self.weights[f"{name}.w"].T + self.weights[f"{name}.b"])
                loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())
                p[np.arange(len(y)), y] -= 1
                grads |= {f"{name}.w": p.T @ x / len(y), f"{name}.b": p.mean(axis=0)}
            for n in names:
                m, v = moments.get(n, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * grads[n], 0.999 * v + 0.001 * grads[n] ** 2
                moments[n] = m, v
                self.weights[n] = self.weights[n] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            losses.append(loss)
        return losses
