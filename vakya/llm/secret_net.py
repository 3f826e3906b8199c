"""A convolutional network over characters, in numpy: a candidate between its left and right context -> a calibrated probability."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LEFT, RIGHT, WIDTH = 24, 12, 5
#: Longer values are scored in overlapping pieces of this size; the largest score counts.
PIECE = 256
ALPHABET = 130
Candidate = tuple[str, str, str]  # before, value, after


def padded(candidates: list[Candidate], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers (0 pads, 129 is all that isn't ASCII) and the lengths of the values, which begin at LEFT."""
    whole = "".join((before[-LEFT:].rjust(LEFT, "\0") + value + after[:RIGHT].ljust(RIGHT, "\0")).ljust(size, "\0") for before, value, after in candidates)
    codes = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32).reshape(len(candidates), size)
    return np.where(codes < 128, codes, 129).astype(np.int16), np.array([len(v) for _, v, _ in candidates])


def pieces(value: str) -> list[str]:
    return [value[i : i + PIECE] for i in range(0, max(len(value) - PIECE // 2, 1), PIECE // 2)]


def shape(value: str) -> str:
    """The class of a value that has a threshold of its own: hex, letters and digits, or more."""
    if all(c in "0123456789abcdef" for c in value.lower()):
        return "hex"
    return "alnum" if value.isalnum() else "other"


@dataclass
class Net:
    """Embedding, one convolution, maxima and means over the value and maxima over its context, one linear output."""

    weights: dict[str, np.ndarray]
    #: Platt scaling of the output.
    scale: tuple[float, float] = (1.0, 0.0)
    #: Least probability by ``shape``.
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def new(seed: int, embedding: int = 8, channels: int = 20) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        return Net({"embed": draw(ALPHABET, embedding, scale=0.5), "conv": draw(WIDTH, embedding + 1, channels, scale=0.2), "bias": np.zeros(channels, np.float32), "out": draw(3 * channels, scale=0.1), "last": np.zeros(1, np.float32)})

    def forward(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, dict]:
        w, span = self.weights, codes.shape[1] - WIDTH + 1
        at = np.arange(codes.shape[1])
        value = (at >= LEFT) & (at < LEFT + lengths[:, None])
        e = np.concatenate([w["embed"][codes], value[..., None].astype(np.float32)], axis=2)
        h = sum(e[:, k : k + span] @ w["conv"][k] for k in range(WIDTH)) + w["bias"]
        np.maximum(h, 0, out=h)
        middle = slice(WIDTH // 2, WIDTH // 2 + span)
        inside = value[:, middle].astype(np.float32)[..., None]
        around = (~value[:, middle] & (codes[:, middle] > 0)).astype(np.float32)[..., None]
        hi, ho = h * inside, h * around
        a, b = hi.argmax(1), ho.argmax(1)
        pick = lambda m, i: np.take_along_axis(m, i[:, None], 1)[:, 0]
        pooled = np.concatenate([pick(hi, a), hi.sum(1) / lengths[:, None], pick(ho, b)], axis=1)
        return pooled @ w["out"] + w["last"], {"e": e, "h": h, "inside": inside, "around": around, "a": a, "b": b, "pooled": pooled, "codes": codes, "lengths": lengths}

    def gradients(self, error: np.ndarray, seen: dict) -> dict[str, np.ndarray]:
        """Of the mean loss, given its derivative by each output."""
        w, n = self.weights, len(self.weights["bias"])
        error = error.astype(np.float32)
        back = error[:, None] * w["out"]
        d = np.zeros_like(seen["h"])
        d += (back[:, n : 2 * n] / seen["lengths"][:, None])[:, None] * seen["inside"]
        rows, channels = np.arange(len(d))[:, None], np.arange(n)
        for at, part, mask in ((seen["a"], back[:, :n], seen["inside"]), (seen["b"], back[:, 2 * n :], seen["around"])):
            d[rows, at, channels] += part * mask[rows, at, 0]  # a maximum passes its gradient to where it was
        d *= seen["h"] > 0
        span, e = d.shape[1], seen["e"]
        conv = np.stack([np.einsum("nlc,nlo->co", e[:, k : k + span], d, optimize=True) for k in range(WIDTH)])
        de = np.zeros_like(e)
        for k in range(WIDTH):
            de[:, k : k + span] += d @ w["conv"][k].T
        embed = np.zeros_like(w["embed"])
        np.add.at(embed, seen["codes"].ravel(), de[..., :-1].reshape(-1, embed.shape[1]))
        return {"embed": embed, "conv": conv, "bias": d.sum((0, 1)), "out": seen["pooled"].T @ error, "last": error.sum(keepdims=True)}

    def outputs(self, candidates: list[Candidate]) -> np.ndarray:
        """Raw outputs; values of any length, in batches of similar length."""
        flat = [(k, (b, p, a)) for k, (b, v, a) in enumerate(candidates) for p in pieces(v)]
        found = np.full(len(candidates), -np.inf, np.float32)
        by_size: dict[int, list] = {}
        for k, c in flat:
            by_size.setdefault(next(s for s in (16, 32, 64, PIECE) if len(c[1]) <= s), []).append((k, c))
        for size, group in by_size.items():
            for i in range(0, len(group), 512):
                part = group[i : i + 512]
                out = self.forward(*padded([c for _, c in part], LEFT + size + RIGHT))[0]
                np.maximum.at(found, np.array([k for k, _ in part]), out)
        return found

    def probabilities(self, candidates: list[Candidate]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.outputs(candidates) + b, -60, 60)))


def fit(net: Net, candidates: list[Candidate], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.004, seed: int = 0) -> None:
    """Adam on the logistic loss. Longer values are cut to their first piece here, as any piece of a secret is one."""
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    order, step = np.arange(len(candidates)), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            part = [(b, x[:PIECE], a) for b, x, a in (candidates[j] for j in at)]
            out, seen = net.forward(*padded(part, LEFT + max(len(x) for _, x, _ in part) + RIGHT))
            error = (1 / (1 + np.exp(-np.clip(out, -60, 60))) - labels[at]) / len(at)
            step += 1
            for k, g in net.gradients(error, seen).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net.weights[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def calibrate(net: Net, candidates: list[Candidate], labels: np.ndarray, recall: float) -> None:
    """Platt scaling by Newton steps on held-out findings, then for each shape the highest threshold that still finds the given share of its positives (of all, where it has under 20)."""
    out, a, b = np.clip(net.outputs(candidates), -30, 30).astype(float), 1.0, 0.0
    target = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * out + b, -60, 60)))
        g = np.array([((p - target) * out).sum() + 0.01 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * out * out).sum() + 0.01, (s * out).sum()], [(s * out).sum(), s.sum() + 1e-6]])
        change = np.linalg.solve(hess, g)
        a, b = a - change[0], b - change[1]
        if abs(change).max() < 1e-6:
            break
    net.scale = (max(a, 1e-3), b)
    p, kinds = net.probabilities(candidates), np.array([shape(v) for _, v, _ in candidates])

    def least(mask: np.ndarray) -> float:
        good = np.sort(p[mask & (labels > 0)])
        return float(good[int((1 - recall) * len(good))]) if len(good) else 1.0

    every = least(np.ones(len(p), bool))
    net.thresholds = {k: least(kinds == k) if ((kinds == k) & (labels > 0)).sum() >= 20 else every for k in ("hex", "alnum", "other")}
