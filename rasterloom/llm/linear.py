"""Logistic regression in numpy, and style features of texts, for the classifiers."""

from __future__ import annotations

import operator

import numpy as np

# Groups of byte values that are counted.
GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~", b"!", b"|", b".", b",", b"?", b"\n", b"'\"", b"()[]{}<>", b"-_=+/\\", b":;", b" \t\r\x0b\x0c", bytes(range(128, 256)))
_MEMBER = np.array([[b in g for g in GROUPS] for b in range(256)], dtype=np.float64)
N_STYLE = 2 * len(GROUPS) + 13


def style(text: str) -> list[float]:
    """Numbers on how a whole text is written: bytes by group, words and their repetition, lines."""
    raw = text.encode("utf-8", "surrogatepass")
    share = (np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _MEMBER) / max(1, len(raw))
    words = raw.split()
    n = len(words)
    distinct = len(set(words))
    same = sum(map(operator.eq, words, words[1:])) if n else 0
    lines = raw.split(b"\n")
    held = set(lines)
    upper = sum(map(bytes.isupper, words))
    odd = sum(1 for w in held if w.count(b"|") > 2 or w.isupper())
    size = max(1, n)
    return [
        *share, *np.sqrt(share), np.log1p(n), np.log1p(len(raw)), distinct / size, np.sqrt(same / size), same / size, np.log1p(same), upper / size, np.sqrt(upper / size),
        len(raw) / size if n else 0.0, 1 - len(held) / len(lines), np.log1p(len(lines)), odd / len(held), float(n < 20),
    ]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, offset: bool = True, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the constant, if any) of an L2-regularised logistic regression, by Newton steps over blocks of
    rows. ``weight``: of the rows."""
    n = x.shape[1] + offset
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(n, l2)
    if offset:
        penalty[-1] = 1e-6
    w = np.zeros(n)
    for _ in range(rounds):
        gradient, curve = penalty * w, np.diag(penalty)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096].astype(np.float64)
            part = np.concatenate([part, np.ones((len(part), 1))], axis=1) if offset else part
            p, k = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30))), weight[at : at + 4096]
            gradient = gradient + part.T @ (k * (p - y[at : at + 4096]))
            curve = curve + (part * (k * p * (1 - p) + 1e-9)[:, None]).T @ part
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
