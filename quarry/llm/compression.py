"""Compressed sizes under zstandard raw-content dictionaries: the measure behind two classifiers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import zstandard


class SizeModel:
    """Sizes of texts when compressed against each of several dictionaries, in pieces of that many bytes (0: whole). Pickles as
    the dictionaries alone."""

    def __init__(self, dictionaries: list[bytes], level: int, piece: int = 0) -> None:
        self.dictionaries, self.level, self.piece = dictionaries, level, piece
        self._compressors: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> tuple[list[bytes], int, int]:
        return self.dictionaries, self.level, self.piece

    def __setstate__(self, state: tuple[list[bytes], int, int]) -> None:
        self.__init__(*state)

    def sizes(self, texts: Iterable[bytes]) -> np.ndarray:
        """One row per text, one column per dictionary."""
        if self._compressors is None:
            self._compressors = [self._compressor(raw) for raw in self.dictionaries]
        rows = [[sum(len(c.compress(p)) for p in self._pieces(text)) for c in self._compressors] for text in texts]
        return np.array(rows, dtype=np.int64).reshape(-1, len(self.dictionaries))

    def _pieces(self, text: bytes) -> list[bytes]:
        if not self.piece or len(text) <= self.piece:
            return [text]
        return [text[i : i + self.piece] for i in range(0, len(text), self.piece)]

    def _compressor(self, raw: bytes) -> zstandard.ZstdCompressor:
        plain = {"level": self.level, "write_checksum": False, "write_content_size": False}
        if len(raw) < 8:
            return zstandard.ZstdCompressor(**plain)
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(dict_data=dictionary, **plain)


def gather(texts: Iterable[bytes], room: int) -> tuple[bytes, int]:
    """Whole texts, joined while they fit, and how many were taken."""
    taken, used = [], 0
    for text in texts:
        if used + len(text) + 1 > room:
            break
        taken.append(text)
        used += len(text) + 1
    return b"\n".join(taken), len(taken)


class Logistic:
    """Weighted logistic regression with an L2 term, by damped Newton steps; standardises its inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> None:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z, total = self._inputs(x), weight.sum()
        ridge = np.full(z.shape[1], l2)
        ridge[0] = 1e-6
        self.beta = np.zeros(z.shape[1])

        def loss(beta: np.ndarray) -> float:
            margin = z @ beta
            return float((weight * (np.logaddexp(0, margin) - y * margin)).sum() / total + 0.5 * (ridge * beta**2).sum())

        for _ in range(50):
            p = _sigmoid(z @ self.beta)
            slope = z.T @ (weight * (p - y)) / total + ridge * self.beta
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z / total + np.diag(ridge + 1e-9)
            step, rate, now = np.linalg.solve(curve, slope), 1.0, loss(self.beta)
            while rate > 1e-4 and loss(self.beta - rate * step) > now:
                rate /= 2
            self.beta = self.beta - rate * step
            if np.abs(rate * step).max() < 1e-8:
                break

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.spread, -8, 8)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._inputs(x) @ self.beta)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
