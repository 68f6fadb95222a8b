"""Segmentation lattices over a fixed public vocabulary, marginalised in log space for many words at once.

A word is spelled as the word-start mark followed by its characters.  Every vocabulary piece that matches a
span is an edge; a character that is no piece of its own is one edge spelled by its UTF-8 byte pieces, so every
text has some path.  Pieces never contain an inner word-start mark, hence the lattice of a text is the chain of
the lattices of its words and each distinct word is summed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 18
#: Cells (words times positions) worked on at once; bounds a worker's memory.
CELLS = 1 << 15


def load_pieces(model_path: str) -> tuple[list[str], list[int]]:
    """The usable pieces of a sentencepiece file in id order ('' where an id is no piece), and the 256 byte ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces, byte_ids = [], [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        spelled = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
        pieces.append(piece if spelled and MARK not in piece[1:] else "")
    return pieces, byte_ids


@dataclass
class Edges:
    """Of words of one length: the id of the piece of length k that starts at each place (-1: none)."""

    rows: np.ndarray
    length: int
    by_length: list[tuple[int, np.ndarray]]
    missing: np.ndarray  # code points that only bytes can spell, 0 elsewhere


class Lattice:
    def __init__(self, pieces: list[str], byte_ids: list[int]):
        self.size = len(pieces)
        self.byte_ids = np.array(byte_ids)
        self.longest = max(map(len, pieces))
        keys, ids = [], []
        for i, piece in enumerate(pieces):
            if piece:
                keys.append(self._hash_one(piece))
                ids.append(i)
        keys = np.array(keys, dtype=np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two vocabulary pieces share a hash")
        size = 1 << _SLOT_BITS
        self._keys, self._ids = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        self._probes = 1
        for slot, key, i in zip(self._slot(keys).tolist(), keys, ids, strict=True):
            probes = 1
            while self._ids[slot] >= 0:
                slot, probes = (slot + 1) % size, probes + 1
            self._keys[slot], self._ids[slot] = key, i
            self._probes = max(self._probes, probes)

    @staticmethod
    def _hash_one(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) % (1 << 64)
        return h

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        flat = keys.ravel()
        slot = self._slot(flat)
        out = np.where(self._keys[slot] == flat, self._ids[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self._ids[slot] >= 0))
        for step in range(1, self._probes):
            if not len(open_):
                break
            at = (slot[open_] + step) % len(self._keys)
            hit = self._keys[at] == flat[open_]
            out[open_[hit]] = self._ids[at[hit]]
            open_ = open_[~hit & (self._ids[at] >= 0)]
        return out.reshape(keys.shape)

    def edges(self, words: list[str]) -> Iterator[Edges]:
        """The lattices of words, in groups of one length, each within CELLS (one word at least)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        start = 0
        while start < len(order):
            n = int(lengths[order[start]])
            stop = int(np.searchsorted(lengths[order], n, side="right"))
            stop = min(stop, start + max(1, CELLS // (n + 1)))
            rows = order[start:stop]
            start = stop
            joined = "".join(MARK + words[i] for i in rows.tolist())
            points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), n + 1)
            yield self._edges(rows, points)

    def _edges(self, rows: np.ndarray, points: np.ndarray) -> Edges:
        count, n = points.shape
        prefix = np.zeros((count, n + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                prefix[:, i + 1] = prefix[:, i] * _P + points[:, i].astype(np.uint64) + np.uint64(1)
            power, found = np.uint64(1), []
            missing = np.zeros_like(points)
            for k in range(1, min(n, self.longest) + 1):
                power = power * _P
                ids = self._find(prefix[:, k:] - prefix[:, :-k] * power)
                if k == 1:
                    missing = np.where(ids < 0, points, 0)
                if k == 1 or (ids >= 0).any():
                    found.append((k, ids))
        return Edges(rows, n, found, missing)

    def _spelled(self, e: Edges, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points of e that need bytes, and their log probabilities."""
        points = np.unique(e.missing)
        points = points[points > 0]
        worth = [logp[self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]].sum(axis=0) for c in points.tolist()]
        return points, np.array(worth).reshape(len(points), logp.shape[1])

    def _weights(self, e: Edges, logp: np.ndarray, k: int, ids: np.ndarray, at: int, spelled) -> tuple[np.ndarray, np.ndarray]:
        """Rows with an edge of length k that starts at place at, and the edges' log probabilities."""
        col = ids[:, at]
        if k == 1:
            worth = logp[np.maximum(col, 0)]
            bytes_ = np.flatnonzero(col < 0)
            if len(bytes_):
                worth[bytes_] = spelled[1][np.searchsorted(spelled[0], e.missing[bytes_, at])]
            return np.arange(len(col)), worth
        rows = np.flatnonzero(col >= 0)
        return rows, logp[col[rows]]

    def _forward(self, e: Edges, logp: np.ndarray, spelled) -> np.ndarray:
        alpha = np.full((e.length + 1, len(e.rows), logp.shape[1]), -np.inf)
        alpha[0] = 0.0
        for j in range(1, e.length + 1):
            for k, ids in e.by_length:
                if k > j:
                    break
                rows, worth = self._weights(e, logp, k, ids, j - k, spelled)
                if k == 1:
                    alpha[j] = alpha[j - 1] + worth
                elif len(rows):
                    alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[j - k, rows] + worth)
        return alpha

    def log_probability(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability under each column of logp (pieces by models)."""
        out = np.zeros((len(words), logp.shape[1]))
        for e in self.edges(words):
            out[e.rows] = self._forward(e, logp, self._spelled(e, logp))[-1]
        return out

    def expected(self, words: list[str], weights: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece in words (weights: words by models), by forward-backward sums; the words' log probabilities, summed."""
        total, models = np.zeros(logp.shape), logp.shape[1]
        likely = np.zeros(models)
        for e in self.edges(words):
            spelled = self._spelled(e, logp)
            alpha = self._forward(e, logp, spelled)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            weight = weights[e.rows]
            likely += (alpha[-1] * weight).sum(axis=0)
            for i in range(e.length - 1, -1, -1):
                for k, ids in e.by_length:
                    if i + k > e.length:
                        break
                    rows, worth = self._weights(e, logp, k, ids, i, spelled)
                    if not len(rows):
                        continue
                    tail = worth + beta[i + k, rows]
                    beta[i, rows] = tail if k == 1 else np.logaddexp(beta[i, rows], tail)
                    use = np.exp(alpha[i, rows] + tail - alpha[-1, rows]) * weight[rows]
                    col = ids[rows, i]
                    piece = col >= 0
                    np.add.at(total.reshape(-1), (col[piece, None] * models + np.arange(models)).ravel(), use[piece].ravel())
                    if k == 1 and (col < 0).any():
                        for r in np.flatnonzero(col < 0).tolist():
                            for b in chr(e.missing[r, i]).encode("utf-8", "surrogatepass"):
                                total[self.byte_ids[b]] += use[r]
        return total, likely

    def occurrences(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """How often each piece matches anywhere in words; where the estimation of piece scores starts."""
        total = np.zeros((self.size, weights.shape[1]))
        for e in self.edges(words):
            for _, ids in e.by_length:
                row, at = np.nonzero(ids >= 0)
                for m in range(weights.shape[1]):
                    total[:, m] += np.bincount(ids[row, at], weights=weights[e.rows[row], m], minlength=self.size)
        return total


class Remembered:
    """Log probabilities of words under fixed piece scores; those of words met before are kept, KEPT words at most."""

    KEPT, KEPT_BYTES = 150_000, 64

    def __init__(self, lattice: Lattice, logp: np.ndarray):
        self.lattice, self.logp = lattice, logp
        self.words, self.worth, self.hits = pa.array([], pa.large_string()), np.zeros((0, logp.shape[1])), np.zeros(0, dtype=np.int32)

    def __call__(self, words: pa.Array) -> np.ndarray:
        """A row for each of some distinct words."""
        found = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(found < 0)
        fresh = words.take(pa.array(new))
        out = np.zeros((len(words), self.logp.shape[1]))
        out[found >= 0] = self.worth[found[found >= 0]]
        out[new] = self.lattice.log_probability(fresh.to_pylist(), self.logp)
        self.hits[found[found >= 0]] += 1
        self._keep(fresh, out[new])
        return out

    def _keep(self, words: pa.Array, worth: np.ndarray) -> None:
        short = pc.binary_length(words).to_numpy() <= self.KEPT_BYTES
        words, worth = words.filter(pa.array(short)), worth[short]
        if len(self.words) + len(words) > self.KEPT:
            least = 1
            while (stays := self.hits >= least).sum() > self.KEPT // 2:
                least *= 2
            self.words, self.worth, self.hits = self.words.filter(pa.array(stays)), self.worth[stays], self.hits[stays] // 2
        room = self.KEPT - len(self.words)
        self.words, self.worth = pa.concat_arrays([self.words, words[:room]]), np.concatenate([self.worth, worth[:room]])
        self.hits = np.concatenate([self.hits, np.zeros(len(self.words) - len(self.hits), dtype=np.int32)])
