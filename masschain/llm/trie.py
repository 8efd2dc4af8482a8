"""A double-array trie over the pieces of an existing vocabulary, and lattices over it in numpy.

Pieces are UTF-8 byte strings with log scores. A step from state s by byte b leads to
base[s] + b if check[base[s] + b] == s. Strings are walked as matrices, one row for each
of many short strings: all places of a block of columns take a step in the trie at once,
and the recursions over a lattice take a column of all rows at once. A few long strings
(words of megabytes) go through the same blocks edge by edge instead, since a column of
one row is no array; memory beyond the block is a few numbers for each byte.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

MARK = "▁"  # stands for a space in pieces; strings are matched with plain spaces


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece
    normal: np.ndarray  # ids of the pieces that the trie holds


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file. Read on the driver: its size is the file's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)])
    normal = np.array([i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))])
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    return Vocabulary(pieces, scores, byte_ids, normal)


def log_weights(v: Vocabulary) -> np.ndarray:
    """Log probabilities of the pieces by their scores, which are read as ranks (0, -1, -2, ...): weight 1 / (rank + 10).

    Pieces that the trie does not hold get the lowest.
    """
    weight = 1 / (10 - np.minimum(v.scores, 0))
    total = weight[v.normal].sum()
    out = np.full(len(weight), weight[v.normal].min() / total)
    out[v.normal] = weight[v.normal] / total
    return np.log(out)


@dataclass
class DoubleArray:
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # piece that ends at a state, or -1
    depth: int

    @classmethod
    def build(cls, keys: list[bytes], values: list[int]) -> DoubleArray:
        """Nodes with one child take the first free place; others the first that takes all their
        children, sought from a little before the last such place on."""
        tree: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in zip(keys, values, strict=True):
            node = 0
            for b in key:
                if b not in tree[node]:
                    tree[node][b] = len(tree)
                    tree.append({})
                    ends.append(-1)
                node = tree[node][b]
            ends[node] = value
        size = len(tree) * 2 + 1024
        base, check, piece = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        used = bytearray(size)
        used[0] = 1
        piece[0] = ends[0]
        state = {0: 0}
        lowest = tail = 257  # places that every byte can reach
        queue = [0]
        for node in queue:
            children = sorted(tree[node])
            if not children:
                base[state[node]] = 1
                continue
            while used[lowest]:
                lowest += 1
            at = max(lowest - children[0], 1)
            if len(children) > 1:
                at = max(at, tail - 256)
            while any(used[at + b] for b in children):
                at += 1
            if len(children) > 1:
                tail = at
            if at + 512 > size - 256:
                grow = size
                base, check, piece = np.append(base, np.zeros(grow, np.int64)), np.append(check, np.full(grow, -1)), np.append(piece, np.full(grow, -1))
                used += bytearray(grow)
                size += grow
            base[state[node]] = at
            for b in children:
                used[at + b] = 1
                child = tree[node][b]
                state[child] = at + b
                check[at + b] = state[node]
                piece[at + b] = ends[child]
                queue.append(child)
        return cls(base.astype(np.int32), check.astype(np.int32), piece.astype(np.int32), max(map(len, keys), default=0))


_WIDTH = np.ones(256, np.int64)  # of a character by its first byte
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 2, 3, 4
BLOCK_CELLS = 1 << 17
FEW_ROWS = 16


class Lattice:
    """All segmentations of byte strings into pieces, as matrices over many strings (rows, lengths)."""

    def __init__(self, vocabulary: Vocabulary, scores: np.ndarray, unknown: float):
        """scores: of all pieces; unknown: of a character that no piece covers, which becomes its bytes."""
        self.v, self.unknown = vocabulary, unknown
        self.scores = np.append(scores, unknown)  # the last, at -1: of an unknown character
        keys = [vocabulary.pieces[i].replace(MARK, " ").encode() for i in vocabulary.normal]
        self.trie = DoubleArray.build(keys, vocabulary.normal.tolist())

    def edges(self, rows: np.ndarray, lengths: np.ndarray, lo: int, hi: int):
        """(row, start, end, piece) of the pieces that start in columns lo to hi-1, by start.

        A character without a piece of its own is an edge of piece -1.
        """
        trie, n = self.trie, rows.shape[1]
        part = rows[:, lo:hi]
        here = ((part & 0xC0) != 0x80) & (np.arange(lo, lo + part.shape[1]) < lengths[:, None])
        at = np.flatnonzero(here.T.reshape(-1))
        start, row = lo + at // len(rows), at % len(rows)
        cells, flat, left = rows.reshape(-1), row * n + start, lengths[row] - start
        width = np.minimum(_WIDTH[cells[flat]], left)
        covered = np.zeros(len(at), bool)
        state, who = np.zeros(len(at), np.int32), np.arange(len(at))
        found = []
        for step in range(trie.depth):
            if step:
                inside = left[who] > step
                state, who = state[inside], who[inside]
            nxt = trie.base[state] + cells[flat[who] + step]
            ok = trie.check[nxt] == state
            state, who = nxt[ok], who[ok]
            if not len(who):
                break
            piece = trie.piece[state]
            hit = np.flatnonzero(piece >= 0)
            own = who[hit]
            found.append((own, piece[hit], np.full(len(own), step + 1)))
            covered[own] |= width[own] == step + 1
        bare = np.flatnonzero(~covered)
        found.append((bare, np.full(len(bare), -1, np.int32), width[bare]))
        who, piece, size = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(who, kind="stable")  # places go by start, then row
        who = who[order]
        return row[who], start[who], start[who] + size[order], piece[order]

    def _blocks(self, rows: np.ndarray):
        step = max(1, BLOCK_CELLS // len(rows))
        return [(lo, min(lo + step, rows.shape[1])) for lo in range(0, rows.shape[1], step)]

    def _forward(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log of the summed weight of all segmentations of each row's first bytes, by their number."""
        n = rows.shape[1] + 1
        alpha = np.full(len(rows) * n, -np.inf)
        alpha[::n] = 0
        for lo, hi in self._blocks(rows):
            row, start, end, piece = self.edges(rows, lengths, lo, hi)
            _spread(alpha, row * n + start, row * n + end, self.scores[piece], start, lo, hi, len(rows))
        return alpha.reshape(len(rows), n)

    def marginal(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log of the summed weight of all segmentations of each row, by forward recursion in log space."""
        return self._forward(rows, lengths)[np.arange(len(rows)), lengths]

    def expected(self, rows: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations, rows weighted; the last entry is of unknown characters."""
        n = rows.shape[1] + 1
        alpha = self._forward(rows, lengths)
        total = alpha[np.arange(len(rows)), lengths]
        alpha = alpha.reshape(-1)
        beta = np.full(len(rows) * n, -np.inf)
        beta[np.arange(len(rows)) * n + lengths] = 0
        counts = np.zeros(len(self.scores))
        for lo, hi in reversed(self._blocks(rows)):
            row, start, end, piece = self.edges(rows, lengths, lo, hi)
            own = self.scores[piece]
            back = np.argsort(-end, kind="stable")
            # the furthest ends first: what lies beyond an end is summed before it is used
            _spread(beta, (row * n + end)[back], (row * n + start)[back], own[back], -end[back], -(hi + self.trie.depth), 1 - lo, len(rows))
            with np.errstate(invalid="ignore"):
                share = np.exp(alpha[row * n + start] + own + beta[row * n + end] - total[row])
            counts += np.bincount(piece % len(counts), weights=np.nan_to_num(share) * weights[row], minlength=len(counts))
        return counts

    def best(self, rows: np.ndarray, lengths: np.ndarray):
        """Viterbi: the score of each row's best segmentation, and its steps (row, begin, end, piece) in order.

        Of equal scores, the step that starts first (the longest last piece) wins. A row that
        is no UTF-8 becomes its bytes.
        """
        n = rows.shape[1] + 1
        score = np.full(len(rows) * n, -np.inf)
        score[::n] = 0
        from_, piece_of = np.full(len(score), -1, np.int64), np.full(len(score), -1, np.int32)
        for lo, hi in self._blocks(rows):
            row, start, end, piece = self.edges(rows, lengths, lo, hi)
            source, target, own = row * n + start, row * n + end, self.scores[piece]
            if len(rows) < FEW_ROWS:
                values = dict(zip(source.tolist(), score[source].tolist(), strict=True)) | dict(zip(target.tolist(), score[target].tolist(), strict=True))
                won: dict[int, tuple[int, int]] = {}
                for s, t, p, w in zip(source.tolist(), target.tolist(), piece.tolist(), own.tolist(), strict=True):
                    if values[s] + w > values[t]:
                        values[t] = values[s] + w
                        won[t] = s, p
                to = np.fromiter(won, np.int64, len(won))
                score[to] = [values[t] for t in won]
                from_[to], piece_of[to] = np.array(list(won.values()), np.int64).reshape(-1, 2).T
                continue
            bounds = np.searchsorted(start, np.arange(lo, hi + 1)).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a < b:
                    new = score[source[a:b]] + own[a:b]
                    better = new > score[target[a:b]]
                    to = target[a:b][better]
                    score[to], from_[to], piece_of[to] = new[better], source[a:b][better], piece[a:b][better]
        first = np.arange(len(rows)) * n
        at = first + lengths
        total = score[at]
        broken = np.flatnonzero(np.isneginf(total))
        total[broken] = lengths[broken] * self.unknown
        size = lengths[broken]
        byte = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        done = [(np.repeat(broken, size), byte, byte + 1, np.full(len(byte), -1))]
        row = np.flatnonzero((lengths > 0) & ~np.isneginf(score[at]))
        at = at[row]
        while len(row) >= FEW_ROWS:
            done.append((row, from_[at] - first[row], at - first[row], piece_of[at]))
            at = from_[at]
            more = at > first[row]
            row, at = row[more], at[more]
        for r, t in zip(row.tolist(), at.tolist(), strict=True):
            steps, begin = [], int(first[r])
            while t > begin:
                s = int(from_[t])
                steps.append((s, t, int(piece_of[t])))
                t = s
            if steps:
                s, t, p = np.array(steps, np.int64).T
                done.append((np.full(len(steps), r), s - begin, t - begin, p))
        row, begin, end, piece = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((begin, row))
        return total, row[order], begin[order], end[order], piece[order]


def _spread(value: np.ndarray, source: np.ndarray, target: np.ndarray, own: np.ndarray, column: np.ndarray, lo: int, hi: int, rows: int) -> None:
    """Adds, in log space, value[source] + own to value[target], edge after edge, or a column (ascending in lo..hi-1) at once."""
    if rows < FEW_ROWS:
        values = dict(zip(target.tolist(), value[target].tolist(), strict=True)) | dict(zip(source.tolist(), value[source].tolist(), strict=True))
        none, log1p, exp = -math.inf, math.log1p, math.exp
        for s, t, w in zip(source.tolist(), target.tolist(), own.tolist(), strict=True):
            a, b = values[s] + w, values[t]
            if a < b:
                a, b = b, a
            values[t] = a + log1p(exp(b - a)) if a > none else none
        value[np.fromiter(values, np.int64, len(values))] = list(values.values())
        return
    bounds = np.searchsorted(column, np.arange(lo, hi + 1)).tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a < b:
            to = target[a:b]
            value[to] = np.logaddexp(value[to], value[source[a:b]] + own[a:b])


def led_by_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A buffer and its offsets with a space before each row that is not empty."""
    sizes = np.diff(offsets)
    full = sizes > 0
    led = np.concatenate([[0], np.cumsum(sizes + full)])
    body = np.full(led[-1], 32, np.uint8)
    body[np.arange(len(data)) + np.repeat(np.cumsum(full), sizes)] = data
    return body, led


def by_length(cells: np.ndarray, start: np.ndarray, lengths: np.ndarray, most_cells: int = 1 << 18):
    """The spans of a buffer as byte matrices of similar lengths: (indices, rows, lengths)."""
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    at = 0
    while at < len(order):
        width = max(int(ranked[at]), 1)
        limit = width + max(2, width // 8)
        end = min(int(np.searchsorted(ranked, limit, "right")), at + max(1, most_cells // limit))
        own = order[at:end]
        size = lengths[own]
        column = np.arange(max(int(size.max()), 1))
        where = np.minimum(start[own][:, None] + column, max(len(cells) - 1, 0))
        rows = np.where(column < size[:, None], cells[where], 0).astype(np.uint8) if len(cells) else np.zeros(where.shape, np.uint8)
        yield own, rows, size
        at = end
