"""Op 6: encoding into pieces of an existing vocabulary by Viterbi, and decoding.

The text gets a leading space, spaces become the mark, and the best-scoring segmentation
into pieces is found over a double-array trie. A character without a piece becomes the
pieces of its bytes. Decoding joins pieces and bytes, turns marks into spaces and drops
the leading one, so that decode(encode(text)) is the text, byte for byte. The mark's own
character in a text is no space: it becomes its bytes.

No piece has the mark behind another character, so the best segmentation of a text is
that of its segments, each a run of spaces and the characters up to the next space; a
character that no piece holds (such as a line end) is a segment of its own. Segments
recur: those of a batch are hashed and sorted at once, each distinct one is solved once, and
a task keeps results up to KEPT_SEGMENTS segments and KEPT_PIECES pieces in all. Two segments
of one 64-bit hash (a chance of 1e-9 a task) would show as a text that does not decode to itself.

The vocabulary at hand has ranks as scores; trie.log_weights reads them as log probabilities.

Defined results: null and empty texts have no pieces and decode to the empty text;
everything else passes through row by row, repeated rows and null ids included; columns
named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, trie

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
KEPT_SEGMENTS, KEPT_PIECES = 400_000, 4_000_000
UNKNOWN_PENALTY = 10.0  # below the lowest score


def gathered(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[first[i] : first[i] + count[i]] for each i, one after another."""
    before = np.cumsum(count) - count
    return flat[np.repeat(first - before, count) + np.arange(int(count.sum()))]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    return np.diff(np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])[offsets])


class Encoder:
    def __init__(self, vocabulary: str):
        self.v = v = trie.load_vocabulary(vocabulary)
        scores = trie.log_weights(v)
        self.unknown = scores.min() - UNKNOWN_PENALTY
        self.lattice = trie.Lattice(v, scores, self.unknown)
        held = set("".join(v.pieces[i] for i in v.normal))
        self.kind = np.full(256, 2, np.uint8)  # 0 space, 1 a segment of its own, 2 other
        self.kind[[i for i in range(128) if chr(i) not in held]] = 1
        self.kind[32] = 0
        # the bytes of all pieces, one after another
        raw = [p.replace(trie.MARK, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("hashes", "place", "ids", "first", "count", "score", "byte_pieces")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        """Empties the store of solved segments: hashes in order, their places, and by place ids and sums."""
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.byte_pieces = np.zeros(0), np.zeros(0, np.int64)

    def solve(self, cells: np.ndarray, start: np.ndarray, sizes: np.ndarray):
        """ids of all spans, one after another; number of ids, score and number of byte pieces of each."""
        parts, score = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))], np.zeros(len(start))
        for own, rows, lengths in trie.by_length(cells, start, sizes):
            score[own], row, begin, end, piece = self.lattice.best(rows, lengths)
            bare = piece < 0
            many = np.where(bare, end - begin, 1)
            ids, from_bytes = np.repeat(piece, many), np.repeat(bare, many)
            ids[from_bytes] = self.v.byte_ids[gathered(rows.reshape(-1), (row * rows.shape[1] + begin)[bare], many[bare])]
            parts.append((own[np.repeat(row, many)], ids, from_bytes))
        which, ids, from_bytes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(which, kind="stable")
        count = np.bincount(which, minlength=len(start))
        return ids[order].astype(np.int32), count, score, np.bincount(which, weights=from_bytes, minlength=len(start)).astype(np.int64)

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the segments of rows start; rows are led by a space."""
        kind = self.kind[data]
        before = np.full(len(data), 1, np.uint8)
        before[1:] = kind[:-1]
        begins = (kind == 1) | ((kind == 0) & (before != 0)) | ((kind == 2) & (before == 1))
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(begins)

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """ids of all rows, one after another; number of ids, score, number of byte pieces, and whether decoding gives the row back."""
        full = np.diff(offsets) > 0
        body, led = trie.led_by_space(data, offsets)
        start = self.segments(body, led)
        end = np.append(start[1:], len(body))[: len(start)]
        distinct, where, of = np.unique(common.span_hash(common.prefix_hash(body), start, end), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KEPT_SEGMENTS or len(self.ids) > KEPT_PIECES:
            self._forget()
        slots = np.full(len(distinct), -1)
        at = np.searchsorted(self.hashes, distinct)
        if len(self.hashes):
            held = self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct
            slots[held] = self.place[at[held]]
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            ids, count, score, byte_pieces = self.solve(body, start[where[fresh]], (end - start)[where[fresh]])
            slots[fresh] = len(self.first) + np.arange(len(fresh))
            self.hashes, self.place = np.insert(self.hashes, at[fresh], distinct[fresh]), np.insert(self.place, at[fresh], slots[fresh])
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
            self.score, self.byte_pieces = np.concatenate([self.score, score]), np.concatenate([self.byte_pieces, byte_pieces])
        slot = slots[of]
        ids = gathered(self.ids, self.first[slot], self.count[slot])
        row_of = np.searchsorted(start, led)  # each row's first segment
        count = _sums(self.count[slot], row_of)
        score, byte_pieces = np.zeros(len(full)), _sums(self.byte_pieces[slot], row_of)
        if len(start):
            score[full] = np.add.reduceat(self.score[slot], row_of[:-1][full])
        exact = self._decodes(ids, count, body, led)
        if exact.all():
            return ids, count, score, byte_pieces, exact
        # two unlike segments of one hash: all segments are solved by themselves
        ids, each, scores, bare = self.solve(body, start, end - start)
        self._forget()
        count, byte_pieces = _sums(each, row_of), _sums(bare, row_of)
        score[full] = np.add.reduceat(scores, row_of[:-1][full])
        return ids, count, score, byte_pieces, self._decodes(ids, count, body, led)

    def _decodes(self, ids: np.ndarray, count: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the ids of each row are its bytes."""
        back = gathered(self.raw, self.raw_first[ids], self.raw_size[ids])
        if len(back) == len(body) and np.array_equal(back, body):
            return np.ones(len(count), bool)
        sizes = _sums(self.raw_size[ids], np.concatenate([[0], np.cumsum(count)]))
        at = np.cumsum(sizes) - sizes
        return np.array([n == b - a and np.array_equal(back[i : i + n], body[a:b]) for i, n, a, b in zip(at, sizes, offsets[:-1], offsets[1:], strict=True)], bool)

    def encode_texts(self, texts: list[str | None]) -> list[tuple[list[int], float, int]]:
        """ids, score and number of byte pieces of each text."""
        ids, count, score, byte_pieces, _ = self.encode(*common.utf8_buffer(pa.array(texts, pa.string())))
        cut = np.split(ids, np.cumsum(count)[:-1])
        return [(i.tolist(), float(s), int(b)) for i, s, b in zip(cut, score, byte_pieces, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        ids = np.asarray(ids, np.int64)
        return gathered(self.raw, self.raw_first[ids], self.raw_size[ids]).tobytes().decode("utf-8", "replace")[1:]


def _encode(encoder):
    def encode(batches):
        for batch in common.slices(batches, "text"):
            ids, count, score, byte_pieces, exact = encoder.value.encode(*common.utf8_buffer(batch.column("text")))
            names = batch.schema.names
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), lists, pa.array(score, pa.float64()), pa.array(byte_pieces, pa.int64()), pa.array(exact, pa.bool_())],
                names=[*names, "piece_ids", "piece_score", "n_byte_pieces", "round_trip"],
            )

    return encode


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with piece_ids, piece_score, n_byte_pieces, and whether decoding gives the text back."""
    docs = docs.drop("piece_ids", "piece_score", "n_byte_pieces", "round_trip")
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder(vocabulary))  # the size of the vocabulary
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_encode(encoder), f"{fields}, piece_ids array<int>, piece_score double, n_byte_pieces long, round_trip boolean")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return encoded(docs).select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "n_byte_pieces", "piece_score",
        F.sha2(F.array_join("piece_ids", ","), 256).alias("ids_sha256"), "round_trip",
    )
