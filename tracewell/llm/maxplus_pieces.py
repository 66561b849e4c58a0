"""SentencePiece encoding and decoding by a max-plus scan (operator 4).

A sequence of pieces is what byte-pair merging makes of a text exactly if each two neighbours are
what it makes of their own concatenation. So the encoding is the one path of finite weight through a
lattice: an edge from a piece to a following one weighs -1 if the two may be neighbours, else minus
infinity. Ordinary texts fall into words that no piece crosses and are looked up word by word.

Giant texts are cut into chunks at fixed offsets. The state at a boundary is the piece that ends at
or crosses it. Each chunk yields the matrix of path weights from the states at its start to those at
its end; max-plus products over the chunks fix the state at every boundary, and then each chunk is
traced back by itself.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import batch_of, struct_of, written

CHUNK = 1 << 16
MEMO_ENTRIES = 400_000
PAIR_ENTRIES = 300_000
MEMO_CHARS = 64
SPACE = "▁"
START = ""
NEVER = -np.inf
PIECES_SQL = "n_pieces long, ids_sha256 string, round_trip boolean"


class Pieces(dict):
    """Maps a word to the ids of its pieces (four bytes each); missing ones are encoded and remembered."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rule = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or rule.precompiled_charsmap or rule.remove_extra_whitespaces \
                or not rule.escape_whitespaces or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError(f"{path} is not a plain byte-pair model with byte fallback")
        self.prefix = SPACE if rule.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.ids = {p.piece: k.to_bytes(4, "little") for k, p in enumerate(model.pieces) if p.type == 1}
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        self.plain = {k: p.piece.replace(SPACE, " ").encode() for k, p in enumerate(model.pieces) if p.type == 1}
        self.plain |= {k: bytes([b]) for b, k in self.byte_ids.items()}
        self.longest = max(map(len, self.score))
        self.valid = {p for p in self.score if len(p) == 1 or self.merged(p) == [p]}
        self.begins = {p[:k] for p in self.valid for k in range(1, len(p) + 1)}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.score)
        # Line ends and marks after a letter or digit that no piece holds part words as well.
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.score))
        marks = "".join(c for c in string.punctuation if c != "_" and not any(a.isalnum() and b == c for p in self.score for a, b in zip(p, p[1:])))
        lines, marks = re.escape(alone), f"[{re.escape(marks)}]" if marks else "(?!)"
        stop = f" |[{lines}]" if alone else " "
        # Words are looked up with plain spaces, which keeps most of them in one byte per character.
        self.words = re.compile("(?s:.+)" if crossing else rf" *[^\W_]++(?={stop}|{marks}|\Z)| *[^ {lines}]+?(?={stop}|\Z|(?<=[^\W_]){marks})| +"
                                + (f"|[{lines}]" if alone else ""))
        self.cut = None if crossing else re.compile(f"(?<=[^{SPACE}]){SPACE}" + (f"|[{lines}]" if alone else ""))

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: best score first, the leftmost of equals."""
        own = list(text)
        while len(own) > 1:
            best, at = None, -1
            for k in range(len(own) - 1):
                score = self.score.get(own[k] + own[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            own[at:at + 2] = [own[at] + own[at + 1]]
        return own

    def neighbours(self, left: str, right: str) -> bool:
        """Whether a text may have these two one after the other; False for what is no piece at all."""
        known = self.pairs[left].get(right) if left in self.pairs else None
        if known is None:
            if self.n_pairs >= PAIR_ENTRIES:
                self.pairs.clear()
                self.n_pairs = 0
            self.n_pairs += 1
            known = (len(right) == 1 or right in self.valid) and (left == START or self.merged(left + right) == [left, right])
            self.pairs.setdefault(left, {})[right] = known
        return known

    def forward(self, text: str, start: int, state: str, stop: int) -> list[str | None]:
        """From a place with a given last piece: for this and every place up to ``stop`` the last piece
        of its only valid path, or None."""
        last: list[str | None] = [None] * (stop - start + 1)
        last[0] = state
        begins, pairs, none = self.begins, self.pairs, {}
        for place in range(start, stop):
            before = last[place - start]
            if before is None:
                continue
            after = pairs.get(before, none).get
            for end in range(place + 1, stop + 1):
                piece = text[place:end]
                if end > place + 1 and piece not in begins:
                    break
                if last[end - start] is None:
                    known = after(piece)
                    if known or known is None and self.neighbours(before, piece):
                        last[end - start] = piece
        return last

    @staticmethod
    def back(last: list[str | None], place: int) -> list[str]:
        """The pieces of the path to the place with this number."""
        pieces = []
        while place > 0:
            pieces.append(last[place])
            place -= len(last[place])
        return pieces[::-1]

    def coded(self, pieces: list[str]) -> bytes:
        try:
            return b"".join([self.ids[piece] for piece in pieces])
        except KeyError:  # characters that no piece has are written as bytes
            return b"".join(self.ids[piece] if piece in self.ids else np.array([self.byte_ids[b] for b in piece.encode()], "<i4").tobytes() for piece in pieces)

    def __missing__(self, word: str) -> bytes:
        coded = self.older.get(word)
        if coded is None:
            own = word.replace(" ", SPACE)
            coded = self.coded(self.back(self.forward(own, 0, START, len(own)), len(own)))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[word] = coded
        return coded

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, four little-endian bytes each."""
        return self.by_words(self.normal(text))

    def by_words(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words.findall(text.replace(SPACE, " "))))

    def pieces_in(self, text: str) -> int:
        """Number of pieces, where the bytes of one unknown character count as one piece of the lattice."""
        coded = np.frombuffer(self.by_words(text), "<i4")
        lead = [k for b, k in self.byte_ids.items() if 0x80 <= b < 0xC0]
        return len(coded) - int(np.isin(coded, lead).sum())

    def joined(self, ids: bytes) -> bytes:
        return b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<i4").tolist()))

    def decode(self, ids: bytes) -> str:
        text = self.joined(ids).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    # chunks: ``text`` is the chunk with up to ``longest`` characters of its neighbours on either side

    def states(self, text: str, place: int) -> list[tuple[int, int]]:
        """Pieces (start, end) that end at or cross a boundary; the same seen from both sides."""
        if place == 0:
            return [(0, 0)]
        found = []
        for start in range(max(0, place - self.longest), place):
            for end in range(place, min(len(text), start + self.longest) + 1):
                if end - start == 1 or text[start:end] in self.valid:
                    found.append((start, end))
        return found

    def _middle(self, text: str, start: int, stop: int) -> tuple[int, int] | None:
        """First and last cut well inside a chunk."""
        if self.cut is None or stop - start < 4 * self.longest:
            return None
        first = self.cut.search(text, start + self.longest, stop - self.longest)
        tail = [m.start() for m in self.cut.finditer(text, max(start + self.longest, stop - 64 * self.longest), stop - self.longest)]
        return (first.start(), tail[-1]) if first and tail and tail[-1] > first.start() else None

    def transfer(self, text: str, start: int, stop: int) -> np.ndarray:
        """Weights of the best paths from the states at the start of a chunk to those at its end."""
        here, there = self.states(text, start), self.states(text, stop)
        middle = self._middle(text, start, stop)
        matrix = np.full((len(here), len(there)), NEVER)
        tails = None
        if middle:
            inner = self.pieces_in(text[middle[0]:middle[1]])
            tails = self._ends(text, middle[1], START, there, middle[1])
        for row, (a, b) in enumerate(here):
            state = text[a:b] if b > a else START
            if middle:
                head = self.forward(text, b, state, middle[0])
                if head[-1] is not None:
                    matrix[row] = tails - inner - len(self.back(head, len(head) - 1))
            else:
                matrix[row] = self._ends(text, b, state, there, b)
        return matrix

    def _ends(self, text: str, start: int, state: str, there: list[tuple[int, int]], least: int) -> np.ndarray:
        stop = max((a for a, _ in there), default=start)
        last = self.forward(text, start, state, max(stop, start))
        weights = np.full(len(there), NEVER)
        for k, (a, b) in enumerate(there):
            if a >= least and last[a - start] is not None and self.neighbours(last[a - start], text[a:b]):
                weights[k] = -1.0 - len(self.back(last, a - start))
        return weights

    def traced(self, text: str, start: int, stop: int, entry: int, leave: int) -> tuple[bytes, bool]:
        """Ids of the pieces that start in a chunk, between the known states, and whether they decode to its text."""
        a, b = self.states(text, start)[entry]
        c, d = self.states(text, stop)[leave]
        state = text[a:b] if b > a else START
        middle = self._middle(text, start, stop)
        if middle:
            head, tail = self.forward(text, b, state, middle[0]), self.forward(text, middle[1], START, c)
            ids = self.coded(self.back(head, len(head) - 1)) + self.by_words(text[middle[0]:middle[1]]) \
                + self.coded([*self.back(tail, len(tail) - 1), text[c:d]])
        else:
            ids = self.coded([*self.back(self.forward(text, b, state, c), c - b), text[c:d]])
        return ids, self.joined(ids) == text[b:d].replace(SPACE, " ").encode()


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1, initial=NEVER)


def boundary_states(matrices: list[np.ndarray]) -> tuple[list[int], float]:
    """The state at each boundary on the best path over all chunks, and its weight.

    Products of neighbouring pairs are formed level by level; the states found for a pair's ends fix
    the state between its halves.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([times(own[k], own[k + 1]) if k + 1 < len(own) else own[k] for k in range(0, len(own), 2)])
    top = levels[-1][0]
    edges = list(np.unravel_index(int(np.argmax(top)), top.shape))
    for own in reversed(levels[:-1]):
        finer = [edges[0]]
        for k in range(0, len(own), 2):
            if k + 1 < len(own):
                finer.append(int(np.argmax(own[k][finer[-1]] + own[k + 1][:, edges[k // 2 + 1]])))
            finer.append(edges[k // 2 + 1])
        edges = finer
    return [int(e) for e in edges], float(top.max())


def _chunks(path: str, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = pieces.normal(text.as_py())
                edges = [*range(0, max(1, len(whole) - size // 2), size), len(whole)]
                for k, (start, stop) in enumerate(zip(edges, edges[1:])):
                    low = max(0, start - pieces.longest)
                    yield batch_of({"row": (pa.int64(), [row]), "k": (pa.int64(), [k]), "at": (pa.int64(), [start - low]), "stop": (pa.int64(), [stop - low]),
                                    "part": (pa.string(), [whole[low:stop + pieces.longest]])})
    return cut


def _encoded_giants(giants: DataFrame, row: str, text_col: str, path: str, size: int) -> DataFrame:
    """Rows (row, n_pieces, ids_sha256, round_trip, ids) of texts longer than a chunk."""
    matrix_sql = "row long, k long, height long, weights array<double>"

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            rows = [pieces.transfer(part, at, stop) for at, stop, part in zip(*(batch.column(c).to_pylist() for c in ("at", "stop", "part")))]
            yield batch_of({"row": (pa.int64(), batch.column("row")), "k": (pa.int64(), batch.column("k")), "height": (pa.int64(), [len(m) for m in rows]),
                            "weights": (pa.list_(pa.float64()), [m.ravel().tolist() for m in rows])})

    def scanned(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        states, _ = boundary_states([np.array(w).reshape(h, -1) for h, w in zip(group.column("height").to_pylist(), group.column("weights").to_pylist())])
        return pa.table({"row": group.column("row"), "k": group.column("k"), "entry": pa.array(states[:-1], pa.int64()), "leave": pa.array(states[1:], pa.int64())})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            found = [pieces.traced(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "stop", "entry", "leave")))]
            yield batch_of({"row": (pa.int64(), batch.column("row")), "k": (pa.int64(), batch.column("k")),
                            "ids": (pa.binary(), [x for x, _ in found]), "good": (pa.bool_(), [g for _, g in found])})

    def assembled(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        ids = b"".join(group.column("ids").to_pylist())
        return pa.table({"row": group.column("row").slice(0, 1), "n_pieces": pa.array([len(ids) // 4], pa.int64()),
                         "ids_sha256": [hashlib.sha256(ids).hexdigest()], "round_trip": [all(group.column("good").to_pylist())],
                         "ids": pa.array([np.frombuffer(ids, "<i4")], pa.list_(pa.int32()))})

    chunks = giants.select(F.col(row).alias("row"), F.col(text_col)).mapInArrow(_chunks(path, size), "row long, k long, at long, stop long, part string").repartition("row", "k")
    states = chunks.mapInArrow(transfers, matrix_sql).groupBy("row").applyInArrow(scanned, "row long, k long, entry long, leave long")
    traces = chunks.join(states, ["row", "k"]).mapInArrow(traced, "row long, k long, ids binary, good boolean")
    return traces.groupBy("row").applyInArrow(assembled, f"row long, {PIECES_SQL}, ids array<int>")


def _whole(path: str, with_ids: bool):
    @F.arrow_udf(PIECES_SQL + (", ids array<int>" if with_ids else ""))
    def encoded(column: pa.Array) -> pa.Array:
        pieces = load(path)
        texts = [t or "" for t in column.to_pylist()]
        coded = [pieces.encode(t) for t in texts]
        fields = {"n_pieces": (pa.int64(), [len(c) // 4 for c in coded]), "ids_sha256": (pa.string(), [hashlib.sha256(c).hexdigest() for c in coded]),
                  "round_trip": (pa.bool_(), [pieces.decode(c) == t for c, t in zip(coded, texts)])}
        if with_ids:
            fields["ids"] = (pa.list_(pa.int32()), [np.frombuffer(c, "<i4") for c in coded])
        return struct_of(fields)

    return encoded


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "pieces", with_ids: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The documents with a struct (n_pieces, ids_sha256, round_trip, ids) in ``out_col``.

    NULL and empty texts have no pieces and count as decoded rightly; a text that holds the space
    mark itself decodes to spaces and says so in ``round_trip``. Other columns and repeated rows
    stay; a column already named ``out_col`` is replaced. ``path`` is the model file, present on
    every worker. The digest is over four little-endian bytes per id.
    """
    text = F.col(text_col)
    held = docs.drop(out_col)
    giant = F.coalesce(F.length(text) > chunk, F.lit(False))
    plain = held.where(~giant).withColumn(out_col, _whole(path, with_ids)(text))
    row = "giant row number"
    giants = written(held.where(giant).withColumn(row, F.monotonically_increasing_id()), "giants")
    fields = [F.col(c) for c in ("n_pieces", "ids_sha256", "round_trip")] + [F.col("ids")] * with_ids
    found = _encoded_giants(giants, row, text_col, path, chunk).select(F.col("row").alias(row), F.struct(*fields).alias(out_col))
    return plain.unionByName(giants.join(found, row).drop(row))


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of ids; NULL stays NULL."""
    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        pieces = load(path)
        return pa.array([None if own is None else pieces.decode(np.array(own, "<i4").tobytes()) for own in column.to_pylist()], pa.string())

    return texts(ids)


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of pieces, digest of their ids and whether decoding gives the text back."""
    found = encode(docs.select("doc_id", "text"), path, with_ids=False)
    return found.select("doc_id", "pieces.n_pieces", "pieces.ids_sha256", "pieces.round_trip")
