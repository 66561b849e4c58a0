"""Language-model scores of texts from causal self-attention trained in numpy (operator 2).

Subword ids are predicted in steps: attention over the ids before gives the group of the next id's
class and the class within its group, and the corpus gives the id within its class. Windows of 32 ids
overlap by half; each scores the second half, so that every id is scored once and sees at least 16 ids
before it. Word counts, id counts, the base score and the weights cover all training documents. The
weights are fitted in rounds over parts of the documents: in a round every task goes on from the same
weights by itself, and the weights of all tasks are averaged by their numbers of windows. So the score
depends a little on how the input is split into tasks; the base score and the counts do not.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import LOWER, batch_of, raw, remainder, written

HALF = 16
WIDTH = 16
GROUPS = 14
GROUP_CLASSES = 14
CLASSES = GROUPS * GROUP_CLASSES
PLACES = 16
INPUTS = 2048
FREQUENT = 200_000
HELD_WORDS = 1 << 19
CHUNK_WINDOWS = 128
HEAD_WINDOWS = 512
GROUP_WORDS = 1 << 14
RUN_IDS = 384
KEPT_BYTES = 4 << 20
#: The word that stands for the end of a text; no text has it, as it holds white space.
END = " "
#: Lower-cases A-Z and makes every white space a blank.
SPACED = LOWER.translate(bytes.maketrans(b"\t\n\v\f\r", b"     "))
# Fixed value: the public pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Settings:
    """``share``: one in so many runs of ``RUN_IDS`` ids is fitted, 1 for all; ``rounds``: parts of the
    documents, after each of which the tasks' weights are averaged; ``steps``: a task with fewer in all
    takes its last runs again; ``frequent``: most words sent to every task."""

    share: int = 1
    rounds: int = 3
    steps: int = 100
    rate: float = 0.01
    batch: int = 128
    frequent: int = FREQUENT


def keep_freed_memory() -> None:
    """Lets a task's process keep the memory it frees for the next arrays.

    Otherwise arrays of some 100 KB go back to the system and cost a page fault every 4 KB when they
    come again; once a larger block was freed, the C library keeps all smaller ones.
    """
    np.empty(KEPT_BYTES, np.uint8)


@lru_cache(maxsize=2)
def subwords(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("subwords", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def n_ids(path: str) -> int:
    """Ids of the vocabulary and one more for the end."""
    return subwords(path).n_vocab + 1


def words_in(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def ids_of(words: list[bytes], path: str) -> np.ndarray:
    coder = subwords(path)
    own = coder.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")) if words else []
    return np.array([*own, coder.n_vocab], np.int64)


@lru_cache(maxsize=2)
def openers(path: str) -> np.ndarray:
    """Which ids begin with a blank; of a word's ids only the first does, by the blank before the word."""
    coder = subwords(path)
    return np.array([coder.decode_single_token_bytes(k)[:1] == b" " for k in range(coder.n_vocab)])


def spelled_ids(words: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words with one blank between them, and where those of each word begin."""
    own = np.array(subwords(path).encode_ordinary(" " + words) if words else [], np.int32)
    return own, np.flatnonzero(openers(path)[own])


# word and id counts

def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a column of texts, the place of every word among them, and where each text's words begin, with the end of the last.

    Only distinct words are handled one by one afterwards.
    """
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, held = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held[edges[0]:edges[-1]].to_pybytes().translate(SPACED) if held else b"", np.uint8)
    edges = edges - edges[0]
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # A text begins a word also where the one before ends in one.
    opens = edges[:-1][edges[:-1] < edges[1:]]
    first[opens] = inside[opens]
    begin = np.searchsorted(np.flatnonzero(first), edges)
    bounds = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside))
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), begin


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def given(words: pa.Table) -> Iterator[pa.RecordBatch]:
        return words.set_column(0, "word", words.column("word").cast(pa.string())).to_batches()

    for batch in batches:
        distinct, codes, _ = split_words(batch.column(0))
        held.append(pa.table({"word": pa.concat_arrays([distinct, pa.array([END.encode()], distinct.type)]),
                              "n": np.append(np.bincount(codes, minlength=len(distinct)), batch.num_rows)}))
        size += len(distinct) + 1
        if size > HELD_WORDS:
            held = [summed()]
            size = held[0].num_rows
            if size > HELD_WORDS // 2:
                yield from given(held[0])
                held, size = [], 0
    if held:
        yield from given(summed())


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, n) over a single text column; counted per task before the shuffle."""
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(words: DataFrame, path: str) -> np.ndarray:
    """How often each id occurs in the counted words; at most one number per id of the vocabulary comes to the driver."""
    size = n_ids(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_numpy(zero_copy_only=False).tolist(), batch.column(1).to_numpy()
            end = words.index(END) if END in words else None
            if end is not None:
                total[-1] += n[end]
                words, n = words[:end] + words[end + 1:], np.delete(n, end)
            own, first = spelled_ids(" ".join(words), path)
            np.add.at(total, own, n.repeat(np.diff(np.append(first, len(own)))))
        own = np.flatnonzero(total)
        yield batch_of({"id": (pa.int64(), own), "n": (pa.int64(), total[own])})

    found = words.select("word", "n").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return total


@dataclass
class Classes:
    """For each id the number of its input vector and of its class, and log10 of its part of the class."""

    inputs: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    prior: np.ndarray


def classes_of(count: np.ndarray, classes: int = CLASSES, inputs: int = INPUTS, pooled: int = 16) -> Classes:
    """The most frequent ids have a class and an input vector of their own; the others share by frequency."""
    order = np.argsort(-count, kind="stable")

    def shared(own: int) -> np.ndarray:
        number = np.empty(len(count), np.int64)
        number[order[:own]] = np.arange(own)
        mass = np.cumsum(count[order[own:]] + 1.0)
        number[order[own:]] = own + np.minimum((pooled * mass / mass[-1]).astype(np.int64), pooled - 1) if len(mass) else own
        return number

    own = shared(classes - pooled)
    weight = count + 1.0
    total = np.bincount(own, weight, classes)
    return Classes(shared(inputs - pooled), own, np.log10(weight / total[own]), np.log(np.maximum(total, 1.0) / total.sum()).astype(np.float32))


# the model

Weights = dict[str, np.ndarray]
CAUSAL = np.where(np.arange(2 * HALF)[None, :] <= np.arange(HALF)[:, None] + HALF - 1, 0, -1e9).astype(np.float32)
#: Before a text only the last place of the half-window, the start mark, can be seen.
OPENING = np.where(np.arange(2 * HALF) < HALF - 1, -1e9, 0).astype(np.float32)


def start_weights(prior: np.ndarray, inputs: int = INPUTS, seed: int = 7) -> Weights:
    """Small random weights; the biases start at the corpus' rates of groups and classes. The last input is the start mark."""
    rng = np.random.default_rng(seed)
    normal = lambda *size: (rng.standard_normal(size) * 0.3 / np.sqrt(size[-2] if size[-2] <= 64 else 1)).astype(np.float32)
    own = prior.reshape(GROUPS, GROUP_CLASSES)
    group = np.log(np.exp(own).sum(axis=1))
    return {"E": normal(inputs + 1, WIDTH), "P": normal(2 * HALF, WIDTH), "Q": normal(WIDTH, WIDTH), "K": normal(WIDTH, WIDTH), "V": normal(WIDTH, WIDTH),
            "O": normal(WIDTH, WIDTH), "G": normal(WIDTH, GROUPS), "g": group.copy(), "U": normal(GROUPS, WIDTH, GROUP_CLASSES), "b": own - group[:, None]}


def _powers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and, as a column, their sums along the last axis.

    The rows' largest values are taken off, in ``x`` too, only where an exponential would leave its range.
    """
    ones = np.ones(x.shape[-1], x.dtype)
    with np.errstate(over="ignore"):
        held = np.exp(x)
        total = held.reshape(-1, len(ones)) @ ones
    if not (total.min() > 1e-12 and total.max() < 1e20):
        x -= x.max(axis=-1, keepdims=True)
        held = np.exp(x)
        total = held.reshape(-1, len(ones)) @ ones
    return held, total[:, None]


def heads_of(w: Weights) -> np.ndarray:
    """For each group the weights of the groups and of its classes side by side, the biases as last row.

    Either is filled up to ``PLACES`` columns, whose bias leaves them no probability: products are faster at that width.
    """
    heads = np.zeros((GROUPS, WIDTH + 1, 2 * PLACES), w["G"].dtype)
    heads[:, -1] = -1e9
    heads[:, :-1, :GROUPS], heads[:, -1, :GROUPS] = w["G"], w["g"]
    heads[:, :-1, PLACES:PLACES + GROUP_CLASSES], heads[:, -1, PLACES:PLACES + GROUP_CLASSES] = w["U"], w["b"]
    return heads


def by_group(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of rows by their class' group, and the groups present with their first row and the one after the last."""
    group = (target // GROUP_CLASSES).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def by_batch_and_group(target: np.ndarray, batch: int) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """The same for every ``batch`` rows, sorted all at once."""
    if not len(target):
        return []
    number = np.arange(len(target)) // batch * GROUPS + target // GROUP_CLASSES
    number = number.astype(np.min_scalar_type(number[-1] + GROUPS))
    order = np.argsort(number, kind="stable") % batch
    ends = np.bincount(number, minlength=-(-len(target) // batch) * GROUPS).reshape(-1, GROUPS).cumsum(axis=1)
    return [(order[k * batch:(k + 1) * batch], [(j, a, b) for j, (a, b) in enumerate(zip([0, *own], own)) if a < b]) for k, own in enumerate(ends.tolist())]


def headed(hidden: np.ndarray, heads: np.ndarray, target: np.ndarray, present: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the groups and of the own group's classes of rows in the order of their groups, and the flat places of the right ones."""
    z = np.empty((len(hidden), heads.shape[2]), hidden.dtype)
    for k, a, b in present:
        np.matmul(hidden[a:b], heads[k], out=z[a:b])
    group = target // GROUP_CLASSES
    right = np.empty((len(z), 2), np.int64)
    right[:, 0] = np.arange(0, z.size, z.shape[1]) + group
    right[:, 1] = right[:, 0] + (PLACES + target - group * (GROUP_CLASSES + 1))
    return z, right


def loss_and_gradient(w: Weights, inputs: np.ndarray, target: np.ndarray, weight: np.ndarray, opening: np.ndarray, want_loss: bool = True,
                      follows: np.ndarray | None = None, groups: tuple[np.ndarray, list[tuple[int, int, int]]] | None = None) -> tuple[float, Weights]:
    """Mean cross entropy of the targets of windows (n, 32) -> (n, 16), and its gradient; the loss is 0 unless wanted.

    ``follows``: for all windows but the last whether their second half is the first half of the next one;
    ``groups``: what ``by_group`` gives for the targets, if known.
    Keys and values are never formed: a query meets the inputs through the product of its own and
    the keys' projection, and what is seen passes the product of the values' and the output's.
    Attention is not divided by its sums; what it mixes and the slopes that come back are.
    """
    scale = np.float32(1 / np.sqrt(WIDTH))
    asking, giving = w["Q"] @ w["K"].T * scale, w["V"] @ w["O"]
    x = w["E"].take(inputs, axis=0)
    x += w["P"]
    across = x.transpose(0, 2, 1)
    own = np.ascontiguousarray(x[:, HALF - 1:-1]).reshape(-1, WIDTH)
    shape = (len(x), HALF, WIDTH)
    q = (own @ asking).reshape(shape)
    seen = q @ across
    seen += CAUSAL
    seen[opening] += OPENING
    seen, total = _powers(seen)
    mixed = (seen @ x).reshape(-1, WIDTH)
    mixed /= total
    target, weight = target.ravel(), weight.ravel()
    order, present = groups or by_group(target)
    given = mixed @ giving
    given += own
    # From here on the rows are in the order of their groups.
    hidden = np.ones((len(own), WIDTH + 1), own.dtype)
    hidden[:, :-1] = given.take(order, axis=0)
    heads = heads_of(w)
    z, right = headed(hidden, heads, target[order], present)
    z, sums = _powers(z.reshape(-1, PLACES))
    part = (weight[order] / max(float(weight.sum()), 1.0)).astype(hidden.dtype)
    loss = float(-(part[:, None] * np.log(z.ravel()[right] / sums.reshape(-1, 2) + 1e-30)).sum()) if want_loss else 0.0
    z *= part.repeat(2)[:, None] / sums
    z.ravel()[right] -= part[:, None]
    z = z.reshape(-1, 2 * PLACES)
    slopes, across_heads = np.zeros_like(heads), np.ascontiguousarray(heads[:, :-1].transpose(0, 2, 1))
    there = np.empty((len(z), WIDTH), z.dtype)
    for k, a, b in present:
        np.matmul(hidden[a:b].T, z[a:b], out=slopes[k])
        np.matmul(z[a:b], across_heads[k], out=there[a:b])
    g: Weights = {"G": slopes[:, :-1, :GROUPS].sum(axis=0), "g": slopes[:, -1, :GROUPS].sum(axis=0), "U": slopes[:, :-1, PLACES:PLACES + GROUP_CLASSES], "b": slopes[:, -1, PLACES:PLACES + GROUP_CLASSES]}
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dh = there.take(back, axis=0)
    dmixed = dh @ giving.T
    dmixed /= total
    slope = dmixed.reshape(shape) @ across
    slope -= np.einsum("ij,ij->i", dmixed, mixed).reshape(len(x), HALF, 1)
    slope *= seen
    dq = (slope @ x).reshape(-1, WIDTH)
    dx = slope.transpose(0, 2, 1) @ q
    dx += seen.transpose(0, 2, 1) @ dmixed.reshape(shape)
    dasking, dgiving = own.T @ dq, mixed.T @ dh
    g["Q"], g["K"] = dasking @ w["K"] * scale, dasking.T @ w["Q"] * scale
    g["V"], g["O"] = dgiving @ w["O"].T, w["V"].T @ dgiving
    dq = dq @ asking.T
    dq += dh
    dx[:, HALF - 1:-1] += dq.reshape(shape)
    g["P"] = dx.sum(axis=0)
    # A half that two windows share is summed over both first.
    first = 2 * np.arange(len(x)) if follows is None else np.append(0, np.cumsum(2 - follows))
    halves, flat = np.zeros((first[-1] + 2, HALF, WIDTH), x.dtype), np.empty((first[-1] + 2, HALF), np.uint16)
    flat[first], flat[first + 1] = inputs[:, :HALF], inputs[:, HALF:]
    halves[first + 1] = dx[:, HALF:]
    halves[first] += dx[:, :HALF]
    flat = flat.ravel()
    there = np.argsort(flat, kind="stable")
    flat = flat[there]
    begin = np.append(0, np.flatnonzero(flat[1:] != flat[:-1]) + 1)
    g["E"] = np.zeros_like(w["E"])
    g["E"][flat[begin]] = np.add.reduceat(halves.reshape(-1, WIDTH).take(there, axis=0), begin, axis=0)
    return loss, g


def windows_of(parts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of 16 for several sequences of input numbers: a block of start marks before each, zeros after.

    Gives the flat inputs, the blocks to be scored and whether each is a sequence's first.
    """
    blocks = np.array([1 + -(-len(p) // HALF) for p in parts])
    first = np.cumsum(blocks) - blocks
    flat = np.zeros(int(blocks.sum()) * HALF, np.int32)
    scored = np.ones(int(blocks.sum()), bool)
    scored[first] = False
    opening = np.zeros(len(scored), bool)
    opening[np.minimum(first + 1, len(scored) - 1)] = True
    for f, part in zip(first, parts):
        flat[f * HALF:(f + 1) * HALF] = start
        flat[(f + 1) * HALF:(f + 1) * HALF + len(part)] = part
    chosen = np.flatnonzero(scored)
    return flat, chosen, opening[chosen]


def fit_here(w: Weights, parts: list[np.ndarray], held: Classes, settings: Settings, moments: dict) -> int:
    """Adam steps over the windows of some id sequences, in place; returns the number of windows.

    ``moments`` starts empty or with the steps ``before``, from which on the rate falls. All weights
    lie in one array, of which ``w`` holds views.
    """
    names = sorted(w)
    if "all" not in moments:
        moments["all"] = np.concatenate([w[k].ravel() for k in names])
        moments["mean"], moments["square"] = np.zeros_like(moments["all"]), np.zeros_like(moments["all"])
        for k, part in zip(names, np.split(moments["all"], np.cumsum([w[k].size for k in names])[:-1])):
            w[k] = part.reshape(w[k].shape)
    whole, m, v = moments["all"], moments["mean"], moments["square"]
    # Ids count from 1 here: 0 fills the end of a block, the one after the last id is the start mark.
    ids, chosen, opening = windows_of([p + 1 for p in parts], len(held.inputs) + 1)
    ids = ids.reshape(-1, HALF)
    flat = np.concatenate([[0], held.inputs, [len(w["E"]) - 1]]).astype(np.int32).take(ids)
    target = np.concatenate([[0], held.classes, [0]]).astype(np.int32).take(ids)
    filled = ids > 0
    groups = by_batch_and_group(target[chosen].ravel(), settings.batch * HALF)
    for number, at in enumerate(range(0, len(chosen), settings.batch)):
        own = chosen[at:at + settings.batch]
        _, g = loss_and_gradient(w, np.concatenate([flat[own - 1], flat[own]], axis=1), target[own], filled[own], opening[at:at + settings.batch],
                                 want_loss=False, follows=np.diff(own) == 1, groups=groups[number])
        moments["t"] = moments.get("t", 0) + 1
        rate = settings.rate * min(1.0, moments["t"] / 20) / (1 + (moments["t"] + moments.get("before", 0)) / 400)
        slope = np.concatenate([g[k].ravel() for k in names])
        # The sums of slopes and squares are kept undivided; the shares 0.1 and 0.01 of the new ones go into two numbers.
        below = np.sqrt(0.01 / (1 - 0.99 ** moments["t"]))
        least, rate = np.float32(1e-6 / below), np.float32(0.1 * rate / (1 - 0.9 ** moments["t"]) / below)
        m *= np.float32(0.9)
        m += slope
        slope *= slope
        v *= np.float32(0.99)
        v += slope
        np.sqrt(v, out=slope)
        slope += least
        np.divide(m, slope, out=slope)
        slope *= rate
        whole -= slope
    return len(chosen)


def runs(ids: np.ndarray, share: int) -> list[np.ndarray]:
    """The ids of a text that are fitted: all in one, or one in ``share`` runs of ``RUN_IDS`` ids."""
    if share == 1:
        return [ids]
    starts = range(zlib.crc32(ids.tobytes()) % share * RUN_IDS, len(ids), share * RUN_IDS)
    return [ids[k:k + RUN_IDS] for k in starts]


def runs_of(text: bytes | None, path: str, share: int) -> list[np.ndarray]:
    """The same of a text that is not encoded yet."""
    return runs(ids_of(words_in(text), path), share)


def stored_kind(path: str) -> type:
    """The smallest unsigned integers that hold every id."""
    return np.uint16 if n_ids(path) <= 1 << 16 else np.uint32


def encoded(texts: DataFrame, path: str, rounds: int) -> DataFrame:
    """Rows (ids, round) of a single text column."""
    kind = stored_kind(path)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [ids_of(words_in(text), path).astype(kind).tobytes() for text in raw(batch.column(0))]
            yield batch_of({"ids": (pa.binary(), own), "round": (pa.int32(), [zlib.crc32(o) % rounds for o in own])})

    return texts.mapInArrow(made, "ids binary, round int")


def fit(training: DataFrame, held: Classes, path: str, settings: Settings = Settings()) -> Weights:
    """Weights fitted on all texts of a single text column (or one in ``share`` runs of them)."""
    return fit_ids(written(encoded(training, path, settings.rounds), "training-ids"), held, path, settings)


def fit_ids(training: DataFrame, held: Classes, path: str, settings: Settings = Settings()) -> Weights:
    """Weights fitted on all rows (ids, round), averaged over the tasks after each round.

    The average is formed on the executors; one set of weights a round comes to the driver. A round
    without rows changes nothing.
    """
    w, before = start_weights(held.prior), 0
    names = sorted(w)
    for number in range(settings.rounds):
        flat = _round(training.where(F.col("round") == number).select("ids"), w, held, path, settings, before)
        if flat is None:
            continue
        sizes = np.cumsum([w[k].size for k in names])
        w = {k: part.reshape(w[k].shape) for k, part in zip(names, np.split(flat[:-1].astype(np.float32), sizes[:-1]))}
        before += int(flat[-1])
    return w


def _round(training: DataFrame, begin: Weights, held: Classes, path: str, settings: Settings, before: int) -> np.ndarray | None:
    """The averaged weights in the order of their names, and the mean number of steps."""
    kind, least = stored_kind(path), -(-settings.steps // settings.rounds)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        w, moments, number, parts, last, load = {k: v.copy() for k, v in begin.items()}, {"before": before}, 0, [], [], 0
        for batch in batches:
            for own in batch.column(0):
                for part in runs(np.frombuffer(own.as_buffer(), kind).astype(np.int64), settings.share):
                    parts.append(part)
                    load += len(part)
                if load > 1 << 16:
                    number += fit_here(w, parts, held, settings, moments)
                    last, parts, load = parts, [], 0
        if parts:
            number += fit_here(w, parts, held, settings, moments)
        while (parts or last) and moments["t"] < least:
            fit_here(w, parts or last, held, settings, moments)
        if number:
            flat = np.concatenate([*(w[k].ravel() for k in sorted(w)), [moments["t"]]]).astype(np.float64)
            yield batch_of({"at": (pa.int64(), np.arange(len(flat))), "value": (pa.float64(), flat * number), "n": (pa.int64(), np.full(len(flat), number))})

    found = training.mapInArrow(fitted, "at long, value double, n long").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()
    if not found.num_rows:
        return None
    flat = np.zeros(found.num_rows)
    flat[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return flat


class Scorer:
    """Batched masked attention; the product of every input vector with the queries' and keys' projections is formed beforehand."""

    def __init__(self, w: Weights, held: Classes):
        self.held, self.w = held, w
        # The id after the last one stands for the start mark.
        self.inputs, self.classes = np.append(held.inputs, len(w["E"]) - 1).astype(np.int32), np.append(held.classes, 0).astype(np.int32)
        asking = w["Q"] @ w["K"].T / np.float32(np.sqrt(WIDTH))
        self.q, self.q_place = w["E"] @ asking, w["P"][HALF - 1:-1] @ asking
        self.giving, self.heads = w["V"] @ w["O"], heads_of(w)

    def class_scores(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """log10 of the probability of the class of each id, given the ids before it."""
        start = len(self.inputs) - 1
        ids, chosen, opening = windows_of(parts, start)
        target = self.classes[ids].reshape(-1, HALF)
        flat = self.inputs[ids]
        blocks = flat.reshape(-1, HALF)
        before = np.append(self.inputs[start], flat[:-1]).reshape(-1, HALF)
        out = np.zeros((len(blocks), HALF), np.float64)
        for at in range(0, len(chosen), HEAD_WINDOWS):
            own = chosen[at:at + HEAD_WINDOWS]
            hidden = np.ones((len(own) * HALF, WIDTH + 1), np.float32)
            for k in range(0, len(own), CHUNK_WINDOWS):
                self._attend(blocks, before, own[k:k + CHUNK_WINDOWS], opening[at + k:at + k + CHUNK_WINDOWS],
                             hidden[k * HALF:(k + CHUNK_WINDOWS) * HALF, :-1])
            goal = target[own].ravel()
            order, present = by_group(goal)
            z, right = headed(hidden.take(order, axis=0), self.heads, goal[order], present)
            sums = _powers(z.reshape(-1, PLACES))[1].reshape(-1, 2)
            told = z.ravel()[right].sum(axis=1)
            told -= np.log(sums).sum(axis=1)
            there = np.empty_like(told)
            there[order] = told
            out[own] = there.reshape(-1, HALF)
        out /= np.log(10)
        whole, at, found = out.ravel(), 0, []
        for part in parts:
            at += HALF
            found.append(whole[at:at + len(part)])
            at += -(-len(part) // HALF) * HALF
        return found

    def _attend(self, blocks: np.ndarray, before: np.ndarray, own: np.ndarray, first: np.ndarray, hidden: np.ndarray) -> None:
        """Writes what the windows that end with the blocks ``own`` hand to the heads."""
        x = self.w["E"].take(np.concatenate([blocks[own - 1], blocks[own]], axis=1), axis=0)
        x += self.w["P"]
        q = self.q.take(before[own], axis=0)
        q += self.q_place
        seen = q @ x.transpose(0, 2, 1)
        seen += CAUSAL
        seen[first] += OPENING
        seen, total = _powers(seen)
        mixed = (seen @ x).reshape(-1, WIDTH)
        mixed /= total
        mixed = (mixed @ self.giving).reshape(q.shape)
        mixed += x[:, HALF - 1:-1]
        hidden[...] = mixed.reshape(-1, WIDTH)

    def scores(self, parts: list[np.ndarray]) -> list[float]:
        """log10 of the probability of each id sequence."""
        return [float(c.sum() + self.held.within[p].sum()) for c, p in zip(self.class_scores(parts), parts)]


class WordIds:
    """Numbers of the frequent words with their counts and ids; the ids of other words are found when they come."""

    def __init__(self, words: list[bytes], counts: list[int], path: str):
        self.number = {w: k for k, w in enumerate(words)}
        self.counts = np.array(counts, np.int64)
        self.ids, starts = spelled_ids(b" ".join(words).decode(), path)
        self.sizes, self.starts = np.diff(np.append(starts, len(self.ids))).astype(np.int32), starts.astype(np.int32)
        self.path = path

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The word numbers, -1 for the others."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def sequences(self, texts: list[tuple[list[bytes], np.ndarray]]) -> list[np.ndarray]:
        """The id sequences of several texts, each with the end."""
        words = [w for own, _ in texts for w in own]
        begin = np.append(0, np.cumsum([len(own) for own, _ in texts]))
        flat, ends = self.lines(words, np.concatenate([n for _, n in texts]), np.arange(len(words)), begin)
        return np.split(flat, ends[:-1])

    def lines(self, distinct: list[bytes], number: np.ndarray, codes: np.ndarray, begin: np.ndarray, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts as ``split_words`` gives them, each with the end, in one array; and where each text ends."""
        place, frequent = np.flatnonzero(number < 0), np.flatnonzero(number >= 0)
        own, first = spelled_ids(b" ".join(distinct[k] for k in place).decode("utf-8", "replace"), self.path)
        # One pool of ids: those of the frequent words here, of the other words here, and the end.
        known = self.sizes[number[frequent]]
        starts = np.cumsum(known) - known
        pool = np.concatenate([self.ids[np.repeat(self.starts[number[frequent]] - starts, known) + np.arange(known.sum())], own, [n_ids(self.path) - 1]]).astype(kind)
        sizes, source = np.ones(len(distinct) + 1, np.int32), np.full(len(distinct) + 1, len(pool) - 1, np.int32)
        sizes[frequent], source[frequent] = known, starts
        sizes[place], source[place] = np.diff(np.append(first, len(own))), int(known.sum()) + first
        tokens = np.full(len(codes) + len(begin) - 1, len(distinct), np.int32)
        inside = np.ones(len(tokens), bool)
        inside[begin[1:] + np.arange(len(begin) - 1)] = False
        tokens[inside] = codes
        out = []
        for at in range(0, len(tokens), GROUP_WORDS):
            part = tokens[at:at + GROUP_WORDS]
            size = sizes[part]
            out.append(pool[np.repeat(source[part] - (np.cumsum(size, dtype=np.int32) - size), size) + np.arange(int(size.sum()), dtype=np.int32)])
        ends = np.append(0, np.cumsum(sizes[tokens], dtype=np.int64))[begin[1:] + np.arange(1, len(begin))]
        return np.concatenate([*out, np.empty(0, kind)]), ends


def score(docs: DataFrame, path: str, modulus: int = 7, left: int = 2, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the documents whose crc32 of doc_id modulo ``modulus`` is not ``left``; a NULL doc_id
    is neither learned from nor held out. NULL and empty texts consist of the end alone. Repeated
    rows are scored each. Without training documents every count is 0 and the weights are the start.

    Words that are not among the ``settings.frequent`` most frequent ones are joined with the counts.
    The ids of every text are written once, and read for fitting and for scoring.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learned = remainder(F.col("doc_id"), modulus) != left
    words = written(word_counts(texts.where(learned).select("text")), "word-counts")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    held = classes_of(id_counts(words, path))
    level = F.floor(F.log2("n") * 4).cast("int")
    levels = sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level)
    taken, least = 0, None
    for row in levels:
        if taken + row["count"] > settings.frequent:
            break
        taken, least = taken + row["count"], row.level
    often = words.where((level >= least) & (F.col("word") != END)).collect() if least is not None else []
    frequent = WordIds([r.word.encode() for r in often], [r.n for r in often], path)
    known_end = (words.where(F.col("word") == END).first() or [END, 0])[1]
    floor = total + distinct + 1
    kind, n_rounds = stored_kind(path), settings.rounds
    stock = docs.sparkSession.sparkContext.broadcast(frequent)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        frequent = stock.value
        worth = np.log10((frequent.counts + 1) / floor)
        for batch in batches:
            distinct, codes, begin = split_words(batch.column("text"))
            spelled, n = distinct.to_numpy(zero_copy_only=False).tolist(), np.diff(begin)
            number = frequent.numbers(spelled)
            often = number >= 0
            own = np.zeros(len(spelled))
            own[often] = worth[number[often]]
            base = np.full(len(n), float(np.log10((known_end + 1) / floor)))
            base[n > 0] += np.add.reduceat(own[codes], begin[:-1][n > 0]) if len(codes) else 0
            known = np.diff(np.append(0, np.cumsum(often[codes]))[begin]) + int(known_end > 0)
            seldom = np.flatnonzero(~often[codes])
            pairs, times = np.unique(np.repeat(np.arange(len(n)), n)[seldom] * max(len(spelled), 1) + codes[seldom], return_counts=True)
            line, code = np.divmod(pairs, max(len(spelled), 1))
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(line, np.arange(len(n) + 1)), pa.int32()), pa.StructArray.from_arrays(
                [distinct.take(pa.array(code)).cast(pa.string()), pa.array(times, pa.int64())], names=["word", "n"]))
            flat, ends = frequent.lines(spelled, number, codes, begin, kind)
            final = [own.tobytes() for own in np.split(flat, ends[:-1])] if len(n) else []
            yield batch_of({"row": (pa.int64(), batch.column("row")), "doc_id": (None, batch.column("doc_id")), "learned": (None, batch.column("learned")),
                            "n_tokens": (pa.int64(), n + 1), "n_known": (pa.int64(), known), "base_score": (pa.float64(), base), "rare": (None, rare),
                            "round": (pa.int32(), [zlib.crc32(p) % n_rounds for p in final]), "ids": (pa.binary(), final)})

    own_kind = texts.schema["doc_id"].dataType.simpleString()
    rows = written(texts.withColumn("row", F.monotonically_increasing_id()).withColumn("learned", F.coalesce(learned, F.lit(False))).mapInArrow(
        counted, f"row long, doc_id {own_kind}, learned boolean, n_tokens long, n_known long, base_score double, "
                 "rare array<struct<word string, n long>>, round int, ids binary"), "text-ids")
    weights = fit_ids(rows.where("learned").select("ids", "round"), held, path, settings)
    model = docs.sparkSession.sparkContext.broadcast((weights, held))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        scorer = Scorer(*model.value)
        for batch in batches:
            final, group, load = [], [], 0
            for own in batch.column("ids"):
                group.append(np.frombuffer(own.as_buffer(), kind).astype(np.int64))
                load += len(group[-1])
                if load > GROUP_WORDS:
                    final += scorer.scores(group)
                    group, load = [], 0
            if group:
                final += scorer.scores(group)
            yield batch_of({"row": (pa.int64(), batch.column("row")), "score": (pa.float64(), final)})

    scores = rows.select("row", "ids").mapInArrow(scored, "row long, score double")
    seldom = rows.select("row", F.explode("rare").alias("own")).select("row", "own.word", F.col("own.n").alias("times"))
    found = seldom.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = found.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
                                    F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(floor))).alias("more_base"))
    whole = rows.drop("rare", "ids").join(scores, "row").join(more, "row", "left")
    return whole.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == left, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")
