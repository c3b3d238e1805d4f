"""Masked pseudo-likelihood: how well a document's words follow from the words on both sides."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strayline.llm.common import cut

# Words with at least sqrt(all words) / RARE occurrences are tokens of their own, so the vocabulary
# grows with the corpus; at least CLASSES hash classes stand for all other words in the network.
RARE, CLASSES = 4, 128
# A token is a pair (high, low) of SIDE values each: two small softmaxes instead of one. A network
# of SIZE tokens is the smallest that is made.
SIDE = 16
SIZE = SIDE * SIDE
WINDOW, WIDTH = 2, 16
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
BATCH, RATE = 2048, 0.2
# Scores whose exponentials fit a float.
_SAFE = 60.0
PAD = -1  # stands for a word beyond either end, the last row of a table

Network = dict[str, np.ndarray]


def _shapes(side: int) -> dict[str, tuple[int, ...]]:
    return {
        "embed": (len(OFFSETS), side * side + 1, WIDTH), "bias": (WIDTH,), "high": (WIDTH, side), "high_bias": (side,),
        "low": (WIDTH, side), "low_bias": (side, side),
    }


def _start(side: int = SIDE) -> Network:
    draw = np.random.default_rng(11)
    return {k: draw.normal(0, 0.0 if k.endswith("bias") else 0.1, s).astype(np.float32) for k, s in _shapes(side).items()}


def _pack(net: Network) -> np.ndarray:
    return np.concatenate([x.ravel() for x in net.values()]).astype(np.float64)


def _unpack(flat: np.ndarray, side: int = SIDE) -> Network:
    shapes = _shapes(side)
    parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1])
    return {k: p.reshape(s) for (k, s), p in zip(shapes.items(), parts)}


def _side(n_common: int) -> int:
    """Side of the least square that holds the frequent words and CLASSES classes; classes fill it."""
    return max(SIDE, math.isqrt(n_common + CLASSES - 1) + 1)


def _class(words: list[bytes], n_common: int, side: int) -> np.ndarray:
    # from length and ends of a word: the same in every process, unlike hash()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    units, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
    first, last, middle = (units[at].astype(np.int64) for at in (starts, starts + sizes - 1, starts + sizes // 2))
    return n_common + (31 * sizes + 7 * first + 13 * last + middle) % (side * side - n_common)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only


def tokens_of(texts: list[bytes | None], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words of some texts (A-Z in lower case), one text after the other, and the words of each."""
    split = [_words(t) for t in texts]
    sizes, words = np.fromiter(map(len, split), np.int64, len(split)), list(chain.from_iterable(split))
    found = np.fromiter(map(ids.get, words, repeat(-1)), np.int64, len(words))
    rare = np.flatnonzero(found < 0)
    if len(rare):
        found[rare] = _class([words[k] for k in rare.tolist()], len(ids), _side(len(ids)))
    return found, sizes


def tokens(text: bytes | None, ids: dict[bytes, int]) -> np.ndarray:
    """Token of every word of a text."""
    return tokens_of([text], ids)[0]


def _exponents(z: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """``exp(z)`` up to a factor per row, which ``z`` is rid of too. Inputs are within -1 and 1, so weights
    and bias bound ``z``; only where that bound is too high for a float, the greatest of a row is taken off."""
    if not np.abs(weights).sum(axis=0).max() + np.abs(bias).max() < _SAFE:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z)


def _parts(net: Network, around: np.ndarray, high: np.ndarray):
    """Hidden values, and for the high and the low part of a token: scores, their exponentials and the
    sum of those in each row."""
    hidden = net["embed"][0].take(around[0], axis=0)
    for k in range(1, len(OFFSETS)):
        hidden += net["embed"][k].take(around[k], axis=0)
    hidden += net["bias"]
    np.tanh(hidden, out=hidden)
    parts = []
    ones = np.ones((len(net["high_bias"]), 1), np.float32)
    for kind, of_row in (("high", net["high_bias"]), ("low", net["low_bias"].take(high, axis=0))):
        z = hidden @ net[kind]
        z += of_row
        e = _exponents(z, net[kind], net[f"{kind}_bias"])
        parts.append((z, e, e @ ones))
    return hidden, *parts


def _forward(net: Network, around: np.ndarray, high: np.ndarray):
    """Hidden values, and the logarithms of the probabilities of all high and all low parts."""
    hidden, *parts = _parts(net, around, high)
    for z, _, total in parts:
        z -= np.log(total)
    return hidden, *(z for z, _, _ in parts)


def _batches(found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and the tokens around them; texts are apart from each other by WINDOW paddings."""
    places = np.flatnonzero(found != PAD)
    for k in range(0, len(places), BATCH):
        at = places[k : k + BATCH]
        yield at, np.stack([found[at + o] for o in OFFSETS])


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gap = np.full(WINDOW, PAD)
    starts = np.cumsum([WINDOW] + [len(t) + WINDOW for t in texts])[:-1]
    return np.concatenate([gap, *[x for t in texts for x in (t, gap)]]), starts


def _sums(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of small whole numbers, ascending, and the sum of the rows of each.

    Two floats are added as one complex number: a sum of short runs costs by the columns it has.
    """
    small = np.int16 if ids.max() < 2**15 else np.int64  # sorted by counting, which is several times faster
    order = np.argsort(ids.astype(small), kind="stable")
    ids, rows = ids.take(order), rows.take(order, axis=0)
    first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    n = rows.shape[1]
    if n % 2:
        rows = np.concatenate([rows, np.zeros((len(rows), 1), np.float32)], axis=1)
    return ids[first], np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)[:, :n]


def _step(net: Network, around: np.ndarray, target: np.ndarray, rate: float) -> None:
    side = len(net["high_bias"])
    high, low = target // side, target % side
    hidden, (_, d_high, sum_high), (_, d_low, sum_low) = _parts(net, around, high)
    n, each = np.float32(rate / len(target)), np.ones(len(target), np.float32)
    first = np.arange(0, len(target) * side, side)
    d_high /= sum_high
    d_low /= sum_low
    d_high.ravel()[first + high] -= 1
    d_low.ravel()[first + low] -= 1
    back = (d_high @ net["high"].T + d_low @ net["low"].T) * (1 - hidden * hidden)
    net["high"] -= n * (hidden.T @ d_high)
    net["high_bias"] -= n * (each @ d_high)
    net["low"] -= n * (hidden.T @ d_low)
    kinds, of_kind = _sums(d_low, high)
    net["low_bias"][kinds] -= n * of_kind
    net["bias"] -= n * (each @ back)
    for embed, ids in zip(net["embed"], around):
        ids, of_id = _sums(back, ids)
        # a frequent word sums many gradients: a fixed share of the batch bounds its step
        embed[ids] = embed.take(ids, axis=0) - 8 * n * of_id


_GROUP = 256
# Different words that a task counts before it sends them.
_HELD = 1 << 16
_VALUES = [f"v{k}" for k in range(WIDTH)]  # a row of weights


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, _GROUP):
            part = batch.slice(k, _GROUP)
            yield part, part.column(column).to_pylist()


def _tokenized(ids: dict[bytes, int]):
    """Rows ``(doc_id, h, g, text)`` with the tokens of the text in its place."""
    kind = _token_type(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 3):
            found, sizes = tokens_of(texts, ids)
            ends = np.cumsum(sizes) * kind.itemsize
            flat = found.astype(kind).tobytes()
            packed = pa.array([flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], packed], ["doc_id", "h", "g", "tokens"])

    return run


def _token_type(ids: dict[bytes, int]) -> np.dtype:
    return np.dtype(np.int16 if _side(len(ids)) ** 2 < 2**15 else np.int32)


def _read_tokens(packed: list[bytes], ids: dict[bytes, int]) -> list[np.ndarray]:
    kind = _token_type(ids)
    return [np.frombuffer(x, kind).astype(np.int64) for x in packed]


def _train(ids: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = _start(_side(len(ids))), 0
        for _, packed in _texts(batches, 0):
            found, _ = _joined(_read_tokens(packed, ids))
            for at, around in _batches(found):
                _step(net, around, found[at], RATE * 32 / (32 + seen / (64 * BATCH)) if seen else RATE)
                seen += len(at)
        if seen:
            flat = _pack(net) * seen
            rows = np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), float(seen))), *map(pa.array, rows.T.copy())],
                ["place", "seen", *_VALUES],
            )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["word", "n"])

    count = Counter()
    for _, texts in _texts(batches, 0):
        for t in texts:
            count.update(_words(t))
        if len(count) > _HELD:
            yield rows()
            count = Counter()
    yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows ``(word, n)``: all words of a corpus, written to the shared folder."""
    found = docs.select(F.col("text").cast("binary")).mapInArrow(_counted, "word binary, n long")
    return cut(found.groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame) -> dict[bytes, int]:
    """The words that are tokens of their own, the most frequent first. They all have at least
    ``sqrt(N) / RARE`` of the ``N`` occurrences, so there are ``RARE * sqrt(N)`` at most."""
    n = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.where(F.col("n") >= math.sqrt(n) / RARE).orderBy(F.desc("n"), "word").collect()
    return {bytes(r["word"]): k for k, r in enumerate(top)}


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary").alias("text")
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"), text)


def tokenized(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """Rows ``(doc_id, h, g, tokens)``, in the partitions of ``docs``: two hashes of the text, and its
    tokens in two or four bytes each. Written to the shared folder, for training and scoring."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return cut(_keyed(docs).mapInArrow(_tokenized(ids), f"doc_id {id_type}, h long, g int, tokens binary"))


def train(split: DataFrame, ids: dict[bytes, int]) -> Network:
    """Network over the tokens of a vocabulary, from texts that `tokenized` split.

    Every partition trains a copy of one start on all of its texts, and the copies are averaged
    weight by weight by the words they saw.
    """
    kinds = ", ".join(f"{v} double" for v in _VALUES)
    parts = split.select("tokens").mapInArrow(_train(ids), f"place int, seen double, {kinds}")
    mean = parts.groupBy("place").agg(*[(F.sum(v) / F.sum("seen")).alias(v) for v in _VALUES]).toPandas()
    start = _start(_side(len(ids)))
    if mean.empty:
        return start
    flat = mean.sort_values("place")[_VALUES].to_numpy().ravel()
    return _unpack(flat[: len(_pack(start))], _side(len(ids)))


def _classes(ids: dict[bytes, int]):
    """Occurrences of each class, from rows ``(word, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, side = len(ids), _side(len(ids))
        for batch in batches:
            kinds = _class(batch.column(0).to_pylist(), n, side)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), batch.column(1)], ["class", "n"])

    return run


def _rare(ids: dict[bytes, int]):
    """Words of a text that have no token of their own, each with its occurrences there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 2):
            words, times, of = [], [], []
            for k, t in enumerate(texts):
                count = Counter(w for w in _words(t) if w not in ids)
                words += count.keys()
                times += count.values()
                of += [k] * len(count)
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(of), part.column(1).take(of), pa.array(words, pa.binary()), pa.array(times, pa.int64())],
                ["h", "g", "word", "times"],
            )

    return run


def _scores(ids: dict[bytes, int], net: Network, log_class: np.ndarray):
    """Rows of what the network gives, less the logarithms of the counts of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = len(net["high_bias"])
        for part, packed in _texts(batches, 3):
            split = _read_tokens(packed, ids)
            found, starts = _joined(split)
            total = np.zeros(len(split))
            for at, around in _batches(found):
                target = found[at]
                high, low, rows = target // side, target % side, np.arange(len(at))
                _, *parts = _parts(net, around, high)
                own = -log_class[target]
                for (z, _, sums), x in zip(parts, (high, low)):
                    own += z[rows, x] - np.log(sums[:, 0])
                total += np.bincount(np.searchsorted(starts, at, side="right") - 1, own, len(split))
            n = np.array([len(t) for t in split])
            rare = np.array([int((t >= len(ids)).sum()) for t in split])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(total)],
                ["doc_id", "h", "g", "n_tokens", "n_rare", "total"],
            )

    return run


def score(docs: DataFrame) -> DataFrame:
    """Pseudo-log-likelihood of every document under a network trained on all of them.

    Rows ``(doc_id, n_tokens, log_likelihood, mean_log_likelihood)``, one for each row of ``docs``,
    repeated rows included. Every word is masked in turn and predicted from WINDOW tokens on either
    side: ``log P(high) + log P(low | high)`` over all tokens, and for a word that shares a class
    ``log P(word | class)``, its part of the class's occurrences in the corpus. A null or wordless
    text scores 0 in both; an empty table gives none. The averaged network depends a little on how
    the rows are partitioned. Other columns are not read.

    The counts of all words are a table that the rare words of each text meet by a join; no such
    word has more rows there than the vocabulary's threshold. The driver gets the vocabulary, the
    occurrences of each class and one network, all of the order of the root of the corpus.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = word_counts(docs)
    ids = vocabulary(counts)
    split = tokenized(docs, ids)
    net = train(split, ids)
    least = math.sqrt(counts.agg(F.sum("n")).first()[0] or 0) / RARE
    rare_words = counts.where(F.col("n") < least)
    kinds = rare_words.mapInArrow(_classes(ids), "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    log_class = np.zeros(_side(len(ids)) ** 2)
    for r in kinds:
        log_class[r["class"]] = math.log(r["n"])

    base = split.mapInArrow(
        _scores(ids, net, log_class), f"doc_id {id_type}, h long, g int, n_tokens long, n_rare long, total double"
    )
    words = _keyed(docs).drop("doc_id").mapInArrow(_rare(ids), "h long, g int, word binary, times long")
    # rows of one text add up here: their number is the sum of times over n_rare
    met = words.join(rare_words, "word").groupBy("h", "g").agg(
        F.sum(F.col("times") * F.log("n")).alias("logs"), F.sum("times").alias("times")
    )
    within = F.when(F.col("n_rare") > 0, F.col("logs") * F.col("n_rare") / F.col("times")).otherwise(0.0)
    found = base.join(met, ["h", "g"], "left").withColumn("log_likelihood", F.col("total") + within)
    return found.select(
        "doc_id", "n_tokens", "log_likelihood",
        (F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1))).alias("mean_log_likelihood"),
    )
