"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact text likelihoods by the scaled forward recursion.

A token is emitted in two steps. The hidden state emits a class: a word that makes up at least 1 / OWN of all training tokens is
a class of its own, all others share ENDINGS classes by their last three bytes. The class then emits the word by its smoothed
training count. So states, transitions and class emissions are tables of bounded size that every task can hold, while the
word counts stay a distributed table that grows with the corpus and is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.llm.tables import long_list, pieces, stored, strings
from echogrid.llm.words import Words, mix, words

STATES = 8
ROUNDS = 8
OWN = 1 << 14
ENDINGS = 1 << 12
#: A word is looked up in place when it makes up at least 1 / FREQUENT of the training tokens, so at most so many are sent out.
FREQUENT = 1 << 19
SMOOTH = 0.1
#: Share of the class frequencies mixed into each state's emissions, and of a uniform row into its transitions, for scoring.
MIXED = 0.02
SEGMENT = 1024
#: Segments worked on at once.
GROUP = 1024
#: Steps between two rescalings: probabilities of 1e-12 each stay far above the smallest double.
RESCALE = 8
SEED = 11
END_HASH = np.uint64(0x5851F42D4C957F2D)
TINY = 1e-12


class Model(NamedTuple):
    """start (states), move (states x states) and emit (classes x states); columns of `emit` sum to one."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Lexicon(NamedTuple):
    """Frequent words by ascending hash with count and class (an ending's class if not their own), and the class totals."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    own: int
    ending_total: np.ndarray
    ending_words: np.ndarray
    tokens: int
    words: int

    @property
    def frequencies(self) -> np.ndarray:
        """Smoothed share of every class in the training tokens."""
        kept = self.classes < self.own
        share = np.zeros(self.own + ENDINGS)
        share[self.classes[kept]] = self.counts[kept]
        share[self.own:] = self.ending_total + SMOOTH * (self.ending_words + 1)
        return share / share.sum()


# -- one batch of texts ---------------------------------------------------------------------------------------------------


class Tokens(NamedTuple):
    """Hashes of all tokens, each text's words and its end, where each one lies in `words` (-1: an end), and tokens per text."""

    hashes: np.ndarray
    word: np.ndarray
    counts: np.ndarray
    words: Words

    def endings(self, chosen: np.ndarray) -> np.ndarray:
        """Ending class of the chosen tokens, from their last three bytes; 0 for an end."""
        w, word = self.words, self.word[chosen]
        inside = word >= 0
        start, end = w.starts[word[inside]], w.ends[word[inside]]
        value = np.zeros(len(start), dtype=np.uint64)
        for back in (1, 2, 3):
            at = end - back
            value = value * np.uint64(257) + np.where(at >= start, w.bytes[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        out = np.zeros(len(word), dtype=np.int64)
        out[inside] = mix(value) % np.uint64(ENDINGS)
        return out


def _tokens(texts: list[str]) -> Tokens:
    w = words(texts)
    at = np.cumsum(w.counts)
    return Tokens(np.insert(w.hashes, at, END_HASH), np.insert(np.arange(len(w.hashes)), at, -1), w.counts + 1, w)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the hashes, and where each distinct one begins in it."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(hashes) else np.zeros(0, np.int64)


def _merge(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, ending, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order, first = _distinct(hashes)
    n = n[order]
    return hashes[order[first]], ending[order[first]], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        hashes, ending, n = _merge(held)
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ending), pa.array(n)], ["word", "ending", "n"])

    for piece in pieces(batches, "text"):
        tokens = _tokens(strings(piece, "text"))
        order, first = _distinct(tokens.hashes)
        held.append((tokens.hashes[order[first]], tokens.endings(order[first]), np.diff(np.append(first, len(order)))))
        size += len(held[-1][0])
        if size > 1_000_000:
            held = [_merge(held)]
            size = len(held[0][0])
            if size > 500_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _finder(known: np.ndarray):
    """Places of hashes among ascending known ones, len(known) for others: a table by leading bits, then a few steps."""
    bits = len(known).bit_length() + 1
    shift = np.uint64(64 - bits)
    begin = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << shift)
    behind = np.append(known, np.uint64(2**64 - 1))

    def find(hashes: np.ndarray) -> np.ndarray:
        at = begin[hashes >> shift]
        less = np.flatnonzero(behind[at] < hashes)
        while len(less):
            at[less] += 1
            less = less[behind[at[less]] < hashes[less]]
        at[behind[at] != hashes] = len(known)
        return at

    return find


def _encode(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: classes of all tokens, what frequent words add to the scores, and the other words to be joined."""
    from pyspark import TaskContext

    known: Lexicon = sent.value
    row = TaskContext.get().partitionId() << 40
    spread = np.log10(known.ending_total + SMOOTH * (known.ending_words + 1))
    # by frequent word, and one place more for all others: share of the base, share of the score within the class, class
    logs = np.append(np.log10(known.counts + SMOOTH), 0.0)
    frequent = np.append(known.classes, 0)
    within = np.where(frequent >= known.own, logs - spread[np.maximum(frequent - known.own, 0)], 0.0)
    within[-1] = 0.0
    find = _finder(known.hashes)
    for piece in pieces(batches, "text"):
        tokens = _tokens(strings(piece, "text"))
        hashes, counts, n = tokens.hashes, tokens.counts, piece.num_rows
        offsets = np.concatenate([[0], np.cumsum(counts)])
        at = find(hashes)
        rare = np.flatnonzero(at == len(known.hashes))
        whose = np.searchsorted(offsets, rare, side="right") - 1
        ending = tokens.endings(rare)
        states = frequent[at].astype(np.uint16)
        states[rare] = known.own + ending
        log = within[at]
        log[rare] = -spread[ending]
        base, inner = np.add.reduceat(logs[at], offsets[:-1]), np.add.reduceat(log, offsets[:-1])
        order = np.lexsort((hashes[rare], whose))
        n_found = counts - np.bincount(whose, minlength=n)
        word, whose = hashes[rare][order], whose[order]
        first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (whose[1:] != whose[:-1]))) if len(word) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(word)))
        per = np.bincount(whose[first], minlength=n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(row, row + n)), piece.column("doc_id"), piece.column("held_out"), pa.array(counts.astype(np.int64)),
            pa.array(n_found.astype(np.int64)), pa.array(base), pa.array(inner),
            pa.array([states[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
            long_list(word[first], per), long_list(tf.astype(np.int64), per)],
            ["row", "doc_id", "held_out", "n_tokens", "n_found", "base", "inner", "states", "words", "tf"])
        row += n


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_found long, base double, inner double, states binary, words array<long>, tf array<long>"


# -- recursions -----------------------------------------------------------------------------------------------------------


class Segments(NamedTuple):
    """Token sequences cut into stretches of SEGMENT tokens; `text` and `number` say whose and which each one is."""

    tokens: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray
    number: np.ndarray
    pieces: np.ndarray


def cut(sequences: list[np.ndarray]) -> Segments:
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    count = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(sequences)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(lengths) - lengths)[text] + number * SEGMENT
    size = np.minimum(SEGMENT, lengths[text] - number * SEGMENT)
    tokens = np.concatenate(sequences).astype(np.int64) if sequences else np.zeros(0, np.int64)
    return Segments(tokens, start, size, text, number, count)


def _groups(size: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chosen segments in groups of similar length, longest first, with the number still running at each step."""
    order = chosen[np.argsort(-size[chosen], kind="stable")]
    for a in range(0, len(order), GROUP):
        group = order[a:a + GROUP]
        steps = int(size[group[0]])
        yield group, len(group) - np.searchsorted(size[group][::-1], np.arange(steps), side="right")


def _emissions(s: Segments, model: Model, group: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each step begins, the tokens of a group step by step without gaps, and the probability of each under every state."""
    begin = s.begin[group]
    token = s.tokens[np.concatenate([begin[:n] + t for t, n in enumerate(running)])]
    return np.cumsum(running) - running, token, np.take(model.emit, token, axis=0)


def _products(s: Segments, model: Model, chosen: np.ndarray) -> np.ndarray:
    """Matrix of each chosen segment: distribution before its first token -> state weights at its last, up to a factor."""
    k, ones = len(model.start), np.ones(len(model.start))
    out = np.zeros((len(s.size), k, k))
    for group, running in _groups(s.size, chosen):
        at, _, emit = _emissions(s, model, group, running)
        # by entry state, segment and state: a step multiplies whole rows of segments
        now = np.eye(k)[:, None, :] * emit[:len(group)]
        moved = np.empty_like(now)
        for t, n in enumerate(running):
            if t:
                np.matmul(now[:, :n], model.move, out=moved[:, :n])
                np.multiply(moved[:, :n], emit[at[t]:at[t] + n], out=now[:, :n])
            if t % RESCALE == RESCALE - 1:
                now[:, :n] /= (now[:, :n] @ ones).sum(axis=0)[:, None]
        out[group] = (now / (now @ ones).sum(axis=0)[:, None]).transpose(1, 0, 2)
    return out


def _borders(s: Segments, model: Model, backward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per segment: distribution before its first token, state weights at the last token before it, weights behind its end."""
    k, n = len(model.start), len(s.size)
    entry, earlier, exit_ = np.tile(model.start, (n, 1)), np.zeros((n, k)), np.ones((n, k))
    first = np.cumsum(s.pieces) - s.pieces
    long_ = np.flatnonzero(s.pieces > 1)
    if not len(long_):
        return entry, earlier, exit_
    split = s.pieces[s.text] > 1
    matrix = _products(s, model, np.flatnonzero(split & (backward | (s.number < s.pieces[s.text] - 1))))
    for j in range(1, int(s.pieces.max())):
        at = first[long_[s.pieces[long_] > j]] + j
        weight = np.einsum("nk,nkl->nl", entry[at - 1], matrix[at - 1])
        earlier[at] = weight / weight.sum(axis=1, keepdims=True)
        entry[at] = earlier[at] @ model.move
    if backward:
        for j in range(1, int(s.pieces.max())):
            at = first[long_[s.pieces[long_] > j]] + s.pieces[long_[s.pieces[long_] > j]] - j
            weight = np.einsum("nkl,nl->nk", matrix[at], exit_[at]) @ model.move.T
            exit_[at - 1] = weight / weight.sum(axis=1, keepdims=True)
    return entry, earlier, exit_


def log_likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural logarithm of each sequence's probability: the scaled forward recursion, long sequences joined by matrix products."""
    s = cut(sequences)
    entry, _, _ = _borders(s, model, backward=False)
    out, ones = np.zeros(len(s.size)), np.ones(len(model.start))
    for group, running in _groups(s.size, np.arange(len(s.size))):
        at, _, emit = _emissions(s, model, group, running)
        now, total = entry[group], np.zeros(len(group))
        for t, n in enumerate(running):
            now[:n] = (now[:n] @ model.move if t else now) * emit[at[t]:at[t] + n]
            if t % RESCALE == RESCALE - 1:
                scale = now[:n] @ ones
                total[:n] += np.log(scale)
                now[:n] /= scale[:, None]
        out[group] = total + np.log(now @ ones)
    return np.bincount(s.text, out, len(sequences))


class Expected(NamedTuple):
    """Expected starts, moves and emissions, and the log-likelihood, of a set of sequences."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float


def expect(sequences: list[np.ndarray], model: Model) -> Expected:
    """Forward-backward over whole sequences; memory is bounded by the tokens of one group of segments."""
    k, ones = len(model.start), np.ones(len(model.start))
    s = cut(sequences)
    entry, earlier, exit_ = _borders(s, model, backward=True)
    start, move, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape[::-1]), 0.0
    for group, running in _groups(s.size, np.arange(len(s.size))):
        steps, size = len(running), s.size[group]
        at, token, emission = _emissions(s, model, group, running)
        alpha, scales = np.empty_like(emission), {}
        for t, n in enumerate(running):
            now = alpha[at[t]:at[t] + n]
            if t:
                np.matmul(alpha[at[t - 1]:at[t - 1] + n], model.move, out=now)
                now *= emission[at[t]:at[t] + n]
            else:
                np.multiply(entry[group], emission[:n], out=now)
            if t % RESCALE == RESCALE - 1:
                scales[t] = now @ ones
                now /= scales[t][:, None]
                log += float(np.log(scales[t]).sum())
        # weights behind the end, such that state probabilities sum to one at every step
        last = alpha[at[size - 1] + np.arange(len(group))]
        log += float(np.log(last @ ones).sum())
        beta = exit_[group] / np.einsum("nk,nk->n", last, exit_[group])[:, None]
        for t in range(steps - 1, -1, -1):
            n = running[t]
            behind = emission[at[t]:at[t] + n]
            behind *= beta[:n]
            if t in scales:
                behind /= scales[t][:, None]
            move += (alpha[at[t - 1]:at[t - 1] + n] if t else earlier[group]).T @ behind
            alpha[at[t]:at[t] + n] *= beta[:n]
            np.matmul(behind, model.move.T, out=beta[:n])
        start += alpha[:len(group)][s.number[group] == 0].sum(axis=0)
        for a in range(0, len(token), 1 << 15):
            for j in range(k):
                emit[j] += np.bincount(token[a:a + (1 << 15)], alpha[a:a + (1 << 15), j], len(model.emit))
    return Expected(start, move * model.move, emit.T, log)


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint16) for b in batch.column("states").to_pylist()]


def _expected(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task by slot: emissions of class c in slot c, moves from state i in -2 - i, starts in -1."""
    model: Model = sent.value
    k = len(model.start)
    start, move, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    for piece in pieces(batches, "states", 1_500_000):
        e = expect(_sequences(piece), model)
        start, move, log = start + e.start, move + e.move, log + e.log
        emit += e.emit
    seen = np.flatnonzero(emit.any(axis=1))
    slots = np.concatenate([[-1], -2 - np.arange(k), seen]).astype(np.int64)
    values = np.concatenate([start[None], move, emit[seen]])
    logs = np.zeros(len(slots))
    logs[0] = log
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(logs), *[pa.array(np.ascontiguousarray(values[:, j])) for j in range(k)]], ["slot", "log", *[f"s{j}" for j in range(k)]])


def _scores(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model: Model = sent.value
    for piece in pieces(batches, "states", 1_500_000):
        chain = log_likelihoods(_sequences(piece), model) / np.log(10)
        columns = [piece.column(c) for c in piece.schema.names if c != "states"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(chain)], [*[c for c in piece.schema.names if c != "states"], "chain"])


# -- jobs -----------------------------------------------------------------------------------------------------------------


def first_model(frequencies: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    """States that like to stay, each with the class frequencies tilted its own way."""
    rng = np.random.default_rng(seed)
    emit = frequencies[:, None] * rng.uniform(0.5, 1.5, (len(frequencies), states))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """The model that expected counts make likeliest; a floor keeps every probability above zero."""
    norm = lambda x, axis: (x + TINY) / (x + TINY).sum(axis=axis, keepdims=True)
    return Model(norm(start, 0), norm(move, 1), norm(emit, 0))


def smoothed(model: Model, frequencies: np.ndarray, share: float = MIXED) -> Model:
    """Leaves room for classes and moves that a state has not shown in training."""
    k = len(model.start)
    return Model((1 - share) * model.start + share / k, (1 - share) * model.move + share / k, (1 - share) * model.emit + share * frequencies[:, None])


def lexicon(counts: DataFrame) -> Lexicon:
    """The bounded side of a word count table (word, ending, n): shares decide, so it holds FREQUENT words at most."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = total[0] or 0, total[1]
    top = counts.where(F.col("n") * FREQUENT >= F.lit(tokens)).select("word", "ending", "n").toArrow()
    hashes = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, ending, n = hashes[order], top.column("ending").to_numpy()[order].astype(np.int64), top.column("n").to_numpy()[order]
    alone = n * OWN >= tokens
    own = int(alone.sum())
    classes = own + ending
    classes[alone] = np.arange(own)
    shared = counts.where(F.col("n") * OWN < F.lit(tokens)).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    totals, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in shared:
        totals[r["ending"]], kinds[r["ending"]] = r["n"], r["words"]
    return Lexicon(hashes, n, classes, own, totals, kinds, tokens, distinct)


def baum_welch(encoded: DataFrame, model: Model, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Model after `rounds` passes over all sequences of `encoded` (states), and the log-likelihood before each pass."""
    spark, k, logs = encoded.sparkSession, len(model.start), []
    kind = "slot long, log double, " + ", ".join(f"s{j} double" for j in range(k))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        summed = encoded.select("states").mapInArrow(partial(_expected, sent), kind).groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["log", *[f"s{j}" for j in range(k)]]])
        rows = summed.toArrow()  # one row a class and state
        slot = rows.column("slot").to_numpy()
        values = np.stack([rows.column(f"s{j}").to_numpy() for j in range(k)], axis=1)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
        emit[slot[slot >= 0]] = values[slot >= 0]
        move[-2 - slot[slot < -1]] = values[slot < -1]
        start = values[slot == -1].sum(axis=0) if (slot == -1).any() else start
        logs.append(float(rows.column("log").to_numpy().sum()))
        if not emit.any():
            break
        model = maximise(start, move, emit)
    return model, logs


def likelihoods(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row.

    Words are counted and states learnt over all rows where `held_out` is not true; a null counts as not held out. Null and
    empty texts have one token, their end. Repeated rows and null doc_ids are rows of their own, learnt from as often as they
    occur. Without training rows every word is unknown; an empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = stored(texts.where("not held_out").select("text").mapInArrow(_count, "word long, ending long, n long")
                    .groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")), "counts")
    known = lexicon(counts)
    encoded = stored(texts.mapInArrow(partial(_encode, spark.sparkContext.broadcast(known)), ENCODED), "encoded")
    frequencies = known.frequencies
    model, _ = baum_welch(encoded.where("not held_out"), first_model(frequencies, states), rounds)
    sent = spark.sparkContext.broadcast(smoothed(model, frequencies))
    plain = "row long, doc_id long, held_out boolean, n_tokens long, n_found long, base double, inner double"
    scored = encoded.select(*[c.split()[0] for c in plain.split(", ")], "states").mapInArrow(partial(_scores, sent), plain + ", chain double")
    rare = encoded.select("row", F.explode(F.arrays_zip("words", "tf")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.tf").alias("tf"))
    others = counts.where(F.col("n") * FREQUENT < F.lit(known.tokens)).select("word", "n")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    added = rare.join(others, "word", "left").groupBy("row").agg(F.sum(F.col("tf") * log).alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))).alias("n"))
    room = float(np.log10(known.tokens + SMOOTH * (known.words + 1)))
    joined = scored.join(added, "row", "left")
    log, more = F.coalesce("log", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_found") + more).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(room)).alias("base_score"), (F.col("chain") + F.col("inner") + log).alias("score"))
