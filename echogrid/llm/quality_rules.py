"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echogrid.llm.tables import pieces, stored, strings
from echogrid.llm.words import NOT_SPACE, mix, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_stops", "n_letters", "n_bare", "n_odd_ends")
THRESHOLD = 0.5
ROUNDS = 50
#: Prior rates of (drop, abstain, keep) votes for bad and for good texts, and the share of all texts the prior weighs.
PRIOR_RATES = ((0.3, 0.2, 0.5), (0.005, 0.045, 0.95))
PRIOR_SHARE = 0.02


def rules() -> dict[str, Column]:
    """Each rule votes 1 (keep), -1 (drop) or 0 (abstains)."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    mean_word, symbols, repeats = per_word("word_chars"), per_word("n_symbols"), per_word("n_repeat_words")
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    shouts, stops, bare, odd = per_word("n_shouts"), per_word("n_stops"), per_word("n_bare"), per_word("n_odd_ends")
    letters = F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "word_length": vote(mean_word, mean_word.between(3, 9), (mean_word < 2) | (mean_word > 14)),
        "symbols": vote(symbols, symbols < 0.1, symbols > 0.3),
        "repeats": vote(repeats, repeats < 0.2, repeats > 0.4),
        "dup_lines": vote(lines, lines < 0.2, lines > 0.4),
        "upper": vote(upper, upper < 0.1, upper > 0.4),
        "shouting": vote(shouts, shouts < 0.1, shouts > 0.5),
        "sentences": vote(stops, stops.between(0.01, 0.5), stops < 0.001),
        "letters": vote(letters, letters > 0.85, letters < 0.75),
        "bare_words": vote(bare, bare < 0.1, bare > 0.3),
        "word_ends": vote(odd, odd < 0.1, odd > 0.3),
        "length": vote(F.col("n_words"), F.col("n_words") >= 100, F.col("n_words") < 20),
    }


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
    stop = np.isin(np.arange(256), [ord(c) for c in ".!?:;"])
    usual = np.array([b >= 0x80 or chr(b).isalnum() or chr(b) in ".,;:!?)\"'" for b in range(256)])
    flat = (pa.RecordBatch.from_arrays([b.column("row"), b.column("row").field("text")], ["row", "text"]) for b in batches)
    for piece in pieces(flat, "text"):
        texts = strings(piece, "text")
        w = words(texts, NOT_SPACE, lower=False)
        n, owner, first = len(texts), w.owner, w.first
        lead = (w.bytes & 0xC0) != 0x80
        # 3-word windows found twice or more in their text, spread over the words they cover
        at = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
        gram = mix(mix(mix(w.hashes[at]) + w.hashes[at + 1]) + w.hashes[at + 2])
        order = np.lexsort((gram, owner[at]))
        same = np.zeros(len(order) + 1, dtype=bool)
        same[1:-1] = (gram[order][1:] == gram[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
        twice = at[order[same[1:] | same[:-1]]]
        covered = np.zeros(len(owner), dtype=bool)
        for j in range(3):
            covered[twice + j] = True
        dup_lines, n_lines = [], []
        for text in texts:
            seen, dup, count = set(), 0, 0
            for line in text.split("\n"):
                if not line.strip(" \t\n\r\x0b\x0c"):
                    continue
                count += 1
                dup += line in seen
                seen.add(line)
            dup_lines.append(dup)
            n_lines.append(count)
        letter = lead & ((w.bytes >= 0x80) | (w.bytes >= 0x41) & (w.bytes <= 0x5A) | (w.bytes >= 0x61) & (w.bytes <= 0x7A))
        so_far = np.concatenate([[0], np.cumsum(letter)])
        bare = so_far[w.ends] == so_far[w.starts]
        last = w.bytes[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
        values = {
            "n_words": w.counts, "word_chars": _per_text(lead & NOT_SPACE[w.bytes], first), "n_symbols": _per_text(symbol[w.bytes], first),
            "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(owner[covered], minlength=n), "n_lines": n_lines,
            "n_upper": _per_text((w.bytes >= 0x41) & (w.bytes <= 0x5A), first), "n_shouts": np.bincount(owner[last == ord("!")], minlength=n),
            "n_stops": np.bincount(owner[stop[last]], minlength=n), "n_letters": _per_text(letter, first), "n_bare": np.bincount(owner[bare], minlength=n),
            "n_odd_ends": np.bincount(owner[~usual[last]], minlength=n)}
        yield pa.RecordBatch.from_arrays([piece.column("row"), *(pa.array(np.asarray(values[c], dtype=np.int64)) for c in COUNTS)], ["row", *COUNTS])


def features(docs: DataFrame) -> DataFrame:
    """Every row of `docs` as `row`, with the counts of its whole text."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(_features, T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def fit(votes: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, dict]:
    """Posterior probability of good quality for each vote pattern, and the estimated parameters.

    Two-class model with votes independent given the class. Every rule has its own rate of keep, drop and abstain votes in
    either class. Rules are taken to be better than chance: a prior worth PRIOR_SHARE of all texts says that good texts rarely
    get a drop vote. The start calls a text bad when any rule says drop, which also settles which class is the good one.
    """
    n_rules = votes.shape[1]
    keep, drop = (votes == 1).sum(axis=1), (votes == -1).sum(axis=1)
    good = np.where(drop > 0, 0.1, np.where(keep > 0, 0.95, 0.5))
    belief = PRIOR_SHARE * weight.sum() * np.array(PRIOR_RATES)[:, None, :] + 1.0
    kinds = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior, rates = 0.5, np.zeros((2, n_rules, 3))
    for _ in range(rounds):
        for side, share in enumerate((1 - good, good)):
            mass = np.einsum("p,prk->rk", weight * share, kinds) + belief[side]
            rates[side] = mass / mass.sum(axis=1, keepdims=True)
        prior = float((weight @ good + 1) / (weight.sum() + 2))
        score = np.log(prior / (1 - prior)) + np.einsum("prk,rk->p", kinds, np.log(rates[1]) - np.log(rates[0]))
        good = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    voted = 1 - rates[:, :, 1]
    accuracy = prior * rates[1, :, 2] / voted[1] + (1 - prior) * rates[0, :, 0] / voted[0]
    return good, {"prior": prior, "accuracy": accuracy}


def judged(docs: DataFrame, threshold: float = THRESHOLD, voters: dict[str, Column] | None = None) -> DataFrame:
    """Every row of `docs` as `row`, its counts, base_failed, quality (posterior) and kept.

    Votes of all documents are counted by pattern; at most 3 ** rules patterns reach the driver. Null, empty and blank texts
    have no words, so no rule votes and the base test fails them. An empty table gives no rows.
    """
    voters = voters or rules()
    names = list(voters)
    code = reduce(lambda a, b: a * 3 + b + 1, (voters[n] for n in names), F.lit(0))
    counted = stored(features(docs).withColumn("pattern", code.cast("long")), "counts")
    found = counted.groupBy("pattern").count().collect()
    patterns = np.array([r["pattern"] for r in found], dtype=np.int64)
    votes = np.stack([patterns // 3 ** (len(names) - 1 - k) % 3 - 1 for k in range(len(names))], axis=1) if found else np.zeros((0, len(names)), np.int64)
    quality, _ = fit(votes, np.array([r["count"] for r in found], dtype=float))
    posterior = docs.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, quality, strict=True)], "pattern long, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    # bounded: 3 ** rules rows
    return counted.join(F.broadcast(posterior), "pattern").withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("pattern")


def quality_report(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("p_good"))
