"""Token ids of public tokenizers, and token counts from pre-token frequencies."""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.tables import pieces, stored, strings

#: Characters on which the two libraries split texts alike; texts with others go through the first library.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ʯͰ-ͷΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞€]*")


class Encoder:
    """Ids of a `tokenizers` file as that library gives them, special strings in texts included.

    `fast` names a rank file of the same vocabulary; texts of common characters are then encoded from the ranks, which gives
    the same ids in a quarter of the time. Other texts use the first library.
    """

    def __init__(self, path: str, fast: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        added = {t.content: n for n, t in self.slow.get_added_tokens_decoder().items()}
        self.special, self.ranks = added, None
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        if fast:
            import public_tokenizers
            import tiktoken

            with open(fast, "rb") as file:
                ranks = {base64.b64decode(token): int(n) for token, n in map(bytes.split, file)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.ranks is None or not COMMON.fullmatch(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        if self.split is None or not self.split.search(text):
            return self.ranks.encode_ordinary(text)
        out: list[int] = []
        for part in self.split.split(text):
            out += [self.special[part]] if part in self.special else self.ranks.encode_ordinary(part)
        return out


# -- counts --------------------------------------------------------------------------------------------------------------

SPACE_MARK = "▁"
#: Runs of spaces with the word behind them, or a line feed: no piece of the vocabulary reaches over such a border.
PRE_TOKEN = re.compile(f"\n|[ {SPACE_MARK}]*[^ {SPACE_MARK}\n]+|[ {SPACE_MARK}]+")
#: A pre-token is frequent when it is at least one in so many of all pre-tokens, so there are at most so many of them.
FREQUENT = 1 << 20
#: Rows held to be sorted together: the longer the run, the more neighbours share and the smaller the shuffle.
RUN, RUN_CHARS = 300_000, 8_000_000
LIMIT = 4096


def _pre_tokens(text: str) -> Counter:
    """Pre-tokens of a text behind the space that the library puts first; an empty text has none."""
    return Counter(PRE_TOKEN.findall(" " + text)) if text else Counter()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush():
        rows = sorted(held.items())  # neighbours share their beginnings, so the shuffle compresses
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["token", "freq"])

    for piece in pieces(batches, "text"):
        for text in strings(piece, "text"):
            held.update(_pre_tokens(text))
        if len(held) > 800_000:
            yield flush()
            held.clear()
    yield flush()


@lru_cache(1)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each distinct pre-token. A line feed before it keeps the library's own leading space apart."""
    processor = _processor(path)
    apart = len(processor.encode("\n"))
    for batch in batches:
        for piece in pieces([batch], "token", 1_000_000):
            n = [len(ids) - apart for ids in processor.encode(["\n" + t for t in strings(piece, "token")], num_threads=1)]
            yield pa.RecordBatch.from_arrays([piece.column("token"), piece.column("freq"), pa.array(n, pa.int64())], ["token", "freq", "n"])


def _spread(frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document one row with the sum over frequent pre-tokens, and one per rare pre-token with its frequency.

    The document row has its id and size for a token, behind a line feed: no pre-token looks like that, so it meets no join
    partner, goes to a task of its own hash, and the rows need no further columns.
    """
    from pyspark import TaskContext

    known: dict[str, int] = frequent.value
    row = TaskContext.get().partitionId() << 40
    out: list[tuple[str, int, int]] = []

    def flush() -> pa.RecordBatch:
        out.sort()
        batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in out], pa.int64()), pa.array([r[0] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], ["row", "token", "freq"])
        out.clear()
        return batch

    size = 0
    for piece in pieces(batches, "text"):
        for doc_id, raw in zip(piece.column("doc_id").to_pylist(), strings(piece, "text"), strict=True):
            row += 1
            total = 0
            for token, n in _pre_tokens(raw).items():
                if (each := known.get(token)) is None:
                    out.append((token, row, n))
                    size += len(token)
                else:
                    total += n * each
            out.append((f"\n{'' if doc_id is None else doc_id}\n{len(raw.encode())}", row, total))
            if len(out) > RUN or size > RUN_CHARS:
                yield flush()
                size = 0
    if out:
        yield flush()


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, token ids never being kept.

    Pre-tokens are counted over all texts, and each distinct one is encoded once. Frequent ones (a share of 1 / `frequent` of
    all, hence at most `frequent` of them) are summed where the text is read; rare ones are joined by pre-token, where no key
    can be hot, and added up per row. Null and empty texts have no tokens. Repeated rows and null doc_ids stay rows of their
    own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    distinct = texts.select("text").mapInArrow(_frequencies, "token string, freq long").groupBy("token").agg(F.sum("freq").alias("freq"))
    counted = stored(distinct.mapInArrow(partial(_count, model), "token string, freq long, n long"), "counted")
    total = counted.agg(F.sum("freq")).first()[0] or 0
    top = F.col("freq") * frequent >= F.lit(total)
    sums = counted.where(top).select("token", "n").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(sums.column("token").to_pylist(), sums.column("n").to_pylist(), strict=True)))
    rows = texts.mapInArrow(partial(_spread, known), "row long, token string, freq long")
    joined = rows.join(counted.where(~top).select("token", "n"), "token", "left")
    head = F.max(F.when(F.col("token").startswith("\n") & (F.col("token") != "\n"), F.col("token"))).alias("head")
    summed = joined.groupBy("row").agg(head, F.sum(F.col("freq") * F.coalesce("n", F.lit(1))).alias("n_tokens"))
    part = lambda k: F.get(F.split("head", "\n"), F.lit(k)).cast("long")
    return summed.select(
        F.when(F.get(F.split("head", "\n"), F.lit(1)) != "", part(1)).alias("doc_id"), part(2).alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
