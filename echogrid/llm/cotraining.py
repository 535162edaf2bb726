"""Quality classifier by co-training: a view of the words and a view of the page's metadata and layout teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.tables import pieces, stored, strings
from echogrid.llm.words import NOT_SPACE, Words, mix, words

DIMENSIONS = 1 << 17
#: Word beginnings of these many bytes are content features beside the words.
PREFIXES = (5, 7)
#: A content feature is used when its rates in good and bad labelled documents differ by so many standard errors and by this
#: factor: with many labels every word differs a little, and what is used must not depend on their number.
CLEAR, FACTOR = 4.0, 2.0
#: Labelled rows of the fit, by hash order, as many of either class as there are up to a half. Features are counted over all
#: labelled documents, and the views label all unlabelled ones for each other.
LABELLED = 12_000
ROUNDS = 2
#: Weight of a document labelled by a view; all of them together weigh at most this share of the labelled ones.
TAUGHT = 0.2
CONFIDENT = 0.97
#: Documents whose posterior probability of being good is below this go.
THRESHOLD = 0.5
LANGS, SOURCES = 8, 32
#: Bytes of text that a task turns into features at once.
PIECE = 1_000_000
LAYOUT = ("log_chars", "no_chars", "word_chars", "symbols", "upper", "shouts", "lines", "repeats", "pipes", "digits")
PAGE = len(LAYOUT) + LANGS + SOURCES
# Words of the content view: runs of letters and digits.
LETTERS = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
BYTE_CLASSES = {"symbols": b"#*$%&<>@|", "upper": bytes(range(0x41, 0x5B)), "shouts": b"!?", "lines": b"\n", "pipes": b"|", "digits": b"0123456789"}


class Views(NamedTuple):
    """Weights of both views by feature, their intercepts, the content buckets in use, and the calibration of each and of the sum."""

    used: np.ndarray
    content: np.ndarray
    page: np.ndarray
    intercepts: tuple[float, float]
    calibration: tuple[tuple[float, float], ...] = ((1.0, 0.0), (1.0, 0.0), (1.0, 0.0))
    prior: float = 0.0

    def odds(self, content: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views, and the probability of a good document from their calibrated sum."""
        both = [np.clip(raw, -30, 30) * slope + shift for raw, (slope, shift) in zip((content, page), self.calibration, strict=False)]
        slope, shift = self.calibration[2]
        return both[0], both[1], 1 / (1 + np.exp(-np.clip((both[0] + both[1] - self.prior) * slope + shift, -30, 30)))


def content_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and of the beginnings of longer ones, repeats included."""
    padded = np.concatenate([w.bytes, np.zeros(8, dtype=np.uint8)])
    ahead = np.ndarray((len(w.bytes),), dtype="<u8", buffer=padded, strides=(1,))[w.starts]
    size, owner = w.ends - w.starts, w.owner
    long_ = size > 3
    hashes, owners = [w.hashes], [owner]
    for k in PREFIXES:
        kept = (np.uint64(1) << (np.minimum(size[long_], k).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        hashes.append(mix((ahead[long_] & kept) + np.uint64(k << 58)))
        owners.append(owner[long_])
    return np.concatenate(owners), (np.concatenate(hashes) % np.uint64(DIMENSIONS)).astype(np.int64)


def _distinct(owner: np.ndarray, value: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, in order, by a table of marks for some texts at a time."""
    order = np.argsort(owner, kind="stable")
    owner, value = owner[order], value[order]
    at, step, out = np.searchsorted(owner, np.arange(n + 1)), max(1, (1 << 23) // max(size, 1)), []
    for a in range(0, n, step):
        b = min(a + step, n)
        marks = np.zeros((b - a) * size, dtype=bool)
        marks[(owner[at[a]:at[b]] - a) * size + value[at[a]:at[b]]] = True
        out.append(np.flatnonzero(marks) + a * size)
    key = np.concatenate(out) if out else np.zeros(0, np.int64)
    return key // max(size, 1), key % max(size, 1)


def page_features(texts: list[str], n_chars: list[int | None], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    """Size, language, source and layout of each page; no word takes part."""
    n = len(texts)
    w = words(texts, NOT_SPACE, lower=False)
    chars = np.maximum(np.array([len(t) for t in texts], dtype=float), 1)
    said = np.array([c if k is None else k for k, c in zip(n_chars, chars, strict=True)], dtype=float)
    count = np.maximum(w.counts, 1)
    owner, _ = _distinct(w.owner, (w.hashes % np.uint64(1 << 13)).astype(np.int64), n, 1 << 13)
    share = {}
    for name, members in BYTE_CLASSES.items():
        table = np.zeros(256, dtype=np.int64)
        table[list(members)] = 1
        share[name] = np.add.reduceat(table[w.bytes], w.first[:-1]) / chars if n else np.zeros(0)
    out = np.zeros((n, PAGE))
    out[:, :len(LAYOUT)] = np.stack([
        np.log1p(np.maximum(said, 0)), [k is None for k in n_chars], np.minimum(chars / count, 40), share["symbols"], share["upper"], share["shouts"],
        np.log1p(1e4 * share["lines"]), 1 - np.bincount(owner, minlength=n) / np.minimum(count, 1 << 13), share["pipes"], share["digits"]], axis=1)
    bucket = lambda value, size: 0 if value is None else 1 + zlib.crc32(value.encode("utf-8", "surrogatepass")) % (size - 1)
    at = np.arange(n)
    out[at, len(LAYOUT) + np.array([bucket(x, LANGS) for x in langs], dtype=int)] = 1
    out[at, len(LAYOUT) + LANGS + np.array([bucket(x, SOURCES) for x in sources], dtype=int)] = 1
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for a join that shuffles them."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in strings(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents of a task that hold each content bucket; bucket -1 counts the documents."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    total = np.zeros((2, DIMENSIONS), dtype=np.int64)
    seen = np.zeros(2, dtype=np.int64)
    for piece in pieces(batches, "packed", PIECE // 2):
        label = piece.column("label").to_numpy().astype(np.int64)
        texts = [unpacker.decompress(b).decode("utf-8", "surrogatepass") for b in piece.column("packed").to_pylist()]
        owner, bucket = _distinct(*content_features(words(texts, LETTERS)), piece.num_rows, DIMENSIONS)
        total += np.bincount(label[owner] * DIMENSIONS + bucket, minlength=2 * DIMENSIONS).reshape(2, DIMENSIONS)
        seen += np.bincount(label, minlength=2)
    some = np.flatnonzero(total.any(axis=0))
    columns = [np.append(some, -1), np.append(total[1, some], seen[1]), np.append(total[0, some], seen[0])]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["bucket", "good", "bad"])


def _clear(piece: pa.RecordBatch, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the used bucket) of each distinct clear feature."""
    owner, bucket = content_features(words(strings(piece, "text"), LETTERS))
    place = np.full(DIMENSIONS, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    number = place[bucket]
    key = np.unique(owner[number >= 0] * max(len(used), 1) + number[number >= 0])
    return key // max(len(used), 1), key % max(len(used), 1)


def _page(piece: pa.RecordBatch) -> np.ndarray:
    return page_features(strings(piece, "text"), *[piece.column(c).to_pylist() for c in ("n_chars", "lang", "source")])


def _viewed(used, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text", PIECE):
        row, number = _clear(piece, used.value)
        ends = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
        clear = pa.ListArray.from_arrays(pa.array(ends), pa.array(number.astype(str), pa.string()))
        page = _page(piece)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, page.size + 1, PAGE, dtype=np.int32)), pa.array(page.reshape(-1).astype(np.float32)))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), clear, flat], ["doc_id", "clear", "page"])


def _scored(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    views: Views = sent.value
    names = ["text", "n_chars", "lang", "source"]
    for piece in pieces(batches, "text", PIECE):
        row, number = _clear(piece, views.used)
        content = views.intercepts[0] + np.bincount(row, views.content[number], piece.num_rows)
        page = views.intercepts[1] + _page(piece) @ views.page
        odds = views.odds(content, page)
        keep = [c for c in piece.schema.names if c not in names]
        yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], *[pa.array(x) for x in odds]], [*keep, "content_odds", "page_odds", "score"])


def _read(docs: DataFrame, *others: str) -> DataFrame:
    """The columns that the views read, of fixed types."""
    return docs.select(*others, F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _lr(view: str, penalty: float) -> LogisticRegression:
    return LogisticRegression(featuresCol=view, labelCol="label", regParam=penalty, maxIter=25, weightCol="weight")


def _raw(model, view: str, df: DataFrame, name: str) -> DataFrame:
    out = model.setPredictionCol("").setProbabilityCol("").setRawPredictionCol("__raw").setFeaturesCol(view).transform(df)
    return out.withColumn(name, F.greatest(F.lit(-30.0), F.least(F.lit(30.0), vector_to_array("__raw")[1]))).drop("__raw")


def clear_features(labelled: DataFrame) -> np.ndarray:
    """Every content bucket whose presence separates the labels of `labelled` (packed, label 0 or 1); bucket 0 where none does."""
    counted = labelled.mapInArrow(_counted, "bucket long, good long, bad long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    bucket, good, bad = (counted.column(c).to_numpy() for c in ("bucket", "good", "bad"))
    n_good, n_bad = (max(int(x[bucket == -1].sum()), 1) for x in (good, bad))
    p = (good + bad + 1) / (n_good + n_bad + 2)
    z = np.abs(bad / n_bad - good / n_good) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_good + 1 / n_bad))
    apart = np.abs(np.log((good + 0.5) / (n_good + 1)) - np.log((bad + 0.5) / (n_bad + 1))) >= np.log(FACTOR)
    used = np.sort(bucket[(bucket >= 0) & (z >= CLEAR) & apart])
    return used if len(used) else np.zeros(1, dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Views | None:
    """Co-train on at most `labelled` labelled documents, drawn by hash and class, and on all unlabelled ones.

    A document is good when its quality is 1 and it is not toxic; labels with a null part are left out, of several labels of a
    document the worst counts. The drawn rows of a class weigh as all of it. A fifth of all labelled documents is kept for the
    calibration; the content features are counted over all others. In each round either view labels the unlabelled documents
    where it is confident, and the other view learns from these labels beside the true ones, at a lower weight. The calibrated
    log-odds of both views, less the prior that both contain, are added, and the sum is calibrated once more. None when the
    labels do not show both classes.
    """
    spark = docs.sparkSession
    good = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)).alias("label"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5))
    known = stored(docs.where("doc_id is not null").select("doc_id").distinct().join(good, "doc_id").withColumn("part", part), "known")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    half, total = labelled // 2, sum(n.values())
    quota = {k: max(min(v, max(half, labelled - (total - v))), 1) for k, v in n.items()}
    weight = {k: n[k] / quota[k] * sum(quota.values()) / total for k in n}
    draw = F.xxhash64("doc_id", F.lit(11))
    drawn = reduce(DataFrame.unionByName, [known.where(F.col("label") == k).orderBy(draw, "doc_id").limit(quota[k]).select("doc_id", F.lit(weight[k]).alias("weight")) for k in sorted(n)])
    marked = stored(known.join(drawn, "doc_id", "left"), "marked")
    # sort-merge joins at every size: what is shuffled then grows in proportion to the documents
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_packed, "doc_id long, packed binary")
    used = clear_features(texts.join(marked.where("part <> 0").select("doc_id", "label").hint("merge"), "doc_id").select("packed", F.col("label").cast("long").alias("label")))
    slim = _read(docs.where("doc_id is not null"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        partial(_viewed, spark.sparkContext.broadcast(used)), "doc_id long, clear array<string>, page array<float>")
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(used))], inputCol="clear", outputCol="content")
    vectors.setBinary(True).setMinTF(1.0)
    joined = slim.join(marked.hint("merge"), "doc_id", "left").where("label is null or weight is not null")
    viewed = stored(vectors.transform(joined).withColumn("page", array_to_vector(F.col("page").cast("array<double>"))).select("content", "page", "label", "weight", "part"), "views")
    true = viewed.where("weight is not null and part <> 0")
    if true.select("label").distinct().count() < 2:
        return None
    rest = viewed.where("label is null").drop("label", "weight")
    share = TAUGHT * min(1.0, true.count() / max(rest.count(), 1))
    learn = lambda more: (_lr("content", 0.003).fit(more[0]), _lr("page", 0.001).fit(more[1]))
    content, page = learn((true, true))
    for _ in range(rounds):
        said = _raw(page, "page", _raw(content, "content", rest, "content_odds"), "page_odds")
        taught = lambda name: said.where(1 / (1 + F.exp(-F.abs(F.col(name)))) >= CONFIDENT).withColumn(
            "label", (F.col(name) > 0).cast("double")).withColumn("weight", F.lit(share)).select(*true.columns)
        content, page = learn((true.unionByName(taught("page_odds")), true.unionByName(taught("content_odds"))))
    views = Views(used, content.coefficients.toArray(), page.coefficients.toArray(), (float(content.intercept), float(page.intercept)))
    held = _raw(page, "page", _raw(content, "content", viewed.where("weight is not null and part = 0"), "content_odds"), "page_odds").select("label", "weight", "content_odds", "page_odds")
    if held.select("label").distinct().count() < 2:
        return views
    held = stored(held, "held")
    prior = float(np.log(n[1.0] / n[0.0]))

    def calibrated(df: DataFrame, name: str) -> tuple[float, float]:
        m = _lr("odds", 0.001).fit(VectorAssembler(inputCols=[name], outputCol="odds").transform(df))
        return max(float(m.coefficients[0]), 0.1), float(m.intercept)

    single = tuple(calibrated(held, name) for name in ("content_odds", "page_odds"))
    total_odds = sum((F.col(name) * slope + shift for name, (slope, shift) in zip(("content_odds", "page_odds"), single, strict=True)), F.lit(-prior))
    return views._replace(calibration=(*single, calibrated(held.withColumn("sum_odds", total_odds), "sum_odds")), prior=prior)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of `docs` as `row`, with content_odds, page_odds, score (probability of a good document) and kept.

    Null and empty texts are scored like any other, null languages and sources are values of their own, a null n_chars is marked
    and counted. Without labels of both classes all rows are kept with score 1. Repeated rows and null doc_ids are scored, but
    only rows with a doc_id are learned from. An empty table gives no rows.
    """
    views = fit(docs, labels)
    if views is None:
        scored = docs.select(F.struct("*").alias("row"), F.lit(0.0).alias("content_odds"), F.lit(0.0).alias("page_odds"), F.lit(1.0).alias("score"))
    else:
        rows = _read(docs, F.struct("*").alias("row"))
        kind = rows.select("row", *[F.lit(0.0).alias(c) for c in ("content_odds", "page_odds", "score")]).schema
        scored = rows.mapInArrow(partial(_scored, docs.sparkSession.sparkContext.broadcast(views)), kind)
    return scored.withColumn("kept", F.col("score") >= threshold)
