"""The stages of the corpus pipeline, each against a brute-force version on its own input."""

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from echogrid.llm import cotraining

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def _docs(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 500, 100)]
        rows.append((k, " ".join(words), "en", "s", 0, "x"))
        if k % 5 == 0:
            rows.append((100 + k, " ".join(words[:50] + ["other"] + words[51:]), "en", "s", 0, "x"))
        if k % 10 == 0:
            rows.append((200 + k, " ".join(words), "en", "s", 0, None))
    rows += [(500, None, None, None, None, None), (501, "", None, None, None, None), (None, rows[0][1], None, None, None, None), (0, rows[0][1], "en", "s", 0, "x")]
    return rows, spark.createDataFrame(rows, DOCS)


def grams(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_heads(rows):
    """Rows that stay, by all pairs of distinct (doc_id, text); rows without id or words stay as they are."""
    alone = [r for r in rows if r[0] is None or not grams(r[1])]
    nodes = sorted({(r[0], r[1]) for r in rows if r[0] is not None and grams(r[1])})
    sets, head = [grams(t) for _, t in nodes], list(range(len(nodes)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                head[b] = a
    first = {}
    for i, (d, _) in enumerate(nodes):
        first[root(i)] = min(first.get(root(i), d), d)
    return alone, nodes, [root(i) for i in range(len(nodes))], first


def test_near_copies_keeps_one_of_each_group(spark):
    rows, docs = _docs(spark)
    alone, nodes, group, first = near_heads(rows)
    out = pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    kept = [g for g in got if g[0] is not None and grams(g[1])]
    at = {n: group[i] for i, n in enumerate(nodes)}
    assert sorted(at[k] for k in kept) == sorted(first) and all(k[0] == first[at[k]] for k in kept)
    assert sorted(map(str, [g for g in got if g not in kept])) == sorted(str((r[0], r[1])) for r in alone)


def test_near_copies_of_shared_ids_and_clashing_names(spark):
    a, b, c = (" ".join(f"{p}{k}" for k in range(60)) for p in "abc")
    rows = [(5, a), (5, b), (9, a + " more"), (3, b + " more"), (7, c), (7, c), (-2, c + " x"), (8, None), (8, ""), (None, a)]
    kind = "doc_id int, text string, __n int, node int, of_doc int, sha int, low int, number int, component_id int"
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4, 5, 6, 7) for d, t in rows], kind)
    out = pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(5, a), (3, b + " more"), (-2, c + " x"), (8, None), (8, ""), (None, a)], key=str)
    assert pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def folder(spark, tmp_path, rows, labels, bench):
    path = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def corpus():
    """Rude, tabular, copied, contaminated and private documents among clean ones."""
    rng = np.random.default_rng(21)
    passage = " ".join(f"p{k}" for k in range(30))
    rows, labels = [], []
    for k in range(400):
        words = [f"w{x}" for x in rng.integers(0, 3000, 80)]
        if k % 4 == 1:
            words[10] = words[40] = "scoundrel"
        if k % 40 == 3:
            words[20:20] = passage.split()
        if k % 20 == 7:
            words[5:5] = ["mail", f"someone{k}@example.org", "now"]
        rows.append((k, (" | " if k % 4 == 2 else " ").join(words), "en", f"s{k % 3}", None, "x"))
        if k % 5:
            labels.append((k, int(k % 4 != 2), int(k % 4 == 1)))
    rows += [(500 + k, rows[k][1] + " tail", "en", "s", None, None) for k in range(0, 400, 16)] + [(900, None, None, None, None, None), (901, "", None, None, 0, None)]
    return rows, labels, [(1, passage), (2, None), (3, "other words " * 20)]


def scored(views, r):
    """Posterior of one document, alone."""
    _, bucket = cotraining.content_features(cotraining.words([r[1] or ""], cotraining.LETTERS))
    content = views.intercepts[0] + sum(views.content[list(views.used).index(b)] for b in set(bucket.tolist()) & set(views.used.tolist()))
    page = views.intercepts[1] + cotraining.page_features([r[1] or ""], [r[4]], [r[2]], [r[3]]) @ views.page
    return float(views.odds(np.array([content]), page)[2][0])


def contaminated(text, bench):
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i:i + 13]) for _, t in bench for w in [words(t)] for i in range(max(len(w) - 12, min(len(w), 1)))}
    w, hit = words(text), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_every_stage_and_run_equal_brute_force(spark, tmp_path):
    rows, labels, bench = corpus()
    path = folder(spark, tmp_path, rows, labels, bench)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    views = cotraining.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    good = pipeline.quality(spark, docs, path)
    assert good.columns == docs.columns
    want = [r for r in rows if scored(views, r) >= cotraining.THRESHOLD]
    assert sorted(map(str, map(tuple, good.collect()))) == sorted(map(str, want))
    clean = [r for r in rows if r[0] < 400 and r[0] % 4 in (0, 3)]
    assert len({r[0] for r in clean} & {r[0] for r in want}) >= 0.97 * len(clean) and not any(r[0] % 4 == 2 for r in want if r[0] < 400)

    free = pipeline.benchmark_free(spark, docs, path)
    assert sorted(r.doc_id for r in free.collect()) == sorted(r[0] for r in rows if not contaminated(r[1], bench)) and free.columns == docs.columns
    assert sum(contaminated(r[1], bench) for r in rows) >= 10

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = spark.createDataFrame([r for r in rows if r[0] % 9 == 0 or r[0] >= 900], DOCS)
    tokens_match(pipeline.packed(spark, some, path).collect(), [(r[0], r[1]) for r in rows if r[0] % 9 == 0 or r[0] >= 900], tokenizer)

    alone, nodes, group, first = near_heads([r for r in rows if scored(views, r) >= cotraining.THRESHOLD])
    heads = {nodes[i][0] for i in range(len(nodes)) if nodes[i][0] == first[group[i]]} | {r[0] for r in alone}
    left = [r for r in rows if r[0] in heads and not contaminated(r[1], bench)]
    texts = {r.doc_id: r.text for r in pipeline.private(spark, spark.createDataFrame(left, DOCS), path).collect()}
    assert not any("@example.org" in (t or "") for t in texts.values())
    got = pipeline.run(spark, path).collect()
    assert {p.doc_id for p in got} == {r[0] for r in left}
    tokens_match(got, [(d, re.sub(r"\S+@\S+", "[EMAIL]", {r[0]: r[1] for r in left}[d] or "")) for d in texts], tokenizer)


def tokens_match(got, docs, tokenizer):
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    covered, sequences = {d: [] for d in ids}, {}
    for p in got:
        assert zlib.crc32(np.array(ids[p.doc_id][p.start:p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id].append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans, end in [(covered[d], len(ids[d])) for d in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == end if end is not None else at <= 2048


def test_run_over_empty_tables(spark, tmp_path):
    assert pipeline.run(spark, folder(spark, tmp_path, [], [], [])).count() == 0


def test_private_stage_keeps_rows_and_columns(spark):
    rows = [(1, "mail a@b.org now", "en", "s", 16, "x"), (2, None, None, None, None, None)]
    out = pipeline.private(spark, spark.createDataFrame(rows, DOCS), "")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert got[1].text == "mail [EMAIL] now" and got[1].n_chars == 16 and got[2].text is None


def test_counting_holds_few_copies_of_the_hashes():
    import tracemalloc
    import zlib

    from echogrid.llm import jaccard

    hashes = np.random.default_rng(1).integers(0, 2**63, 1_000_000).astype(np.uint64)
    hashes[::2] = hashes[0]
    value, count = np.unique(hashes >> jaccard.COUNT_BITS, return_counts=True)
    size = hashes.nbytes
    tracemalloc.start()
    rows = list(jaccard._count_rows(64, hashes))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * size, most / size
    assert np.array_equal(np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(r[1]), np.uint64)) for r in rows]), value)
    assert np.array_equal(np.concatenate([np.frombuffer(zlib.decompress(r[2]), np.uint32) for r in rows]), count)


def test_batches_of_long_texts_are_bounded(spark, tmp_path):
    import pyarrow as pa

    from echogrid.llm.tables import BATCH_BYTES, table

    spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    found = table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 300 and max(r.size for r in found) <= 3 * BATCH_BYTES
