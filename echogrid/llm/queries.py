"""Registered queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from echogrid.llm.tables import table
from echogrid.registry import query


@query("op1_ngram_jaccard_join", sql=r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.g) + len(y.g) - n)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.c FROM r JOIN u ON r.doc_id = u.a) SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, r.c AS component_id FROM s JOIN r USING (doc_id)
""")
def op1_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    from echogrid.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3_packing(spark, sf_dir):
    """All documents in sequences of 2048 token ids; no SQL form, tested by round trip."""
    import public_tokenizers

    from echogrid.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op4_benchmark_decontamination", sql=r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, g.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.k = g.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
""")
def op4_benchmark_decontamination(spark, sf_dir):
    """Benchmark passages inside documents, found by suffix arrays."""
    from echogrid.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    """Token counts of all documents; no SQL form, tested against the library on whole texts."""
    import public_tokenizers

    from echogrid.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    """Counts, base test and weak-supervision verdict of all documents; the verdict has no SQL form."""
    from echogrid.llm.quality_rules import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    """Language of all documents; no SQL form, tested by held-out accuracy."""
    from echogrid.llm.language import language_report

    return language_report(table(spark, sf_dir, "documents"))


@query("op8_chat_formatting", sql=r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([\\<\[])', '\\\1', 'g') AS body, regexp_replace(role, '([\\<\[])', '\\\1', 'g') AS mark FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE role WHEN 'assistant' THEN 5 WHEN 'user' THEN 15 ELSE 16 + length(mark) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op8_chat_formatting(spark, sf_dir):
    """All conversations and one whose texts imitate the template, formatted and read back."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from echogrid.llm.chat import chat_report

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    return chat_report(turns, public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_pii")
def op9_pii(spark, sf_dir):
    """Personal data in all documents; the added spans have no SQL form, the base is tested by brute force."""
    from echogrid.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6_html_extraction(spark, sf_dir):
    """Main text of all pages; no SQL form, tested on pages of known articles."""
    from echogrid.llm.extract import extracted

    return extracted(table(spark, sf_dir, "pages"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    """Co-trained quality of all documents; no SQL form, tested by held-out accuracy."""
    from pyspark.sql import functions as F

    from echogrid.llm.cotraining import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        F.col("row.doc_id").alias("doc_id"), F.round("content_odds", 4).alias("content_odds"), F.round("page_odds", 4).alias("page_odds"), F.round("score", 6).alias("score"), "kept")


@query("op12_merkle_manifest", sql=r"""
WITH RECURSIVE f AS (SELECT doc_id, source, text,
    [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS v,
    [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), replace(text, chr(10), '')] AS u,
    xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_concat([ord(ch)::UBIGINT], list_transform(range(8), lambda i: 1000::UBIGINT))))),
      lambda c, x: CASE WHEN x < 1000 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT)) END), 4294967295::UBIGINT) AS crc FROM documents),
h AS (SELECT doc_id, source, crc, array_to_string(list_transform(v, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '') AS a,
    array_to_string(list_transform(u, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '') AS b FROM f),
d AS (SELECT doc_id, source, sha256(a) AS leaf, CASE WHEN crc % 2 = 0 THEN sha256(b) ELSE sha256(a) END AS claimed FROM h),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM d),
n(lvl, source, pos, digest, total) AS (SELECT 0, source, pos, leaf, total FROM l
  UNION ALL SELECT lvl + 1, source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (total + 2) // 3 FROM n WHERE total > 1 GROUP BY lvl, source, pos // 3, total),
b AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM n WHERE total = 1),
m(lvl, pos, digest, total) AS (SELECT 0, pos, subroot, total FROM b
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (total + 2) // 3 FROM m WHERE total > 1 GROUP BY lvl, pos // 3, total),
s AS (SELECT x.lvl, x.source, x.pos, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS lo, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS hi
  FROM n x JOIN n y ON x.lvl = y.lvl AND x.source IS NOT DISTINCT FROM y.source AND x.pos // 3 = y.pos // 3 WHERE x.total > 1 GROUP BY ALL),
t AS (SELECT x.lvl, x.pos, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS lo, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS hi
  FROM m x JOIN m y ON x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.total > 1 GROUP BY ALL),
p(lvl, source, start, pos, total, proof, node) AS (SELECT 0, source, pos, pos, total, '', claimed FROM l
  UNION ALL SELECT p.lvl + 1, p.source, p.start, p.pos // 3, (p.total + 2) // 3, p.proof || s.lo || s.hi, sha256(s.lo || p.node || s.hi)
  FROM p JOIN s ON p.lvl = s.lvl AND p.source IS NOT DISTINCT FROM s.source AND p.pos = s.pos),
q(lvl, source, start, pos, total, proof, node) AS (SELECT 0, p.source, p.start, b.pos, b.total, p.proof, p.node FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source WHERE p.total = 1
  UNION ALL SELECT q.lvl + 1, q.source, q.start, q.pos // 3, (q.total + 2) // 3, q.proof || t.lo || t.hi, sha256(t.lo || q.node || t.hi) FROM q JOIN t ON q.lvl = t.lvl AND q.pos = t.pos),
r AS (SELECT digest AS root FROM m WHERE total = 1)
SELECT l.doc_id, l.leaf, b.subroot, r.root, sha256(q.proof) AS proof_sha256, q.node AS folded_root, q.node = r.root AS verified
FROM l JOIN b ON l.source IS NOT DISTINCT FROM b.source JOIN q ON q.total = 1 AND q.source IS NOT DISTINCT FROM l.source AND q.start = l.pos, r
""")
def op12_merkle_manifest(spark, sf_dir):
    """Proofs of all documents in the corpus tree, refolded from texts of which half lost their line feeds."""
    from pyspark.sql import functions as F

    from echogrid.llm.merkle import folded, manifest

    doc_id = F.col("doc_id").cast("string")
    text = F.when(F.crc32(doc_id) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return folded(manifest(table(spark, sf_dir, "documents"), [doc_id, F.col("source"), F.col("lang"), F.col("n_chars"), text]))


@query("op13_ranked_search", sql=r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT * FROM d WHERE len(w) > 0),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
i AS (SELECT item_id, term, count(*) AS repeats FROM b GROUP BY ALL),
g AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM k),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM k) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM t, g GROUP BY term, docs),
m AS (SELECT doc_id, row, 25 + (75 * len(w) * docs) // terms AS m FROM k, g),
s AS (SELECT item_id, doc_id, row, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN t USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""")
def op13_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item, from all documents."""
    from echogrid.llm.lexical import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_lm_scoring")
def op11_lm_scoring(spark, sf_dir):
    """Hidden Markov likelihood of all documents; no SQL form, the base and the recursion are tested by brute force."""
    from pyspark.sql import functions as F

    from echogrid.llm.hmm import likelihoods

    return likelihoods(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
