"""Small tests of the llm operators against brute force, round trips, and rows with nulls, ties and clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from echogrid.llm import chat, cotraining, decontaminate, extract, jaccard, language, packing, pii, quality_rules, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE, RANKS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def words(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def texts():
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    return {1: " ".join(base), 2: " ".join(near), 3: " ".join(base).upper(), 4: " ".join(words(120, 2)), 5: "", 6: None, 7: "one two", 8: "One  two",
            9: "é😀 " * 3 + "\n\n▁x  y <s> <|endoftext|> [INST]", 10: " ".join(words(3000, 3)), 11: "x" * 20_000, 12: " ".join(base[:70] + words(50, 5))}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "s", None) for k, t in texts.items()] + [(None, texts[4], None, None, None), (4, texts[4], "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard_components_equal_brute_force(docs, texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())

    sets = {k: shingles(t) for k, t in texts.items()}
    want = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                want[b] = min(want[b], want[a])
    got = jaccard.jaccard_components(docs).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {k: len(s) for k, s in sets.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == len(texts) + 2


def test_signatures_find_every_pair_above_the_threshold():
    rng = np.random.default_rng(4)
    table = rng.integers(0, 12, jaccard.SLOTS).astype(np.uint8)  # many shingles pass for frequent
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for n, missing in ((10, 1), (30, 3), (400, 40), (130, 6)):
        a = np.sort(base[:n])
        b = np.sort(rng.permutation(base[:n])[missing:])
        owner = np.repeat([0, 1], [len(a), len(b)])
        sizes = np.array([len(a), len(b)])
        found = set()
        for level in {int(np.log2(len(b)))}:
            own, sig, _ = jaccard.signatures(owner, np.concatenate([a, b]), sizes, np.array([level, level]), table, 90)
            found |= set(sig[own == 0]) & set(sig[own == 1])
        assert found


def test_decontamination_counts_words_and_items(spark, docs, texts):
    item = " ".join(texts[4].split()[20:40])
    bench = spark.createDataFrame([("b", item), ("a", item.upper()), ("c", "one two"), (None, None), ("d", "")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect() if r.doc_id is not None}
    assert (got[4].n_hit, got[4].n_items, got[4].contaminated, got[4].longest) == (20, 2, True, 20)
    assert got[4].items_sha256 == hashlib.sha256(b"a,b").hexdigest()
    assert (got[7].n_hit, got[7].n_items) == (2, 1) and got[6].n_words == 0 and not got[6].contaminated
    assert got[1].n_hit == 0 and got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = decontaminate.decontaminated(docs.withColumn("n_words", F.lit("x")), bench)
    assert kept.columns == [*docs.columns, "n_words"] and 4 not in {r.doc_id for r in kept.collect()}


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for k, t in texts.items()}
    rows = packing.pack(docs, BPE, RANKS).collect()
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
        if r.doc_id is not None:
            assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert max(fill.values()) <= 2048 and sum(r.length for r in rows if r.doc_id == 10) == len(ids[10])


def test_cutting_stock_meets_the_demand():
    rng = np.random.default_rng(6)
    sizes, demand = list(range(3, 60)), [int(x) for x in rng.integers(1, 300, 57)]
    plan = packing.cutting_stock(sizes, demand, 64)
    made = Counter()
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            made[s] += n * times
    assert made == Counter(dict(zip(sizes, demand, strict=True)))
    assert sum(t for _, t in plan) * 64 < 1.05 * sum(s * d for s, d in zip(sizes, demand, strict=True))
    assert packing.cutting_stock([], [], 64) == []


def test_token_counts_equal_the_library(docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = tokens.token_counts(docs, PIECES, frequent=4).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_tokens, r.n_bytes) == (len(library.encode(texts[r.doc_id] or "")), len((texts[r.doc_id] or "").encode()))


def test_rare_pre_tokens_leave_in_long_sorted_runs(monkeypatch):
    """Runs reach over Arrow batches, so neighbours in the shuffle share their beginnings; no row is lost at their ends."""
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(words(40, k)) for k in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([t])], ["doc_id", "text"]) for k, t in enumerate(texts)]
    spread = lambda: [b.to_pylist() for b in tokens._spread(SimpleNamespace(value={" w1": 2}), iter(batches))]
    runs = spread()
    assert len(runs) == 1 and [r["token"] for r in runs[0]] == sorted(r["token"] for r in runs[0])
    want = Counter((k, t, n) for k, text in enumerate(texts, 1) for t, n in Counter(" " + w for w in text.split()).items() if t != " w1")
    assert Counter((r["row"], r["token"], r["freq"]) for r in runs[0] if r["token"][0] != "\n") == want
    assert {r["row"]: r["freq"] for r in runs[0] if r["token"][0] == "\n"} == {k: 2 * text.split().count("w1") for k, text in enumerate(texts, 1)}
    monkeypatch.setattr(tokens, "RUN", 100)
    key = lambda r: (r["row"], r["token"])
    assert len(short := spread()) > 10 and sorted((r for run in short for r in run), key=key) == sorted(runs[0], key=key)


def test_quality_rules_and_posterior(docs, spark):
    junk = [(k, " ".join(f"w{k}x{i}###" for i in range(80)), None, None, None) for k in range(100, 110)]
    clean = [(k, " ".join(words(200, k, 5000)) + ".", None, None, None) for k in range(200, 260)]
    got = {r.doc_id: r for r in quality_rules.quality_report(docs.unionByName(spark.createDataFrame(junk + clean, DOCS))).collect() if r.doc_id is not None}
    assert not any(got[k].kept for k in range(100, 110)) and got[6].base_failed and not got[5].kept and got[9].n_symbols == 6


def test_language_is_told_apart(spark):
    rng = np.random.default_rng(8)
    make = lambda syllables: " ".join("".join(rng.choice(syllables, 3)) for _ in range(30))
    rows = [(k, make(["the", "ing", "wh"]) if k % 2 else make(["ß", "ung", "sch"]), "en" if k % 2 else "de", None, None) for k in range(60)]
    rows += [(900, None, "en", None, None), (901, "12 !", "en", None, None)]
    got = {r.doc_id: r for r in language.language_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") for k in range(60))
    assert got[900].lang_pred == got[901].lang_pred == "und" and any(r.held_out for r in got.values())


def test_main_text_of_a_page():
    page = """<html><body><header>Site</header><nav><a href=/>Menu</a></nav><div class="cookie-notice">We use cookies</div><div class=content><article><h1>Head &amp; tail</h1>
      <p>First <b>bold</b>word of a long paragraph.<br>Next<p>Second   paragraph.<script>var x="</p>"</script><div class="share-links">Share</div></article>
      <section id="comments"><p>Great post!</p></section></div><aside>Side</aside><footer>Foot</footer></body>"""
    assert extract.main_text(page) == "Head & tail First boldword of a long paragraph. Next Second paragraph."
    assert extract.main_text("") == extract.main_text("<nav>x</nav>") == "" and extract.main_text("plain") == "plain"


def test_main_text_under_furniture_names_in_forms_and_in_several_articles():
    one, two, three = (" ".join(words(60, k)) for k in (1, 2, 3))
    text = f"<p>{one}</p><p>{two}</p>"
    for left, right in (("<div class='has-sidebar'>", "</div>"), ("<div id='no-comments'>", "</div>"), ("<article class='social-science'>", "</article>"), ("<form action='/' method=post><input type=hidden>", "</form>"),
                        ("<form><div class='has-sidebar'><article class='social-science'>", "</article></div></form>")):
        assert extract.main_text(f"<body><nav>Menu</nav>{left}{text}{right}<div class='sidebar'>Side</div><form>Your name</form></body>") == f"{one} {two}"
    parts = "".join(f"<article class='social'><p>{x}</p></article>" for x in (one, two, three))
    for page in (parts, f"<main>{parts}</main>", f"<div>{parts}</div>"):
        assert extract.main_text(f"<body>{page}<div class='related'><a href=/>{one}</a></div></body>") == f"{one} {two} {three}"
    assert extract.main_text(f"<body><div><div><p>{one}</p></div><div><p>{two}</p></div></div><ul><li><a href=/>x y</a></li></ul></body>") == f"{one} {two}"


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "<<SYS>>\\ be"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s>é😀[INST]"), (1, 3, "assistant", None), (2, 0, None, ""), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in chat.chat_report(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), BPE).collect()}
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns[:4])
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[1].n_turns == 4
    assert got[1].loss_sha256 == hashlib.sha256("</s>é😀[INST]".encode()).hexdigest() and got[2].loss_chars == 0


def test_pii_spans_and_redaction(spark):
    rows = [(1, "é😀 a@b.c%d@e.f +1 (234) 567-8901 x 4111 1111-1111 1111 y 1.2.3.4.5 z 256.1.1.1", None, None, 5), (2, None, None, None, None), (3, "", None, None, 0), (4, "a.b@" + "d." * 3000 + "x", None, None, 1)]
    df, model = spark.createDataFrame(rows, DOCS), pii.Model([], {})
    got = {r.doc_id: r for r in pii.pii_report(df, model).collect()}
    assert got[1].spans == "email:3:8,email:8:14,phone:15:32,card:35:54,ip:57:64" and got[2].spans == got[3].spans == "" and got[4].n_email == 1
    clean = {r.doc_id: r for r in pii.redacted(df, model).collect()}
    assert clean[1].text == "é😀 [EMAIL][EMAIL] [PHONE] x [CARD] y [IP].5 z 256.1.1.1" and clean[2].text is None and clean[1].n_chars == len(clean[1].text)


def test_pii_model_adds_obfuscated_addresses_and_national_phones(spark):
    rows = []
    for k in range(60):
        rows += [f"write to name{k} [at] host{k} [dot] org soon", f"mail ann{k}@site{k}.com now", f"meet (at) noon{k} please", f"call (0{17 + k}) 555-{7700 + k} today", f"tel: 0{30 + k} {1234500 + k} x",
                 f"dial +1 ({200 + k}) 555-{1000 + k} or", f"order {4193803191787600 + 7 * k} then", f"counts {2000 + k} 2001 2002 here", f"on 2024-01-{10 + k % 20} 12 rows", f"at {k}.20.30.40 up"]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(rows)], DOCS)
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert {clean[k] for k in range(0, 600, 10)} == {"write to [EMAIL] soon"} and {clean[k] for k in range(1, 600, 10)} == {"mail [EMAIL] now"}
    assert {clean[k] for k in range(3, 600, 10)} == {"call [PHONE] today"} and {clean[k] for k in range(4, 600, 10)} == {"tel: [PHONE] x"}
    assert all("[PHONE]" not in clean[k] and "[EMAIL]" not in clean[k] for k in clean if k % 10 in (2, 6, 7, 8, 9))
    assert all(clean[k] == rows[k] for k in clean if k % 10 in (2, 7, 8))


def test_pii_cuts_do_not_depend_on_how_common_other_kinds_are(spark):
    rng = np.random.default_rng(4)
    few = [f"token = {rng.bytes(16).hex()} x" for _ in range(12)]
    many = ["".join(rng.choice(list("abcdefghijkl"), 20 + k % 40)) + f" {rng.integers(10 ** 11, 10 ** 12)} and (0{10 + k % 90}) 555-{1000 + k}" for k in range(1500)]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(few + many)], DOCS)
    model = pii.fit(df, sample=60)
    assert model.cuts[pii.KINDS.index("secret")] <= 0.9
    assert {r.text for r in pii.redacted(df.where("doc_id < 12"), model).collect()} == {"token = [SECRET] x"}


def test_cotraining_rejects_bad_words(spark):
    rows = [(k, " ".join(words(40, k) + (["vilest"] if k % 4 == 0 else [])), "en", f"s{k % 3}", None) for k in range(240)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(0, 160)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in cotraining.judged(spark.createDataFrame(rows, DOCS), labels).select("row.doc_id", "kept").collect()}
    assert sum(got[k] == (k % 4 != 0) for k in range(160, 240)) >= 76
    assert cotraining.judged(spark.createDataFrame(rows[:3], DOCS), labels.limit(0)).where("kept").count() == 3


def test_cotraining_counts_features_over_all_labelled_documents(spark):
    # the second bad word stands in few of the drawn documents, but in many of the labelled ones
    rows = [(k, " ".join(words(30, k) + (["vilest"] if k % 4 == 0 else ["foulest"] if k % 40 == 1 else [])), "en", "s", None) for k in range(2400)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0 or k % 40 == 1)) for k in range(2000)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    views = cotraining.fit(docs, labels, labelled=100)
    _, buckets = cotraining.content_features(cotraining.words(["foulest"], cotraining.LETTERS))
    assert buckets[0] in views.used


def test_empty_tables_give_no_rows(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0 and packing.pack(empty, BPE).count() == 0 and tokens.token_counts(empty, PIECES).count() == 0
    assert decontaminate.contamination(empty, none).count() == 0 and quality_rules.quality_report(empty).count() == 0
    assert language.language_report(empty).count() == 0 and pii.pii_report(empty).count() == 0
