"""Base spans against the rules in plain Python, redaction against slices, planted truth, and texts dense in candidates."""

import hashlib
import re
import time

import numpy as np
import pytest

from echogrid.llm import pii

KIND = "doc_id long, text string, __spans int, n_chars int, start int"
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    spans = [(m.start(), n, m.end()) for n, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text or "", re.ASCII) if fits(kind, m.group())]
    return sorted(spans)


def texts():
    rng = np.random.default_rng(7)
    pieces = ["a", "b9", ".", "@", "-", " ", "4111 1111 1111 1111", "+1 (234) 567-8901", "10.20.30.40", "256.1.1.1", "x@y.z", "é😀", "(", ")", "\n", "378282246310005", "0", "%", "::", "+49", "4111-1111-1111-1112", "1.2.3.4.5"]
    made = ["".join(rng.choice(pieces, rng.integers(1, 40))) for _ in range(400)]
    return [*made, None, "", "a@" + "b." * 5000 + "c", "+" + "1" * 4000, "1." * 3000, "a." * 3000 + "@", made[0]]


def test_base_counts_and_digest_equal_plain_rules(spark):
    rows = [(k if k % 50 else None, t, 1, 2, 3) for k, t in enumerate(texts())]
    out = pii.pii_report(spark.createDataFrame(rows, KIND), pii.Model([], {}))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for d, t, *_ in rows:
        spans = base(t)
        said = ",".join(f"{list(RULES)[n]}:{a}:{b}" for a, n, b in spans)
        want.append((d, *[sum(n == k for _, n, _ in spans) for k in range(4)], hashlib.sha256(said.encode()).hexdigest(), said))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_redaction_equals_slices_and_keeps_columns(spark):
    rows = [(k, t, 7, 8, 9) for k, t in enumerate(texts())]
    out = pii.redacted(spark.createDataFrame(rows, KIND), pii.Model([], {}))
    assert out.columns == ["doc_id", "text", "__spans", "n_chars", "start"]
    for r in out.collect():
        text, at, want = rows[r.doc_id][1], 0, ""
        for a, n, b in base(text):
            if a >= at:
                want += text[at:a] + f"[{list(RULES)[n].upper()}]"
            at = max(at, b)
        assert r.text == (None if text is None else want + text[at:]) and (r[2], r[4]) == (7, 9)


@pytest.fixture(scope="module")
def planted(spark):
    """(text, personal parts) in several forms, with plain numbers, dates and versions between them."""
    rng = np.random.default_rng(3)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghik"), rng.integers(3, 8)))
    rows = []
    for k in range(900):
        quad = ".".join(str(x) for x in rng.integers(1, 255, 4))
        area, line = str(rng.integers(200, 999)), str(rng.integers(1000, 9999))
        phone = f"({area}) 555-{line}" if k % 2 else f"{area}-555-{line}"
        personal, lead = [
            (f"{word()}.{word()}@{word()}.com", "mail"), (f"{word()} [at] {word()} [dot] org", "contact"), (quad, "host"), (quad.replace(".", "[.]"), "server"),
            (f"+1 ({area}) 555-{line} {quad}", "both"), (phone, "call"), (f"tk{digits(4)}{''.join(rng.choice(list('abcdef0123456789'), 28))}", "token ="), (None, ""), (None, "")][k % 9]
        plain = [f"order {digits(9)} of {2000 + k % 20}-0{1 + k % 9}-1{k % 9}", f"version 3.{k % 10}.1 with {digits(6)} rows", f"meet (at) noon, room {digits(3)}"][k % 3]
        parts = [] if personal is None else personal.rsplit(" ", 1) if lead == "both" else [personal]
        rows.append((k, f"{word()} {word()} {plain} {'' if lead == 'both' else lead} {personal or word()} {word()} {plain}", parts))
    return rows


def test_planted_data_is_found_and_plain_numbers_stay(spark, planted):
    docs = spark.createDataFrame([(k, t, 0, 0, 0) for k, t, _ in planted], KIND)
    model = pii.fit(docs)
    spans = {r.doc_id: [tuple(x.split(":")) for x in r.spans.split(",") if x] for r in pii.pii_report(docs, model).collect()}
    hit, total, wrong, said = {}, {}, 0, 0
    for k, text, parts in planted:
        found = [(int(a), int(b)) for _, a, b in spans[k]]
        for part in parts:
            a = text.index(part)
            total[k % 9] = total.get(k % 9, 0) + 1
            hit[k % 9] = hit.get(k % 9, 0) + any(x < a + len(part) and a < y for x, y in found)
        inside = [(text.index(p), text.index(p) + len(p)) for p in parts]
        said += len(found)
        wrong += sum(not any(x < b and a < y for a, b in inside) for x, y in found)
    assert all(hit[k] >= 0.9 * total[k] for k in total), (hit, total)
    assert wrong <= 0.05 * said, (wrong, said)
    # a telephone number ends before the address beside it
    assert all(any(text[int(a):int(b)] == parts[0] for kind, a, b in spans[k] if kind == "phone") for k, text, parts in planted if k % 9 == 4)


@pytest.mark.parametrize("made", [pii.pii_report, pii.redacted])
def test_each_pattern_is_read_once_a_text(spark, capfd, made):
    model = pii.Model([(1.0, ["Predict: 1.0"])], dict.fromkeys(range(len(pii.KINDS)), 0.5))
    docs = spark.createDataFrame([(1, "call +1 555-867-5309", 0, 0, 0)], KIND).repartition(1)
    made(docs, model).explain(True)
    plan = capfd.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # four base forms and five loose ones, each with one extraction; the parts of a text to redact are one more
    assert plan.count("regexp_extract_all(") == len(pii.BASE) + len(pii.KINDS) + (made is pii.redacted)
    assert all(plan.count(f", {pii.PATTERNS[k]}, -1)") == 1 and plan.count(f", {pii.LOOSE[k]}, -1)") == 1 for k in pii.BASE)


@pytest.mark.parametrize("made", [pii.pii_report, pii.redacted])
def test_patterns_are_put_into_columns_once_and_before_the_fit(spark, planted, monkeypatch, made):
    """A driver's heap grows during the fit; columns made again afterwards filled it."""
    steps = []

    def noted(owner, name):
        inner = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, **k: (steps.append(name), inner(*a, **k))[1])

    noted(pii, "candidates")
    noted(pii, "base_spans")
    noted(pii.GBTClassifier, "fit")
    docs = spark.createDataFrame([(k, t, 0, 0, 0) for k, t, _ in planted[:90]], KIND)
    assert made(docs).columns[0] == "doc_id"
    assert steps == ["candidates", "base_spans", "fit"]


def test_time_grows_with_the_text(spark):
    model = pii.Model([(1.0, ["Predict: 1.0"])], dict.fromkeys(range(len(pii.KINDS)), 0.5))
    unit = "call 555-867-5309 or a@b.org at 10.1.2.3, card 4111 1111 1111 1111; "

    def spent(n):
        docs = spark.createDataFrame([(1, unit * n, 0, 0, 0)], KIND)
        start = time.perf_counter()
        text = pii.redacted(docs, model).first().text
        assert text.count("[EMAIL]") == n
        return time.perf_counter() - start

    spent(10)
    small, large = spent(400), spent(3200)
    assert large < 20 * max(small, 1.0), (small, large)
