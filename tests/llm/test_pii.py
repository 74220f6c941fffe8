"""Personal data: base spans against the plain patterns, the field against exhaustive segmentation."""

import itertools
import math
import random
import re

import pytest
from emendata.llm import pii_crf as pii
from emendata.llm import queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            doubled = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 16 <= len(digits) <= 19 and doubled % 10 == 0 or kind == "phone" and 8 <= len(digits) <= 15:
                yield k, m.start(), m.end()


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    for alphabet in ("a.@-1", "0123456789 -", "+1 ().-7", "1.2@a+ é", "12.", "0123456789+-. ()@ab\n"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
            assert pii.base_spans(text)[0] == list(plain(text)), text
    card = "4111 1111 1111 1111"
    text = f"é {card} x 4111111111111112 a.b+c@d.ee.f, 1.2.3.256 001.2.3.4 +49 (30) 123-4567 +1 2"
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)[0]] == [("email", "a.b+c@d.ee.f"), ("ip", "001.2.3.4"), ("card", card), ("phone", "+49 (30) 123-4567")]


def test_long_runs_cost_no_square():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "999." * 50_000, "0" * 9000 + ".1.2", "+1 " * 60_000, "@" * 100_000, "7 " * 20_000):
        base, added = pii.find(text, pii.Field({(3, "any"): -1.0}))
        assert not base and not added


def segmentations(ending, field):
    """(score, segments) of every set of segments that do not overlap."""
    every = [(y, i, j, score, features) for j, x in enumerate(ending) for i, features in x for y, score in field.scored(features)]
    for n in range(len(every) + 1):
        for chosen in itertools.combinations(every, n):
            ordered = sorted(chosen, key=lambda s: s[1])
            if all(a[2] < b[1] for a, b in zip(ordered, ordered[1:])):
                yield sum(s[3] for s in chosen), ordered


@pytest.mark.parametrize("island", ["+1 (314) 55-12 41", "1.2.3.4 5.6.7.8", "a@b.c 1234567", "12345678 1234"])
def test_decoding_and_expectations_equal_exhaustive_search(island):
    rng = random.Random(island)
    ending = pii.candidates(island, pii._atoms(island), "", "")
    ending = [x[-2:] for x in ending]  # few enough for exhaustive search
    features = sorted({(y, f) for x in ending for _, fs in x for y in pii._kinds(fs) for f in fs})
    for _ in range(5):
        field = pii.Field({k: rng.gauss(0.1, 1) for k in features})
        every = list(segmentations(ending, field))
        best = max(every, key=lambda x: x[0])
        got = field.best(ending)
        assert math.isclose(sum(dict(field.scored(next(f for i, f in ending[b] if i == a)))[y] for y, a, b in got), best[0], abs_tol=1e-9)
        whole = sum(math.exp(s) for s, _ in every)
        want = {}
        for s, chosen in every:
            for y, _, _, _, fs in chosen:
                want[fs, y] = want.get((fs, y), 0) + math.exp(s) / whole
        found = {}
        for fs, y, p in pii._expected(field, ending):
            found[fs, y] = found.get((fs, y), 0) + p
        assert all(math.isclose(found.get(k, 0), want.get(k, 0), abs_tol=1e-9) for k in found | want)


def card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def items(rng):
    return [card(rng), f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", ".".join(str(rng.randrange(1, 255)) for _ in range(4)), f"a{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", str(rng.randrange(10**15, 10**16)), str(rng.randrange(10**6, 10**7))]


def test_items_side_by_side_are_parted(spark):
    rng = random.Random(8)
    rows = [(k, f"the {rng.choice(items(rng))} of, {rng.choice(items(rng))} in", "x", 1) for k in range(400)]
    one, phone, ip = card(rng), "+1 (314) 555-6532", "170.106.47.218"
    glued = {1000: (f"é {phone} {one} end", {("phone", phone), ("card", one)}), 1001: (f"{one} {card(rng)}", 2), 1002: (f"to {phone} {ip} and", {("phone", phone), ("ip", ip)})}
    more = [(k, t, "x", 1) for k, (t, _) in glued.items()] + [(2000, None, None, None), (2001, "", "x", 1), (None, f"{phone}", "x", 1), (0, rows[0][1], "x", 1), (2002, "no 1234 1234567 2345678901234568 data", "x", 1)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, spans string, kind int").repartition(3)
    got = pii.detect(df).collect()
    assert len(got) == len(rows) + len(more)
    text = {d: t for d, t, _, _ in rows + more}
    for r in got:
        t = text[r.doc_id] or ""
        assert [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.spans if not s.added] == list(plain(t))
        if r.doc_id in glued:
            want = glued[r.doc_id][1]
            found = {(s.kind, t[s.start : s.end]) for s in r.spans}
            assert found == want if isinstance(want, set) else len(found) == want
        else:
            assert not any(s.added for s in r.spans), t


def test_query_tells_base_and_all_spans(spark, data):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_semicrf_pii(spark, data).collect()
    assert len(got) == len(texts) and sum(r.n_card + r.n_ip + r.n_phone + r.n_email for r in got) > 5
    for r in got:
        base = list(plain(texts[r.doc_id]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        named = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(filter(None, r.spans.split(","))) and len(list(filter(None, r.spans.split(",")))) == len(base) + r.n_added


def test_tables_that_teach_nothing(spark, nothing, documents, corpus):
    assert pii.detect(nothing).count() == 0
    got = pii.detect(documents).collect()
    assert len(got) == len(corpus) and not any(r.spans for r in got)
