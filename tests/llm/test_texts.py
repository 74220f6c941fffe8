"""Language, quality and toxicity: exact counts, code lengths, and accuracy on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from emendata.llm import llr_quality, ppm_language, textscan, zstd_toxicity

from .conftest import sentence, words


def brute_code_length(texts, text):
    """PPM with escape method C, order 3, without exclusion, from its definition."""
    padded = lambda t: [0, 0, 0] + list(t.encode())
    counts = Counter()
    for t in texts:
        s = padded(t)
        for i in range(3, len(s)):
            for n in range(4):
                counts[tuple(s[i - n : i]), s[i]] += 1
    totals, distinct = Counter(), Counter()
    for (context, _), n in counts.items():
        totals[context] += n
        distinct[context] += 1

    def probability(context, byte):
        base = probability(context[1:], byte) if context else 1 / 256
        whole = totals[context] + distinct[context]
        if not whole:
            return base
        n = counts[context, byte]
        return n / whole if n else distinct[context] / whole * base

    s = padded(text)
    return -sum(math.log2(probability(tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s)))


def test_code_lengths_are_exact(monkeypatch):
    samples = {"x": ["the cat sat on the mat", "a cat and a hat", "thé"], "y": ["Ünder ßtress", "hat der hund", "猫が座る 猫"], "z": ["qqq"]}
    tables = ppm_language.code_lengths(ppm_language.fit(samples))
    asked = ["the hat", "zzz the", "", "thé cat", "Q", "猫と犬", "der hat \0 x", "the cat sat on the mat"]
    for gathered in (1 << 22, 12):
        monkeypatch.setattr(ppm_language, "GATHERED", gathered)
        got = ppm_language._score(textscan.as_texts(pa.array(asked)), tables)
        for k, text in enumerate(asked):
            assert got[k] == pytest.approx([brute_code_length(samples[name], text) for name in "xyz"], rel=1e-4)


def test_every_context_is_kept():
    """Many languages in scripts of their own: more bytes than any table of symbols holds."""
    rng = random.Random(4)
    samples = {f"l{k:02d}": ["".join(chr(0x400 + 90 * k + rng.randrange(80)) for _ in range(300))] for k in range(30)}
    model = ppm_language.fit(samples)
    tables = ppm_language.code_lengths(model)
    seen = {t[i : i + 4] for texts in samples.values() for t in [b"\0\0\0" + texts[0].encode()] for i in range(len(t) - 3)}
    assert len(model.codes) == len(seen)
    text = samples["l17"][0][:40]
    got = ppm_language._score(textscan.as_texts(pa.array([text])), tables)[0]
    assert got.argmin() == 17 and got[3] == pytest.approx(brute_code_length(samples["l03"], text), rel=1e-4)


def test_languages(spark):
    rows = []
    for i in range(200):
        text = ("the house and the dog went there " if i % 2 else "der hund und das haus gehen hier ") * (1 + i % 3)
        rows.append((i, text, ("en" if i % 2 else "de"), "s"))
    rows += [(900, None, "en", "s"), (901, "", None, "s"), (902, "123 !?", "en", "s"), (None, "the dog", "en", "s"), (3, rows[3][1], "en", "s")]
    got = {r.doc_id: r for r in ppm_language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()}
    assert len(got) == 204
    for i in range(200):
        assert got[i].lang_pred == ("en" if i % 2 else "de") and 0.5 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert got[None].lang_pred == "en" and not got[None].held_out


def test_nothing_to_learn_from(spark, nothing):
    rows = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in ppm_language.identify(rows).collect()} == {"und"}
    assert ppm_language.identify(nothing).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in zstd_toxicity.score(rows, labels).collect()] == [0, 0]
    assert zstd_toxicity.score(nothing, labels).count() == 0
    assert llr_quality.quality_rules(nothing, labels).count() == 0
    assert {r.base_failed for r in llr_quality.quality_rules(rows, labels).collect()} == {True}


def brute_counts(text):
    text = text or ""
    ws = words(text)
    lines, seen, dup = [x for x in text.split("\n") if words(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_base_counts(spark, corpus):
    extra = ["a\na\na", "\na\n\na\n b\n b", "x y z x y z", "é à\né à\n", "\n", "a\n", "#a **b** <c>|", "a a a a"]
    rows = [(i, t) for i, t in enumerate([r[1] for r in corpus] + extra)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in llr_quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    for i, text in rows:
        want = brute_counts(text)
        assert tuple(got[i][c] for c in llr_quality.BASE_COLUMNS) == want
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i].base_failed and got[i].kept)


def test_lines_that_collide_in_polynomial_hashes(spark):
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    text = "\n".join("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    assert llr_quality.base_counts(textscan.as_texts(pa.array([text])))["n_dup_lines"].tolist() == [brute_counts(text)[3]] == [0]


def test_span_hash_tells_bytes_apart():
    rng = random.Random(2)
    texts = [" ".join(sentence(rng, 1, 0, 3000) * rng.randrange(1, 5) for _ in range(300)), "x" * 2048 + " " + "x" * 2049 + " " + "x" * 4000, "", "é ab ab\0 ab\0\0", "ends with eight b ytes678"]
    seen = {}
    for part in (texts, texts[::-1], texts[3:]):
        found = textscan.as_texts(pa.array(part))
        found.find_words()
        for start, end, value in zip(found.starts, found.ends, found.word_hash(), strict=True):
            assert seen.setdefault(found.data[start:end].tobytes(), value) == value
    assert len(set(seen.values())) == len(seen) > 300


def test_ratio_is_that_of_the_multinomials(spark):
    rows = [(1, "a b a"), (2, "a c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw = llr_quality.corpus_counts(df)
    assert raw.sum() == 3 + 2 + 2 + 1
    model = llr_quality.fit(df, ["a b a"], ["zz yy"])
    texts = textscan.as_texts(pa.array(["a b a"]))
    llr_quality.base_counts(texts)
    buckets = llr_quality.ngram_buckets(texts)[0]
    want = np.mean([math.log((np.sum(buckets == b) + 1) / (5 + 65536)) - math.log((raw[b] + 1) / (8 + 65536)) for b in buckets])
    assert llr_quality.mean_ratios(texts, model.log_ratio)[0] == pytest.approx(want)


def test_every_labelled_text_is_learned_from(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 60, 0, 40) if i % 7 else sentence(rng, 60, 10, 40)) for i in range(9000)] + [(5, "w1 w2"), (None, "w3"), (9001, None), (9002, "")]
    marks = [(i, int(i % 7 != 0)) for i in range(0, 9003)] + [(14, 1), (15, 0), (20, 1)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(marks, "doc_id long, quality int")
    learned = {(i, q) for i, q in marks if zlib.crc32(str(i).encode()) % 4 != 2}
    texts = textscan.as_texts(pa.array([t for _, t in rows]))
    llr_quality.base_counts(texts)
    bucket, of = llr_quality.ngram_buckets(texts)
    trusted = np.array([(i, 1) in learned and t is not None for i, t in rows])
    other = np.array([(i, 0) in learned and t is not None for i, t in rows])
    assert trusted.sum() > 4000
    raw, target = np.bincount(bucket, minlength=65536), np.bincount(bucket[trusted[of]], minlength=65536)
    ratio = np.log((target + 1) / (target.sum() + 65536)) - np.log((raw + 1) / (raw.sum() + 65536))
    llr = llr_quality.mean_ratios(texts, ratio)
    good, low = np.sort(llr[trusted]), np.sort(llr[other])
    highest = good[int(0.01 * len(good))]
    cuts = np.unique([*low[low < highest], highest])
    best = cuts[np.argmax([(low <= c).mean() - (good < c).mean() for c in cuts])]
    want = best if best in good else (best + min(v for v in llr[trusted | other] if v > best)) / 2
    got = llr_quality.quality_rules(df, labels).collect()
    assert Counter((r.doc_id, round(r.llr, 9), r.kept) for r in got) == Counter((i, round(v, 9), not brute_failed(t) and v >= want) for (i, t), v in zip(rows, llr, strict=True))
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def brute_failed(text):
    n, *_, repeated = brute_counts(text)
    return n < 50 or 100 * repeated > 50 * n


def test_toxicity_on_held_out_rows(spark):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        ws = ["".join(rng.choice(["an", "the", "re", "on", "st", "er"]) for _ in range(rng.randrange(1, 4))) for _ in range(80)]
        bad = i % 4 == 0
        if bad:
            for _ in range(6):
                ws[rng.randrange(80)] = rng.choice(["gruffle", "blorpish", "quaxom"])
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, int(bad)))
    rows += [(900, None, "x"), (901, "", "x")]
    got = {r.doc_id: r for r in zstd_toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[900].predicted == got[901].predicted == 0 and len(got) == 402
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_ordinary_dictionary_learns_from_all_sampled_texts(monkeypatch):
    given = []
    train = zstd_toxicity._dictionary
    monkeypatch.setattr(zstd_toxicity, "_dictionary", lambda samples, size: given.append(samples) or train(samples, size))
    rng = random.Random(5)
    ordinary = [sentence(rng, 8000) for _ in range(300)] + [f"last passage {k} {sentence(rng, 40)}" for k in range(20)]
    zstd_toxicity.fit([f"bad {sentence(rng, 60, 2000)}" for _ in range(20)], ordinary)
    assert len(given[0]) > 40_000
    assert sum(len(x) for x in given[0]) == sum(len(zstd_toxicity._lowered(x)) for x in ordinary)
    assert b"last passage 19" in given[0][-1] + given[0][-2]


def test_scores_are_those_of_compression_lengths():
    """Every window compressed by itself, with a compressor of its own for each dictionary, and the curve over the savings."""
    rng = random.Random(3)
    toxic = [f"{sentence(rng, 30, 0, 90)} gruffle {sentence(rng, 20, 0, 90)} Blorpish gruffle quaxom" for _ in range(60)]
    ordinary = [sentence(rng, 60, 0, 90) for _ in range(120)]
    model = zstd_toxicity.fit(toxic, ordinary)
    assert b"gruffle" in model.toxic and b"gruffle" not in model.ordinary
    texts = [*toxic[:5], *ordinary[:5], "gruffle", "", None, "é" * 50, sentence(rng, 30_000, 0, 90) + " gruffle", " \n"]
    got = zstd_toxicity.scores(texts, model, zstd_toxicity._pair(model))

    def size(content, part):
        trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=9, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False).compress(part))

    for text, score in zip(texts, got, strict=True):
        features = [1.0] + [0.0] * 11
        if text:
            data = f" {text.lower()} ".encode()
            parts = [data[k : k + 32] for k in range(0, max(len(data) - 16, 1), 16)]
            seen = {part: size(model.ordinary, part) - size(model.ordinary + model.toxic, part) for part in set(parts)}
            saved = sorted((seen[part] for part in parts), reverse=True)
            features[1] = max(saved[0], 0)
            features[2] = sum(max(x, 0) for x in saved[:3])
            features[3:11] = [math.log1p(50 * sum(x >= cut for x in saved) / len(saved)) for cut in range(2, 10)]
            features[11] = math.log(len(saved))
        assert score == pytest.approx(1 / (1 + math.exp(-np.clip(np.dot(features, model.weights), -30, 30))), abs=1e-8)
