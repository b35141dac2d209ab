"""Operators on single texts against plain forms: token counts, media, secrets, licences, languages, toxicity."""

import hashlib
import math
import os
import random
import re
import time
import wave
import zlib
from io import BytesIO
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from cases import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from samphire.llm import languages, license_scan, media, packing, queries, secret_scan, token_counts, toxicity
from samphire.llm.common import fold

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(alphabet=st.sampled_from("aabcAZ's tnré日Σİ🙂\n\t\x1c\x85  ​12²½.,-_́<|>"), max_size=40)


def test_token_counts(spark):
    library = Tokenizer.from_file(BYTES)
    found = token_counts.token_counts(frame(spark), BYTES).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(empty(spark), BYTES).count() == 0


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_array_merging(text):
    for text in (text, text + "<|endoftext|>" + text):
        assert token_counts.load(BYTES).count([text]) == [len(_library(BYTES).encode(text, add_special_tokens=False).ids)]
        assert packing.load(WORDS).encode([text], 2)[0].tolist() == [*_library(WORDS).encode(text, add_special_tokens=False).ids, 2]


_made = {}


def _library(path):
    return _made.setdefault(path, Tokenizer.from_file(path))


def test_kept_words_may_be_few(monkeypatch):
    texts = [r[1] or "" for r in rows()] * 2
    monkeypatch.setattr(packing, "KEPT", 3)
    small = packing.WordTokenizer(WORDS)
    for part in (texts[:4], texts[4:], texts):
        assert [x.tolist() for x in small.encode(part, 2)] == [[*_library(WORDS).encode(t, add_special_tokens=False).ids, 2] for t in part]
    monkeypatch.setattr(token_counts, "KEPT", 3)
    few = token_counts.ArrayBpe(BYTES)
    for part in (texts[:4], texts[4:], texts):
        assert few.count(part) == [len(_library(BYTES).encode(t, add_special_tokens=False).ids) for t in part]


def test_media_round_trip(spark):
    made = media.media_columns(frame(spark)).collect()
    for r in made:
        with wave.open(BytesIO(r.media)) as file:
            assert (file.getnchannels(), file.getsampwidth(), file.readframes(file.getnframes())) == (1, 1, bytes(r.payload))
        assert len(r.payload) % 192 == 0 and len(r.payload) >= max(192, r.n_bytes)
    texts = sorted((r[1] or "").encode() for r in rows())
    assert sorted(bytes(r.payload)[: r.n_bytes] for r in made) == texts
    digest = {r.payload_sha256: r for r in media.media_digests(media.media_columns(frame(spark))).collect()}
    for raw in texts:
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        row = digest[hashlib.sha256(payload).hexdigest()]
        assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert row.media_bytes == len(payload) + 44
    assert len({r.feature for r in digest.values()}) == len({r.payload_sha256 for r in digest.values()}) == len(set(texts))
    assert media.media_columns(empty(spark)).count() == 0


def test_peaks_of_tones():
    t = np.arange(192 * 40)
    tone = (128 + 60 * np.sin(2 * np.pi * 30 * t / 192)).astype(np.uint8).tobytes()
    codes = media.peak_pairs(tone, np.hanning(192).astype(np.float32))
    assert len(codes) and (np.diff(codes) > 0).all()
    own = codes[((codes >> 16) & 255 == 30) & ((codes >> 8) & 255 == 30)]
    assert len(own) > 0


def plain_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


@pytest.fixture(scope="module")
def secrets(spark):
    return secret_scan.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_secrets(spark, secrets):
    rng = random.Random(0)
    key = "".join(rng.choices("ABCDEFGHabcdefgh0123456789xyzXYZ", k=40))
    texts = [
        f"é🙂 PassWord = 'hunter22x' and token:{'0af3' * 8} AKIA{'A1B2' * 5} or use {key} here",
        "api_key=short secret: abc_/defg, apikey : \"zzzzzz\"", "AKIASHORT deadbeef the_quick_brown_fox_jumps_over_2", "Internationalization2024-of-very-long-names", "", None,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in secret_scan.scan(docs, secrets).collect()}
    for i, t in enumerate(texts):
        assert [s for s in found[i] if s[2] != "markov"] == plain_base(t or "")
    assert [s for s in found[0] if s[2] == "markov"] == [(texts[0].index(key), texts[0].index(key) + 40, "markov")]
    assert not any(s[2] == "markov" for i in (1, 2, 3) for s in found[i])
    digest = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(docs, secrets)).collect()}
    base = plain_base(texts[0])
    assert (digest[0].n_assign, digest[0].n_access, digest[0].n_hex) == tuple(sum(k == s[2] for s in base) for k in ("assign", "access", "hex"))
    assert digest[0].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
    masked = secret_scan.redact(docs.selectExpr("doc_id", "text", "cast(1 as bigint) AS n_chars", "1 AS spans"), secrets).collect()
    row = next(r for r in masked if r.doc_id == 0)
    assert key not in row.text and "hunter22x" not in row.text and row.n_chars == len(row.text) and row.text.startswith("é🙂 [secret]")
    assert [r.text for r in masked if r.doc_id in (3, 4, 5)] == texts[3:] and secret_scan.redact(empty(spark), secrets).count() == 0


def test_secret_chains(spark, secrets):
    made = secret_scan.random_tokens(99, 50)
    assert np.mean([secrets.is_secret(t) for t in made if any(map(str.isdigit, t)) and any(map(str.isalpha, t))]) > 0.9
    assert secret_scan.scan(frame(spark), secrets).count() == len(rows())
    assert secret_scan.scan(empty(spark), secret_scan.train(empty(spark))).count() == 0
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for r in queries.op9_secret_scans(spark, SF).collect():
        assert r.n_assign + r.n_access + r.n_hex >= 0
    assert sum("markov" in k for t in docs for *_, k in secrets.spans(t)) == 0


def test_secrets_of_any_run(secrets):
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    made = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    covered = lambda text, key: any(a <= text.index(key) and text.index(key) + len(key) <= b for a, b, _ in secrets.spans(text))
    for alphabet, n in ((letters + "0123456789", 16), (letters + "0123456789", 20), (letters, 24)):
        keys = [made(alphabet, n) for _ in range(100)]
        assert np.mean([covered(f"use {k} here", k) for k in keys]) > 0.95
    keys = [made(letters + "0123456789", 24) for _ in range(100)]
    assert np.mean([covered(f"see https://example.org/files/images/download_all/of-the-year/{k} now", k) for k in keys]) > 0.95
    assert np.mean([covered(f"AKIA{'A1B2' * 5}/{k}", k) for k in keys]) > 0.95
    assert not any(k == "markov" for *_, k in secrets.spans("files/images/download_all/of-the-year ---------------- ================ internationalization"))


def test_licenses(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = license_scan.train(docs)
    for family, notices in license_scan.TEMPLATES.items():
        assert [model.judge(n)[0] for n in notices] == [family] * len(notices)
    assert {model.judge(t)[0] for t in license_scan.OTHER} == {license_scan.UNKNOWN}
    odd = frame(spark).select("doc_id", "text", "score", "row", "id").unionByName(spark.createDataFrame([(20, "x\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0.", 0.1, 1, 1), (21, "Released under the MIT License.", 0.1, 1, 1), (21, "Released under the MIT License.", 0.1, 1, 1)], "doc_id long, text string, score double, row int, id int"))
    both = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    want = []
    for r in both.collect():
        judged = [model.judge(x) for x in (r.text or "").split("\n")]
        known = [j for j in judged if j[0] != license_scan.UNKNOWN]
        want.append((r.doc_id, len(known), ",".join(sorted({j[0] for j in known})), max(known, key=lambda j: j[1])[0] if known else license_scan.UNKNOWN))
    found = [(r.doc_id, r.n_paragraphs, r.families, r.family) for r in license_scan.scan(odd, model).select("doc_id", "n_paragraphs", "families", "family").union(license_scan.scan(docs, model).select("doc_id", "n_paragraphs", "families", "family")).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(found, key=key) == sorted(want, key=key)
    assert license_scan.scan(empty(spark), license_scan.train(empty(spark))).count() == 0
    plan = license_scan.scan(docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


WRAPPED = {
    "gpl": "# This file is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction, including without limitation",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:",
    "apache,mit": "Licensed under the MIT license or the Apache License, Version 2.0.",
    "": "He asked for the permission of any person.\nThe software was free.\nThe license of the public was general,\nand the redistribution of source forms was met.",
}


def test_wrapped_and_dual_licenses(spark):
    model = license_scan.train(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = spark.createDataFrame([(k, f"some words before\n\n{t}\n\nand some after") for k, t in WRAPPED.items()] + [("bsd", WRAPPED["bsd"].replace(" ", "\n")), ("gpl,mit", WRAPPED["gpl"] + "\n#\n" + WRAPPED["mit"])], "doc_id string, text string")
    found = license_scan.scan(docs, model).collect()
    assert len(found) == 7 and all(r.families == r.doc_id for r in found)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.train(docs.where(fold("doc_id", 4) != 2))
    assert model.languages == ["de", "en", "es", "fr"]
    found = {r.doc_id: r for r in languages.identify(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    de, fr = (next(r.text for r in held if r.lang == x and len(r.text) > 1500)[:1500] for x in ("de", "fr"))
    mixed = spark.createDataFrame([(1, de + "\n" + fr), (2, de)], "doc_id long, text string")
    shares = {r.doc_id: r.proportions for r in languages.identify(mixed, model).collect()}
    assert set(shares[1]) == {"de", "fr"} and all(0.3 < v < 0.7 for v in shares[1].values()) and set(shares[2]) == {"de"}
    odd = languages.identify(frame(spark), model).collect()
    assert len(odd) == len(rows())
    by_text = {r.doc_id: r.lang_pred for r in odd}
    assert [by_text[i] for i in (3, 4, 6, 9)] == ["und"] * 4 and by_text[7] != "und"
    none = languages.identify(frame(spark), languages.train(empty(spark)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and languages.identify(empty(spark), model).count() == 0


def test_language_mixture_is_a_maximum():
    rng = np.random.default_rng(0)
    table = rng.random((3, languages.BUCKETS)) ** 4
    model = languages.LanguageModel(["a", "b", "c"], table * 1000, rounds=200)
    like, count = model.table[rng.integers(0, languages.BUCKETS, 300)], rng.integers(1, 5, 300).astype(float)
    share, value = model.proportions(like, count, np.array([0]), np.ones((1, 3)))
    score = lambda p: (np.log((like * p).sum(axis=1)) * count).sum()
    assert value[0] == pytest.approx(score(share[0]), rel=1e-5)
    grid = [(i / 20, j / 20, 1 - i / 20 - j / 20) for i in range(21) for j in range(21 - i)]
    assert value[0] >= max(score(np.array(p)) for p in grid) - 1e-2


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    held = toxicity.score(docs, model).join(labels.where(fold("doc_id", 5) == 0).select("doc_id", "toxic"), "doc_id").collect()
    clean, toxic = ([r.score for r in held if r.toxic == y] for y in (0, 1))
    assert np.mean(np.array(toxic) >= 0.5) > 0.8 and np.mean(np.array(clean) >= 0.5) < 0.02
    odd = toxicity.score(frame(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd) and toxicity.score(empty(spark), model).count() == 0
    nothing = toxicity.train(docs, labels.where("false"))
    assert {r.score < 0.01 for r in toxicity.score(frame(spark), nothing).collect()} == {True}
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    toxicity.train(frame(spark), nulls)


def test_pairs_of_terms():
    """A label that only a pair of terms tells: single weights can't, factors can."""
    rng = np.random.default_rng(3)
    rows_, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows_.append(np.array(sorted([10] * int(a) + [20] * int(b) + [int(x) for x in rng.integers(100, 130, 3)]), np.int64))
        rows_[-1] = np.unique(rows_[-1])
        y.append(float(a and b))
    y = np.array(y)
    model = toxicity.FactorizationMachine(*toxicity.fit(rows_, y, np.ones(len(y)), 4, 600))
    margin = lambda *t: model.margins([sorted(model.slot[x] for x in t)])[0]
    assert margin(10, 20) > 0 > max(margin(10), margin(20), margin())
    assert margin(10, 20) - margin(10) - margin(20) + margin() > 0.5
    weights = toxicity.family_weights(np.array([[1, 5], [2, 5], [2, 6], [3, 7]]))
    assert weights.tolist() == [1 / 3] * 3 + [1]


def test_exclusive_pairs_are_learned(spark):
    """One term of two makes a text positive, both or none don't: neither tells by itself."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices("stone river cloud meadow window garden ladder candle".split(), k=6) + ["alpha"] * a + ["omega"] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a != b)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id >= 500"))
    held = toxicity.score(docs.where("doc_id < 500"), model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in held]) > 0.95


def test_toxicity_scores_are_those_of_the_formula(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, rounds=200)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        own = sorted({model.slot[b] for b in map(toxicity.bucket, toxicity.terms(texts[r.doc_id])) if b in model.slot})
        z = model.bias + sum(model.weights[i] for i in own)
        z += sum(model.factors[i] @ model.factors[j] for n, i in enumerate(own) for j in own[:n])
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_repeated_ids_in_training(spark):
    docs = spark.createDataFrame([(1, "some words")] * 40 + [(2, "other words"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels, sample_rows=1)).count() == 42


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch, tmp_path):
    """The driver's Python holds the model, not the sample and what the fit makes of it."""
    real, place = toxicity.fit, tmp_path / "process"

    def fit(rows, *args, **kwargs):
        place.write_text(f"{os.getpid()} {len(rows)}")
        return real(rows, *args, **kwargs)

    monkeypatch.setattr(toxicity, "fit", fit)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, rounds=50)
    process, fitted = map(int, place.read_text().split())
    assert process != os.getpid() and len(model.slot) == len(model.weights) == len(model.factors) > 0
    known = {r.doc_id for r in labels.where("toxic IS NOT NULL").collect()}
    assert fitted == len(known & {r.doc_id for r in docs.collect()})  # one task has the whole sample


def test_language_sets_against_all_subsets():
    """The nested sets by proportion reach what the best of all sets reaches."""
    rng = np.random.default_rng(5)
    table = rng.random((4, languages.BUCKETS)) ** 3
    model = languages.LanguageModel(["a", "b", "c", "d"], table * 1000, rounds=100)
    hits = 0
    for case in range(40):
        truth = rng.dirichlet(np.ones(4) * 0.4)
        spots = rng.choice(languages.BUCKETS, 250, replace=False)
        chance = (table[:, spots] / table[:, spots].sum(axis=1, keepdims=True)).T @ truth
        count = rng.multinomial(400, chance / chance.sum())
        like, count = model.table[spots[count > 0]], count[count > 0].astype(float)
        fine = model.penalty * np.log(count.sum() + 1)

        def worth(chosen, like=like, count=count, fine=fine):
            allowed = np.zeros((1, 4))
            allowed[0, list(chosen)] = 1
            return model.proportions(like, count, np.array([0]), allowed)[1][0] - (len(chosen) - 1) * fine

        best = max(worth(s) for n in range(1, 5) for s in combinations(range(4), n))
        order = np.argsort(-model.proportions(like, count, np.array([0]), np.ones((1, 4)))[0][0])
        single = max(worth([i]) for i in range(4))
        hits += max(single, *(worth(order[:n]) for n in range(2, 5))) >= best - 1e-3 * abs(best)
    assert hits >= 38


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_BYTES", 2 * 8 * languages.BUCKETS)
    rows_ = [(i, "the quick brown fox", "en") for i in range(5)] + [(i, "le renard brun rapide", "fr") for i in range(4)] + [(i, "der schnelle braune fuchs", "de") for i in range(3)]
    assert languages.train(spark.createDataFrame(rows_, "doc_id long, text string, lang string")).languages == ["en", "fr"]


def test_base_spans_of_all_documents(spark, secrets):
    scanned = secret_scan.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), secrets).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sum(len(r.spans) for r in scanned) > 20
    for r in scanned:
        assert [(s.start, s.end, s.kind) for s in r.spans if s.kind != "markov"] == plain_base(texts[r.doc_id])


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "thequickbrown "])
def test_long_runs_merge_as_the_library_says(alphabet):
    text = "".join(random.Random(2).choices(alphabet, k=20_000))
    assert packing.load(WORDS).encode([text], 2)[0].tolist() == [*_library(WORDS).encode(text, add_special_tokens=False).ids, 2]
    assert token_counts.load(BYTES).count([text]) == [len(_library(BYTES).encode(text, add_special_tokens=False).ids)]


def test_a_run_of_a_million_letters():
    text = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.perf_counter()
    assert token_counts.load(BYTES).count([text]) == [len(_library(BYTES).encode(text, add_special_tokens=False).ids)]
    assert time.perf_counter() - began < 60


def test_very_long_texts(monkeypatch):
    """Texts beyond a segment are encoded in parts, with the same tokens."""
    from samphire.llm import common

    text = " ".join(r[1] or "" for r in rows() if r[0] != 5) * 3
    monkeypatch.setattr(common.segments, "__defaults__", (50,))
    assert "".join(common.segments(text)) == text and len(list(common.segments(text))) > 10
    assert packing.encode_all(packing.load(WORDS), [text], 2)[0].tolist() == [*_library(WORDS).encode(text, add_special_tokens=False).ids, 2]
    bpe = token_counts.load(BYTES)
    assert sum(sum(bpe.count([s])) for s in common.segments(text)) == len(_library(BYTES).encode(text, add_special_tokens=False).ids)
