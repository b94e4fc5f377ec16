"""Small fixtures for every corpus operator: edge cases, and brute-force versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import audio, bpe, components, html_text, langid, license_scan, near_copies, packing, quality, queries, simhash, topk, warc

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [(1, "The quick brown fox. Released under the MIT License."), (2, None), (3, ""), (4, "Ünïcödé 日本語 \n\n  two  spaces"), (1, "The quick brown fox. Released under the MIT License."), (None, "no id"), (7, LONG), (8, "<|endoftext|> it's 12"), (9, "!!! ... ###")]
SCHEMA = "doc_id bigint, text string, lang string, score double, held_out string, length int, length_ string"


def docs_frame(spark, rows=TEXTS):
    """Documents with null cells and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None if i == 3 else "en", 1.0, None, 5, None) for i, t in rows], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_empty_tables(spark):
    docs = docs_frame(spark, [])
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = langid.fit(docs)
    for df in (license_scan.scan(docs), topk.top_k(vectors, F.col("vec_id") % 50 == 0), html_text.extract(pages), audio.audio_digest(docs), quality.classify(docs, quality.fit(docs, labels)), bpe.encode_documents(docs), warc.archive_round_trip(pages), packing.pack_documents(docs), simhash.classes(docs), langid.identify(docs, model)):
        assert df.count() == 0


# 1


def test_license_scan(spark):
    extra = [(20, "under THE mit LICENSE, under the MIT license; Apache License Version 2"), (21, "CC-BY-NC"), (22, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."), (23, "under the mıt license Kelvin"), (24, "under theémit license")]
    got = {r["doc_id"]: r for r in rows_of(license_scan.scan(docs_frame(spark, TEXTS + extra)))}
    assert license_scan.scan(docs_frame(spark, TEXTS + extra)).count() == len(TEXTS + extra)
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 1 and got[1]["first_word"] == 5 and got[1]["n_words"] == 9
    assert got[2]["n_words"] == 0 and got[2]["first_word"] is None and got[2]["labels"] == "" and got[2]["score"] == 0.0
    assert got[20]["n_base"] == 3 and (got[20]["first_word"], got[20]["last_word"]) == (0, 8) and got[20]["base_labels"] == "apache-2,mit"
    assert got[21]["base_labels"] == "cc-by-nc" and got[22]["base_labels"] == "apache-2" and got[22]["labels"] == "apache-2,gpl-3"
    assert got[23]["labels"] == "" and got[24]["labels"] == "" and got[7]["n_words"] == 20000


def test_license_join_by_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        base = rng.choice(license_scan.TEMPLATES).text.split()
        base = [w for w in base if rng.random() > 0.04]
        for _ in range(rng.randint(0, 2)):
            base.insert(rng.randrange(len(base) + 1), "other")
        other = rng.choice(license_scan.TEMPLATES).text.split()
        rows.append((i, " ".join(["x"] * rng.choice([0, 3, 100, 120, 200]) + base + ["y"] * rng.randint(0, 3) + other[: rng.randint(0, len(other))])))
    got = {(r["doc_id"], r["block"], r["label"], round(r["score"], 9)) for r in rows_of(license_scan.matches(docs_frame(spark, rows)))}
    want = set()
    for i, text in rows:
        words = text.split()
        for block in range(len(words) // license_scan.STEP + 1):
            last = (block + 2) * license_scan.STEP
            held = {f"{a} {b}" for a, b in zip(words[block * license_scan.STEP : last], words[block * license_scan.STEP + 1 : last + 1])}
            held |= {" ".join(words[at : at + 4]) for at in range(block * license_scan.STEP, last)}
            for t in license_scan.TEMPLATES:
                tokens = set(t.tokens())
                if len(held & tokens) >= license_scan.THRESHOLD * len(tokens) - 1e-9 and held >= set(t.required):
                    want.add((i, block, t.label, round(len(held & tokens) / len(tokens), 9)))
    assert got == want and len(want) > 100


def test_license_notices_in_the_wild(spark):
    """Canonical notices as they stand in files: wrapped, in comments, with words changed; and look-alikes."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n * 1. Redistributions of source code"
    gnu = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {} as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    texts = [
        (mit, "mit"), ("filler " * 117 + mit + " tail" * 300, "mit"), (mit.replace("obtaining a copy", "who obtains one copy"), "mit"), (bsd, "bsd"),
        (gnu.format("General Public License", 3), "gpl-3"), (gnu.format("General Public License", 2), "gpl-2"), (gnu.format("Lesser General Public License", 3), "lgpl-3"),
        ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', "apache-2"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this", "mpl-2"),
        ("the license is under MIT and was released", ""), ("license mit the under released", ""), ("A fee is charged to the person; copies of this free software are granted.", ""), ("redistribution in binary and source forms of modification", ""),
    ]
    got = {r["doc_id"]: r["labels"] for r in rows_of(license_scan.scan(docs_frame(spark, [(i, t) for i, (t, _) in enumerate(texts)])))}
    assert got == {i: label for i, (_, label) in enumerate(texts)}


# 2


@pytest.mark.parametrize("many", [False, True])
def test_top_k_by_force(spark, many):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(120)]
    rows += [(50, rows[50][1]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    sizes = {"block_rows": 16, "group_rows": 3, "blocks_per_cell": 4} if many else {}
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect())
    held = sorted({(i, tuple(np.floor(256 * np.array(v, float)).astype(int))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()})
    want = []
    for q, a in held:
        if q % 50 == 0:
            best = sorted((-int(np.dot(a, b)), i) for i, b in held if i != q and len(a) == len(b))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_prunes():
    queries = topk.Block(2, 1, np.array([0]).tobytes(), np.array([[10, 0]]).tobytes())
    blocks = [topk.Block(2, 20, np.arange(20 * k + 1, 20 * k + 21).tobytes(), np.tile([100 - 30 * k, 0], (20, 1)).tobytes()) for k in range(3)]
    q, ids, scores, scored = topk.search(queries, blocks, 5)
    assert ids.tolist() == [1, 2, 3, 4, 5] and set(scores) == {1000} and scored == 1


def test_top_k_moves_only_blocks_that_can_hold_a_result(spark):
    """Vectors that lie together by id: most pairs of a group and a block stay where they are, and no result is lost."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(i, (centres[i // 50] + rng.normal(size=8) * 0.05).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    usable = topk.usable(df, "vec_id", "embedding")
    blocks = topk.runtime.materialize(topk.pack(usable.repartitionByRange(4, "id").sortWithinPartitions("id"), 25), "blocks")
    asked = usable.filter("id % 50 = 0").repartitionByRange(20, "id").sortWithinPartitions("id")
    groups = topk.runtime.materialize(topk.pack(asked, 2).drop("low", "high"), "groups")
    n = groups.count()
    groups = groups.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
    alive = topk.survivors(topk.seeds(groups, blocks, n, 5), blocks, n)
    assert alive.count() < 0.5 * blocks.count() * groups.select("g").distinct().count()
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=25, group_rows=2, blocks_per_cell=4).collect())
    held = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    want = []
    for q in range(0, 2000, 50):
        best = sorted((-int(held[q] @ held[i]), i) for i in held if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


# 3


@pytest.mark.parametrize("source, text", [
    ("<p>a<p>b <b>c</b>", "a\n\nb c"),
    ("<ul><li>x<li>y<ol start=3><li>one<li>two</ol></ul>t", "- x\n- y\n  3. one\n  4. two\n\nt"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>", "Name      | Qty\nApple pie | 3"),
    ("<pre>a\n  b</pre>x<br>y", "a\n  b\n\nx\ny"),
    ("<div hidden>no</div><p style='display: none'>no<p style='visibility:hidden'>no<i style='visibility:visible'>yes</i>", "yes"),
    ("<head><title>t</title></head><script>var t='</p>';</script>a &amp; b<!-- no -->", "a & b"),
    ("<td>loose</td></b></table>x<", "loosex<"),
    ("", ""),
])
def test_html_layout(source, text):
    assert html_text.page_text(source)[0] == text


def test_html_is_linear_and_whole(spark):
    assert html_text.page_text("<div>" * 50_000 + "deep")[0] == "deep"
    assert html_text.page_text("<b>" * 50_000 + "x" + "</i>" * 50_000)[0] == "x"
    got = rows_of(html_text.extract(spark.createDataFrame([(1, "<p>a", 1), (2, None, 1), (1, "<p>a", 1), (None, "b", 1)], "page_id bigint, html string, n_chars int")))
    assert sorted(str((r["page_id"], r["text"])) for r in got) == sorted(map(str, [(1, "a"), (2, ""), (1, "a"), (None, "b")]))


# 4


def test_audio_digest(spark):
    got = {r["doc_id"]: r for r in rows_of(audio.audio_digest(docs_frame(spark)))}
    for i, text in dict(TEXTS).items():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert got[i]["n_bytes"] == len(raw) and got[i]["payload_bytes"] == len(payload) and got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-32:]) and got[i]["media_sha256"] == hashlib.sha256(audio.to_wav(payload, 16000)).hexdigest()
    assert got[2]["feature"] == got[3]["feature"]


def test_audio_parts(spark):
    tone = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    half = audio.resample(tone, 16000, 8000)
    peak = np.abs(np.fft.rfft(half)).argmax() * 8000 / len(half)
    assert len(half) == 8000 and abs(peak - 440) < 2 and abs(np.abs(half[200:-200]).max() - 1) < 0.02
    up = audio.resample(tone, 16000, 24000)
    assert len(up) == 24000 and abs(np.abs(np.fft.rfft(up)).argmax() - 440) < 2
    assert audio.active(np.array([0, 0.5, 0.9, 0.5, 0.3, 0.5, 1.0]), 0.6, 0.4).tolist() == [[2, 4], [6, 7]]
    windows = audio.feature_table(audio.media_table(docs_frame(spark, TEXTS[:1] + TEXTS[6:7]))).toArrow()
    assert audio.tensors(windows).to_numpy_ndarray().shape == (windows.num_rows, 64, 32)
    assert all(a < b for a, b in zip(windows.column("start_s").to_pylist(), windows.column("end_s").to_pylist()))


def test_audio_features_by_force():
    """Resampling, mel rows and segments against their definitions, sample by sample."""
    rng = np.random.default_rng(6)
    spec = audio.Spec()
    x = rng.normal(size=700)
    bank = audio._filter_bank(1, 2, spec.taps)[0]
    padded = np.concatenate([np.zeros(spec.taps - 1 - spec.taps // 2), x, np.zeros(spec.taps)])
    slow = [sum(bank[t] * padded[2 * m + t] for t in range(spec.taps)) for m in range(350)]
    half = audio.resample(x, 16000, 8000, spec.taps)
    assert np.allclose(half, slow)
    mels, energy = audio.log_mel(half, spec)
    mel, hertz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = hertz(np.linspace(0, mel(4000), spec.bands + 2))
    signal = np.concatenate([half, np.zeros((spec.frame - len(half)) % spec.hop)])
    for f in range(len(mels)):
        part = signal[f * spec.hop : f * spec.hop + spec.frame]
        assert np.isclose(energy[f], 10 * np.log10(np.mean(part**2) + 1e-10))
        wave = part * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(spec.frame) / (spec.frame - 1)))
        power = [abs(sum(wave * np.exp(-2j * np.pi * k * np.arange(spec.frame) / spec.frame))) ** 2 for k in range(spec.frame // 2 + 1)]
        for b in (0, 5, spec.bands - 1):
            total = sum(p * max(0, min((k * 8000 / spec.frame - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - k * 8000 / spec.frame) / (edges[b + 2] - edges[b + 1]))) for k, p in enumerate(power))
            assert np.isclose(mels[f, b], np.log10(total + 1e-10), atol=1e-4)
    for _ in range(50):
        level = rng.integers(0, 10, 30).astype(float)
        on, want = False, []
        low, high = level.min() + 0.4 * np.ptp(level), level.min() + 0.6 * np.ptp(level)
        for f, e in enumerate(level):
            if not on and e >= high:
                on, first = True, f
            elif on and e < low:
                on = False
                want.append([first, f])
        assert audio.active(level, 0.6, 0.4).tolist() == want + ([[first, 30]] if on else [])


def test_audio_streams_hold_tensors(spark):
    media = audio.media_table(docs_frame(spark))
    stored = rows_of(audio.feature_store(media, documents=4))
    plain = {(r["doc_id"], r["window"], r["start_s"], r["end_s"]): r["tensor"] for r in rows_of(audio.feature_table(media))}
    tables = [audio.read_features(r["stream"]) for r in stored]
    assert sum(r["documents"] for r in stored) == len(TEXTS) and all(t.num_rows == r["windows"] for t, r in zip(tables, stored))
    seen = 0
    for t in tables:
        assert t.schema.field("tensor").type == audio.pa.fixed_shape_tensor(audio.pa.float32(), (64, 32))
        held = t.column("tensor").combine_chunks().to_numpy_ndarray()
        for key, tensor in zip(zip(*(t.column(c).to_pylist() for c in ("doc_id", "window", "start_s", "end_s"))), held):
            seen += 1
            assert np.array_equal(np.array(plain[key], np.float32).reshape(64, 32), tensor)
    assert seen == audio.feature_table(media).count()


# 5


def test_forest_against_nodes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    forest = quality.fit_forest(x, y, trees=30)
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.97
    total = np.full(len(x), forest.base)
    for i, row in enumerate(x[:50]):
        for root in forest.roots:
            node = root
            while forest.left[node] != node:
                node = forest.right[node] if row[forest.feature[node]] > forest.threshold[node] else forest.left[node]
            total[i] += forest.value[node]
    assert np.allclose(1 / (1 + np.exp(-total[:50])), forest.scores(x[:50]))


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 1)], "doc_id bigint, quality int")
    got = rows_of(quality.classify(docs_frame(spark), quality.fit(docs_frame(spark), labels)))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_on_held_out_rows(spark):
    got = queries.op5_quality_trees(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.95


# 6


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mine = bpe.codec(bpe.default_vocabulary())
    hard = ["a" * 70, "ab" * 900, "İstanbul ΣΑΣ", "x\x1cy z_w ²³ ½a ١٢ Ⅷ", "é à x́", "👍🏽 ﬁ ǅ", "<|endoftext|>a<|startoftext|> <|endo", "'S 'LL don't", "K Å\xa0\x85"]
    for text in [t or "" for _, t in TEXTS] + hard:
        ids = known.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids and mine.encode_decode(text)[1] == known.decode(ids, skip_special_tokens=False) == mine.decode(ids)
    rng = random.Random(0)
    for _ in range(200):
        word = "".join(rng.choice("abcdeirstn") for _ in range(rng.randint(1, 60)))
        raw = word.encode()
        parts = [mine._inner[b] for b in raw[:-1]] + [mine._final[raw[-1]]]
        assert mine._scan(list(parts)) == mine._queue(list(parts))
    got = {r["doc_id"]: r for r in rows_of(bpe.encode_documents(docs_frame(spark)))}
    assert got[2]["n_tokens"] == 0 and got[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_bpe_equals_the_library_on_any_code_points():
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mine = bpe.codec(bpe.default_vocabulary())
    rng = random.Random(11)
    marks = [*range(0x300, 0x370), *range(0x610, 0x61B), *range(0x64B, 0x660), *range(0x8CA, 0x900), 0x9FE, 0xABC, 0x6EA]
    every = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]

    def text():
        kind = rng.random()
        if kind < 0.4:
            return "".join(chr(rng.choice(every)) for _ in range(rng.randint(1, 12)))
        if kind < 0.7:
            return "".join(chr(rng.choice(marks)) if rng.random() < 0.5 else rng.choice("aeiou اقक z") for _ in range(rng.randint(1, 12)))
        return "".join(chr(rng.randrange(1, 0x2C00)) for _ in range(rng.randint(1, 12)))

    texts = [text() for _ in range(20_000)] + [chr(c) for c in (0x558, 0x88F, 0x1C89, 0xA7CB)] + ["x" + chr(c) + "Y" for c in range(1, 0x3000)]
    for text, found in zip(texts, known.encode_batch(texts, add_special_tokens=False)):
        ids, decoded = mine.encode_decode(text)
        assert np.frombuffer(ids, "<u4").tolist() == found.ids, ascii(text)
        assert decoded == known.decode(found.ids, skip_special_tokens=False)


# 7


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 5000), (5, "http://e", "é" * 5000), (None, "http://n", "same")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id bigint, url string, html string, digest string, payload string")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows_of(warc.archive_round_trip(df, archive_bytes=9000))), key=str)
    assert got == sorted([(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 10000), (5, "response", None, 10000), (0, "revisit", 2, 4)], key=str)
    least = rows_of(warc.archive_round_trip(df, least_bytes=5))
    assert all(r["record_type"] == "response" for r in least)
    archives = warc.write_archives(warc.assign(df))
    done = warc.export(archives, f"file://{tmp_path}/out").collect()
    files = sorted((tmp_path / "out").glob("*.warc.zst"))
    assert len(files) == len(done) and all(f.stat().st_size == r["bytes"] for f, r in zip(files, sorted(done)))
    records = [r for f in files for r in warc.read_records(f.read_bytes())]
    assert sum(fields["WARC-Type"] == "response" for fields, _ in records) == 4


def test_warc_groups_hot_and_rare(spark):
    """A payload that most pages share, many pairs, and single ones: each group's largest id is the response."""
    rows = [(i, "u", "hot") for i in range(600)] + [(1000 + i, "u", f"pair {i // 2}") for i in range(700)] + [(None, "u", "hot"), (None, "u", "lone"), (None, "u", "lone")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for r in rows_of(warc.assign(df)):
        text, i = bytes(r["payload"]).decode(), r["page_id"]
        want = {"hot": 599, "lone": None}.get(text, None if text[:4] != "pair" else 1001 + 2 * int(text[5:]))
        assert r["refers_to"] == (None if i == want else want)
    assert warc.assign(df).count() == len(rows)


# 8


def test_packing_by_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs_frame(spark)).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.offset == part.length.cumsum() - part.length).all()
    for i, text in dict(TEXTS).items():
        ids = np.array(known.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece") if i is not None else got[got.doc_id.isna()]
        assert mine.length.sum() == len(ids) and (mine.length.iloc[1:] == 2048).all()
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    lengths = np.random.default_rng(2).integers(1, 900, 400)
    capacity = packing.Capacity(tokens=1000, documents=3, attention=700_000.0, rule=rule) if rule == "dot" else packing.Capacity(tokens=1000, rule=rule)
    lengths = lengths[lengths**2 <= 700_000]
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 1000 and (rule == "norm" or len(mine) <= 3 and (mine**2).sum() <= 700_000)
    if rule == "norm":
        assert len(np.unique(bins)) <= np.ceil(lengths.sum() / 1000) * 1.03


def test_best_fit_against_the_optimum():
    """Every way to pack a few pieces: best fit opens at most one bin more, and none more than first fit in that order."""
    rng = np.random.default_rng(5)

    def fewest(lengths, size):
        best = [len(lengths)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(lengths):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + lengths[k] <= size:
                    place(k + 1, bins[:b] + [bins[b] + lengths[k]] + bins[b + 1 :])
            place(k + 1, bins + [lengths[k]])

        place(0, [])
        return best[0]

    over = 0
    for _ in range(60):
        lengths = rng.integers(1, 60, rng.integers(1, 9))
        bins, _ = packing.best_fit(lengths, packing.Capacity(tokens=60))
        least = fewest(sorted(lengths.tolist(), reverse=True), 60)
        assert least <= len(np.unique(bins)) <= least + 1
        over += len(np.unique(bins)) - least
    assert over <= 6


def test_fingerprint_by_force():
    """Every bit counted shingle by shingle, as the contract words it."""
    import re

    import xxhash

    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["a", "B", "é", "İ", " ", "\n", "\x0b", "\xa0", "-"]) for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_statistics_of_plain_texts():
    """Each statistic is a finite number for any text, and equal texts have equal ones."""
    for text in [None, "", " ", "a", "A b. C!", LONG, "\n\n", "12 34", "é" * 50]:
        held = quality.statistics(text)
        assert len(held) == len(quality.STATISTICS) and np.isfinite(held).all() and list(held) == list(quality.statistics(text))


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(2049, 2048) == [(0, 1), (1, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


# 9


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def joined(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    sets = {}
    for x in list(parent):
        sets.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, sets.values()))


@pytest.mark.parametrize("most_bits", [1, 2, 3])
def test_links_by_force(spark, most_bits):
    rng = random.Random(most_bits)
    values, base = set(), rng.getrandbits(64)
    for _ in range(150):
        x = base
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        values.add(signed(x))
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint")
    want = simhash.pairs_by_force(list(values), most_bits)
    got = [tuple(r) for r in simhash.links(fps, most_bits=most_bits).collect()]
    assert sorted(got) == sorted((min(p), max(p)) for p in want)
    if most_bits < 3:
        dense = [tuple(r) for r in simhash.links(fps, most_bits=most_bits, hot_bucket=4).collect()]
        assert set(map(tuple, map(sorted, dense))) <= want and joined(dense) == joined(want)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in rows_of(components.components(spark.createDataFrame(edges, "a bigint, b bigint")))}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_simhash_classes(spark):
    got = rows_of(simhash.classes(docs_frame(spark)))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(TEXTS) and by[2]["component_id"] == by[3]["component_id"] == 2 and by[1]["component_id"] == 1 and by[2]["fp"] == 0
    assert by[None]["component_id"] is None


# 10


def test_viterbi_by_force():
    rng = np.random.default_rng(4)
    lengths = np.array([5, 1, 0, 7, 3])
    emission = rng.normal(size=(lengths.sum(), 3))
    got, at = langid.viterbi(emission, lengths, 0.7), 0
    for n in lengths:
        part = emission[at : at + n]
        if n:
            best = max(np.ndindex(*[3] * n), key=lambda p: sum(part[t, k] for t, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:])))
            assert tuple(got[at : at + n]) == best
        at += n


def test_language_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    parts = {r["lang"]: r["text"] for r in docs.filter("n_chars > 600").orderBy("doc_id").collect() if "\n" in r["text"]}
    mixed = [(1, parts["de"][:400] + " " + parts["es"][:400]), (2, None), (3, "123 !!"), (4, "привет мир"), (1, "")]
    found = rows_of(langid.spans(spark.createDataFrame(mixed, "doc_id bigint, text string"), model).orderBy("doc_id", "span"))
    assert [r["lang"] for r in found if r["doc_id"] == 1][0] == "de" and "es" in [r["lang"] for r in found if r["doc_id"] == 1]
    got = rows_of(langid.identify(spark.createDataFrame(mixed, "doc_id bigint, text string"), model))
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3)} == {"und"} and [r for r in got if r["doc_id"] == 4][0]["lang_pred"] in model.languages


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = ["½ ²", "Ⅷ 12", "①②", "١٢ ३", "a\u0301"[1:], "!? 7", "a", "²a", "हिन्दी"]
    got = {r["doc_id"]: r["lang_pred"] for r in rows_of(langid.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string"), model))}
    assert [got[i] for i in range(len(odd))][:6] == ["und"] * 6 and "und" not in [got[i] for i in (6, 7, 8)]
    assert langid.words_of("हिन्दी Ünï ½a") == ["हिन्दी", "ünï", "a"] and langid.words_of("e\u0301t ½a²b") == ["e\u0301t", "a", "b"]


def test_rare_languages_keep_their_model(spark):
    """A language of few rows keeps its trigrams and scripts beside one of many."""
    rng = random.Random(2)
    many = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)), "xx") for i in range(200)]
    few = [(1000 + i, "привет мир добрый день", "ru") for i in range(2)] + [(2000, "γεια σου κόσμε", "el")]
    learnt = spark.createDataFrame(many + few, "doc_id bigint, text string, lang string")
    model = langid.fit(learnt, grams_per_language=50)
    assert model.languages == ["el", "ru", "xx"] and model.allowed.any(axis=0).all()
    got = {r["doc_id"]: r["lang_pred"] for r in rows_of(langid.identify(spark.createDataFrame([(1, "добрый"), (2, "κόσμε")], "doc_id bigint, text string"), model))}
    assert got == {1: "ru", 2: "el"}


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, repeats, long texts, no labels, no languages, empty tables."""
    import corpus_pipeline as P

    schema = "doc_id bigint, text string, lang string, source string, n_chars int, score double, predicted int, row string"
    long = "the quick brown fox jumps over the lazy dog " * 20_000
    rows = [(1, "a plain text of words", None, None, None), (1, "a plain text of words", None, None, None), (None, None, None, None, None), (2, "", None, "s", 0), (3, long, None, "s", None), (4, "123 ½", None, None, 4)]
    docs = spark.createDataFrame([(*r, 1.0, 1, "x") for r in rows], schema)
    none = docs.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0, name
    kept = P.identify_language(spark, docs, SF)
    assert kept.columns == list(P.COLUMNS) and sorted(r["doc_id"] for r in rows_of(kept)) == [1, 1, 3]
    judged = rows_of(P.judge_quality(spark, docs, SF))
    assert len(judged) <= len(rows) and judged.count([r for r in judged if r["doc_id"] == 1][0] if any(r["doc_id"] == 1 for r in judged) else None) in (0, 2)
    deduped = P.drop_near_duplicates(spark, docs, SF)
    assert deduped.columns == list(P.COLUMNS) and sorted(str(r["doc_id"]) for r in rows_of(deduped)) == ["1", "2", "3", "4"]
    packed = rows_of(P.pack_sequences(spark, docs, SF))
    assert sum(r["length"] for r in packed if r["doc_id"] == 3) == 9 * 20_000 + 2 and len([r for r in packed if r["doc_id"] is None]) == 1


def test_language_on_held_out_rows(spark):
    got = queries.op10_language_spans(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 100 and (got.lang_pred == got.lang).mean() > 0.97


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    held = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in held.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(sorted(df.columns)).collect()) == sorted(str(tuple(r[i] for i in order)) for r in held.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = P.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns and first.count() > 0.95 * docs.count()
    copies = docs.limit(20).unionByName(docs.limit(20).withColumn("doc_id", F.col("doc_id") + 10_000))
    kept = P.drop_near_duplicates(spark, copies, SF)
    assert kept.filter("doc_id >= 10000").count() == 0
    packed = P.run(spark, SF)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() > 50


@pytest.mark.parametrize("hot_bucket", [64, 3])
def test_near_copies_by_force(spark, hot_bucket):
    rng = random.Random(hot_bucket)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=30)
    texts = ["", None, "one two", "one two"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(30, 200)) + (passage if rng.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            now = list(base)
            for _ in range(rng.randint(1, 5)):
                now[rng.randrange(len(now))] = rng.choice(words)
            texts.append(" ".join(now))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0}
    by = {}
    for r in rows_of(near_copies.classes(docs, hot_bucket=hot_bucket)):
        by.setdefault(r["component"], []).append(r["doc_id"])
    assert sorted(sorted(x) for x in by.values() if len(x) > 1) == joined(want) and len(want) > 20


def test_pipeline_drops_copies_with_edits(spark):
    import corpus_pipeline as P

    base = [f"word{k}" for k in range(120)]
    edited = base[:30] + ["other"] + base[31:80] + ["another"] + base[81:]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base[60:] + base[:20]))], "doc_id bigint, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("int")})
    assert sorted(r["doc_id"] for r in rows_of(P.drop_near_duplicates(spark, docs, SF))) == [1, 3]


def test_pipeline_drops_copies_without_an_id(spark):
    import corpus_pipeline as P

    rows = [(None, "a copy without an id"), (5, "a copy without an id"), (None, "only without an id"), (None, "only without an id"), (7, "one text under the id"), (7, "quite another text under it"), (7, "one text under the id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("int")})
    got = sorted((str(r["doc_id"]), r["text"]) for r in rows_of(P.drop_near_duplicates(spark, docs, SF)))
    assert got == [("5", "a copy without an id"), ("7", "one text under the id"), ("7", "quite another text under it"), ("None", "only without an id")]


def test_pipeline_rejects_texts_without_a_language(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    rng = random.Random(8)
    gibberish = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(200))
    english = docs.filter("lang = 'en'").orderBy("doc_id").first()["text"]
    odd = [(-1, "привет мир и всем добрый день " * 20), (-2, "καλημέρα κόσμε " * 20), (-3, gibberish), (-4, english), (-5, "123 !!"), (-6, gibberish[:60])]
    extra = spark.createDataFrame(odd, "doc_id bigint, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)})
    kept = P.identify_language(spark, docs.unionByName(extra), SF)
    assert [r["doc_id"] for r in rows_of(kept.filter("doc_id < 0"))] == [-4]
    assert kept.filter("doc_id >= 0").count() > 0.99 * docs.count()


@pytest.mark.parametrize("source, text", [
    ("a <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> b", "a x=2 b"),
    ("<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><text>North</text><text>South</text>no</svg> b", "North South b"),
    ("<p>Pick <select><optgroup label=Fruit><option>Apple<option selected>Pear</select>", "Pick\nFruit\nApple\nPear"),
    ("<textarea>\na\n  b &lt;</textarea>", "a\n  b <"),
    ("<head><title>T</title>Hello<p>x", "Hello\n\nx"),
    ("<head> <title>T</title> <meta name=a> </head>y", "y"),
    ("<svg><title/><text>A</text></svg>z<svg/>w", "Azw"),
])
def test_html_shows_what_browsers_show(source, text):
    assert html_text.page_text(source)[0] == text


@pytest.mark.parametrize("source, text", [
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A | b\n  | c\nd | e"),
    ("<ol reversed><li>a<li>b</ol><ol><li value=5>x<li>y</ol><ol type=i><li>p<li>q</ol>", "2. a\n1. b\n\n5. x\n6. y\n\ni. p\nii. q"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("<style>.x, #y{display:none} p.z{display:none} @media print{b{display:none}} i{visibility:hidden}</style><p class='a x'>no<p id=y>no<p class=z>yes <b>B</b> <i>no</i>", "yes B"),
    ("<pre>\na\n</pre>", "a"),
    ("<input type=submit value=Go><input value=v type=text><input type=hidden value=h>", "Go v"),
    ("a < b <3 </ x> c <? php> d <!doctype html> e<![CDATA[ f ]]>", "a < b <3 c d e f"),
    ("t<a href='1", "t"),
    ("<ul><li><ul><li>deep</ul>after</ul>", "- - deep\n  after"),
    ("<div hidden style='display:block'>shown</div>", "shown"),
])
def test_html_layout_of_less_common_markup(source, text):
    assert html_text.page_text(source)[0] == text


#: Markup that grows costly where a parser looks for the same thing again and again.
HOSTILE = {
    "quote": ("<a ", '"'), "quotes": ("<blockquote>x", ""), "items": ("<ul><li>x", ""), "tables": ("<table><tr><td>a<td>b", ""), "comments": ("<!--", ""), "marks": ("<", ""),
    "ends": ("</b>", ""), "paragraphs": ("<p><b>", ""), "links": ("<a>", ""), "spans": ("<td colspan=1000 rowspan=900>x<tr>", ""), "scripts": ("<script>", ""), "sheets": ("<style>a{", ""),
    "rules": ("/*{", ""), "attributes": ("<a " + "x " * 50, ">y"), "headings": ("<h1>", ""), "svg": ("<svg><text>a", ""), "data": ("<![CDATA[", ""), "ampersands": ("&am", ""),
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_a_megabyte_of_hostile_markup(name):
    import time

    part, last = HOSTILE[name]
    head = {"spans": "<table>", "rules": "<style>"}.get(name, "")
    began = time.process_time()
    html_text.page_text(head + part * (1_000_000 // len(part)) + last)
    assert time.process_time() - began < 20  # seconds; in proportion to the page, where squares take hours


def test_html_against_the_standard_parser():
    """Random pages: the words are those that the standard library's tokeniser sees, in its order."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            self.words += [] if self.skip else data.split()

    rng = random.Random(9)
    inline, blocks = ["b", "i", "em", "span", "a href='x?a=1&amp;b=2'", "code class=\"k\""], ["p", "div", "section", "h2", "blockquote", "article"]

    def flow(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4 or depth > 4:
                out.append(" ".join(rng.choices(["alpha", "beta", "&lt;x&gt;", "caf&eacute;", "a&nbsp;b", "1 < 2"], k=rng.randint(1, 5))) + " ")
            elif kind < 0.6:
                tag = rng.choice(inline)
                out.append(f"<{tag}>{flow(depth + 2)}</{tag.split()[0]}>")
            elif kind < 0.7:
                out.append("<script>if (a < b) x('</p>');</script><!-- no <p> -->")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{flow(depth + 1)}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(1, 3))) + "</ul>")
            else:
                tag = rng.choice(blocks)
                out.append(f"<{tag}>{flow(depth + 1)}</{tag}>")
        return "".join(out)

    for _ in range(300):
        source = "<title>t</title>" + flow(0)
        told = Words()
        told.feed(source)
        told.close()
        got = [w for line in html_text.page_text(source)[0].split("\n") for w in line.split()]
        assert "".join(w for w in got if w != "-") == "".join(told.words), source


def test_tables_line_up():
    """Random grids without spans: every separator of a table stands in one column."""
    rng = random.Random(4)
    for _ in range(100):
        across = rng.randint(1, 5)
        rows = [["".join(rng.choices("abc日 ", k=rng.randint(0, 9))).strip() or "x" for _ in range(across)] for _ in range(rng.randint(1, 6))]
        source = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in rows) + "</table>"
        widths = [max(html_text._width(" ".join(row[k].split())) for row in rows) for k in range(across)]
        want = []
        for row in rows:
            cells = [" ".join(c.split()) for c in row]
            want.append(" | ".join(c + " " * (w - html_text._width(c)) for c, w in zip(cells, widths)).rstrip())
        assert html_text.page_text(source)[0] == "\n".join(want).strip("\n")


def test_audio_frames_cover_the_end():
    spec = audio.Spec()
    for more in range(1, spec.hop + 2):
        signal = np.zeros(spec.frame + more)
        signal[-spec.hop :] = 1.0
        mels, energy = audio.log_mel(signal, spec)
        assert len(mels) == 1 + -(-more // spec.hop) and energy.argmax() == len(energy) - 1
