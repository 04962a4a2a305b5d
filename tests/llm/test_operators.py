"""The operators against plain versions on a small fixture with odd rows, and their special cases."""

import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from tablegate.llm import (bpe, classifier, common, decontaminate, graph, license_scan, line_dedup, packing,
                           quality_rules, simhash, substring_dedup, suffix_dedup, token_counts)

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, source string, tag string, spans int, words double, h long"


def texts():
    """Copies, near copies, shared passages, periodic and odd texts, nulls and empty texts."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() + rnd.choice(["", "", ",", ".\n"]) for _ in range(n))
    passage, long = prose(60), prose(3000)
    out = [None, "", " \n\t", "one", "One two", "a" * 700, "ab " * 300, "x\x0by\x1cz\xa0 w", "<|endoftext|> a <|endoftext|>",
           "Ünï çödé «»  字字 　 tail", long, long + " end", passage, passage]
    for _ in range(25):
        at = rnd.randint(0, 200)
        body = prose(rnd.randint(5, 300))
        out += [body, body[:at] + "X" + body[at:], prose(20) + " " + passage + " " + prose(rnd.randint(0, 30))]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 7 % 1000, t) for i, t in enumerate(texts(), 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, f"s{i % 13}", "x", 1, 0.5, 3) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_suffix_dedup(docs, rows, empty):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    for crowd in (20_000, 2):  # collections alone, and crowded anchors by their windows
        assert got(suffix_dedup.suffix_dedup(docs, crowd=crowd), *columns) == brute.op1(rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_columns_sort_all_suffixes():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        length = rnd.integers(1, 12, rnd.integers(1, 9))
        flat = rnd.integers(1, 4, length.sum())
        parts = np.split(flat, np.cumsum(length)[:-1])
        symbols, prefixes, origins = suffix_dedup.columns(flat, length)
        suffixes = sorted((tuple(p[len(p) - k:]) + (-1, i), i, k) for i, p in enumerate(parts) for k in range(len(p) + 1))
        assert [(o >> 8, o & 255) for o in origins.tolist()] == [(i, k) for _, i, k in suffixes]
        assert symbols.tolist() == [0 if k == len(parts[i]) else parts[i][len(parts[i]) - k - 1] for _, i, k in suffixes]
        for (a, i, _), (b, j, _), n in zip(suffixes, suffixes[1:], prefixes[1:]):
            common_ = next(x for x in range(len(a)) if a[x] != b[x] or a[x] == -1)
            assert n == common_


def test_substring_dedup(docs, rows, empty):
    found = substring_dedup.substring_dedup(docs)
    assert got(found, "doc_id", "n_words", "n_removed", F.sha2("clean_text", 256)) == brute.op9(rows)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_simhash(docs, rows, empty):
    found = simhash.simhash_groups(docs)
    assert got(found, "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id") == brute.op4(rows)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute.op4(rows)})
    assert simhash.simhash_groups(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def test_links_of_dense_and_split_tiles(spark, monkeypatch):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = {0, 2 ** 64 - 1, *base}
    for _ in range(400):
        fp = rnd.choice(base)
        for _ in range(rnd.randint(0, 5)):
            fp ^= 1 << rnd.randrange(64)
        fps.add(fp)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    label = {f: f for f in fps}

    def find(f):
        while label[f] != f:
            f = label[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3:
                low, high = sorted((find(a), find(b)))
                label[high] = low
    for tile, visitors in ((1 << 13, 1 << 17), (3, 7)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "VISITORS", visitors)
        edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
        roots = {r.node: r.root for r in graph.components(edges).collect()}
        assert {f: roots.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(i, 0) for i in range(1, 61)}


def test_decontaminate(spark, docs, rows, empty, monkeypatch):
    words = brute.LETTERS.findall(brute.lower(rows[12][1]))
    items = [(3, " ".join(words[5:30])), (1, "ONE two"), (2, "one"), (None, None), (7, ""), (10, " ".join(words[5:30]).upper()),
             (11, "nothing of this kind"), (12, "-- !")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute.op5(rows, items)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.judged(docs, benchmark), *columns) == want
    monkeypatch.setattr(decontaminate, "BLOCK", 40)  # several blocks
    assert got(decontaminate.judged(docs, benchmark), *columns) == want
    clean = decontaminate.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[5])
    longest = decontaminate.matches(docs.where(f"doc_id = {rows[12][0]}"), benchmark).first().matches
    assert (5, 25) in {(m.start, m.n_words) for m in longest if m.item_id == 3}
    assert decontaminate.judged(empty, benchmark).count() == 0
    assert decontaminate.judged(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_a_plan_holds_one_block_of_the_benchmark(spark, docs, rows, monkeypatch):
    words = brute.LETTERS.findall(brute.lower(rows[12][1]))
    items = [(i, " ".join(words[i:i + 12])) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK", 40)
    assert len(list(decontaminate.blocks(benchmark, 10))) > 2
    found = decontaminate.matches(docs, benchmark)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert got(decontaminate.judged(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256",
               "contaminated") == brute.op5(rows, items)


def test_token_counts_and_cache(spark, docs, rows, empty, tmp_path):
    cache = f"file://{tmp_path}/cache"
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got(token_counts.token_counts(docs.limit(20), WORDS, cache), *columns)
    stored = spark.read.parquet(cache).count()
    assert got(token_counts.token_counts(docs, WORDS, cache), *columns) == brute.op7(rows)
    kept = spark.read.parquet(cache)
    assert stored <= kept.count() == kept.select("digest").distinct().count()  # only misses were encoded
    assert token_counts.token_counts(empty, WORDS).count() == 0


def test_ids_equal_the_library():
    rnd = random.Random(9)
    parts = ["a", "Bé", " ", "  ", "\n", "\t", "\xa0", " ", "'s", "!", "..", "3", "字", "<|endoftext|>", "<|startoftext|>",
             "é", "Σ", "\x1c", "ſ", "word", ",", "̸", "İ", "$%&", "é#", "²", "ª", "x" * 60]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    for path, joined in ((BYTES, True), (WORDS, False)):
        encoder = bpe.Encoder(path, joined)
        assert encoder.ids(odd) == encoder.library_ids(odd)


def test_packing(docs, rows, empty):
    packed = packing.best_fit_packing(docs, BYTES).collect()
    used, lengths = brute.check_packing(rows, packed)
    assert used <= brute.best_fit_decreasing(lengths)
    assert packing.best_fit_packing(empty, BYTES).count() == 0


def test_steps_are_best_fit_decreasing():
    rnd = random.Random(4)
    for _ in range(60):
        lengths = [rnd.randint(1, 64) for _ in range(rnd.randint(1, 150))]
        plan = packing.steps({n: lengths.count(n) for n in set(lengths)}, 64)
        ends = {}
        for length in set(lengths):
            for rank in range(lengths.count(length)):
                step = max((s for s in plan.tolist() if s[0] == length and s[1] <= rank), key=lambda s: s[1])
                ends.setdefault(step[2] + (rank - step[1]) // step[3], []).append(
                    (step[4] + (rank - step[1]) % step[3] * length, length))
        for places in ends.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 64
        assert len(ends) == brute.best_fit_decreasing(lengths, 64)


@pytest.mark.parametrize("sql, run", [
    (quality_rules.SQL, lambda d: quality_rules.quality_rules(d).drop("clean_text")),
    (line_dedup.SQL.replace(">= 10", ">= 4"), lambda d: line_dedup.line_dedup(d, 4, counts=True).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")))])
def test_native_operators_equal_their_sql(docs, rows, empty, sql, run):
    documents = docs.toPandas()  # noqa: F841
    lines = documents["text"].notna()
    documents.loc[lines, "text"] += "\nshared line | a > b | c\nPlease accept cookies"
    found = run(docs.sparkSession.createDataFrame(documents, SCHEMA))
    connection = duckdb.connect()
    connection.register("documents", documents.astype({"text": object}).where(documents.notna(), None))
    want = connection.execute(f"SELECT {', '.join(sorted(found.columns))} FROM ({sql})").fetchall()
    plain = lambda rows: sorted(str(tuple(None if x != x else x for x in r)) for r in rows)
    assert plain(found.select(*sorted(found.columns)).collect()) == plain(want)
    assert run(empty).count() == 0


def test_license_scan(spark, docs, empty):
    given = {1: "Text.\n\nReleased under the MIT License.\nmore", 2: "This work is licensed under the GNU General Public License, version 2.",
             3: "All licensed drivers", 4: None, 5: "Licensed under CC BY 4.0 now\n\n" + "w " * 20000 + "\n\nLicensed under the Apache License, Version 2.0."}
    found = license_scan.license_scan(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in found} == {
        (1, "MIT"), (2, "GPL-2.0"), (3, None), (4, None), (5, "CC-BY-4.0"), (5, "Apache-2.0")}
    for r in found:
        if r.license:
            assert r.missing == 0 and r.saved > 0.3 and r.license[:2].lower() in given[r.doc_id][r.start:r.end].lower().replace("gnu general public", "gp")
    assert license_scan.license_scan(docs).select("doc_id").distinct().count() == docs.count()
    assert license_scan.license_scan(empty).count() == 0


def test_lines_of_whole_copies_stay(spark, docs):
    copied = "First line of a copied page.\nshared line\nLast line of it."
    rows = [(i, copied, f"c{i}", "x", 1, 0.5, 3) for i in range(2000, 2015)]
    rows += [(i, f"Body {i % 12}\nshared line", f"s{i % 12}" if i % 5 else None, "x", 1, 0.5, 3) for i in range(3000, 3040)]
    frame = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame, "").collect()}
    assert {kept[i] for i in range(2000, 2015)} == {"First line of a copied page.\nLast line of it."}
    assert all(kept[i] == f"Body {i % 12}" for i in range(3000, 3040))
    for least in (4, 10, 12, 13):
        out = line_dedup.line_dedup(frame, least, distinct_texts=True).select("doc_id", "text").collect()
        assert sorted(map(str, out)) == sorted(map(str, brute.op3(frame.collect(), least)))


def licenses(text):
    """Rows of one text without Spark: places and licences."""
    frame = next(license_scan._scan(iter([pd.DataFrame({"doc_id": [1], "text": [text]})])))
    return [(r.start, r.end, r.license) for r in frame.itertuples() if isinstance(r.license, str)]


@pytest.mark.parametrize("name, notice", [
    ("BSD", "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided "
            "that the following conditions\n are met:"),
    ("BSD", "# Redistribution\n# and use in source and binary forms, with or without modification,\n# are permitted "
            "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."),
    ("MIT", "Released under\nthe MIT\nLicense"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and "
                 "associated documentation files (the \"Software\"),\nto deal in the Software without restriction"),
    ("GPL-3.0", "This work is\nlicensed under the GNU General Public\nLicense,\nversion 3")])
def test_wrapped_notices(name, notice):
    assert [x[2] for x in licenses(notice)] == [name]
    assert [x[2] for x in licenses(f"Some text.\n\n{notice}\n \nmore text")] == [name]
    assert list(license_scan.blocks(f"a\n\n{notice}\nb\n\nc")) == [(3, len(notice) + 5)]


@pytest.mark.parametrize("name", ["MIT", "CC-BY-4.0", "Apache-2.0", "GPL-3.0", "MIT-text", "BSD"])
def test_notices_in_long_lines(name):
    rnd = random.Random(8)
    known = ["".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    for size in (700, 5_000, 10_000, 17_000, 17_000):
        words = [known[int(600 * rnd.random() ** 2)] for _ in range(size // 6)]
        words.insert(rnd.randrange(len(words)), license_scan.TEMPLATES[name][0] + ".")
        assert [x[2] for x in licenses(" ".join(words))] == [name]


def test_every_notice_of_a_block_is_a_row():
    text = "Released under the MIT License.\nLicensed under CC BY 4.0."
    assert licenses(text) == [(0, 30, "MIT"), (32, 56, "CC-BY-4.0")]
    notices = [(name, t) for name, (t, _) in license_scan.TEMPLATES.items()] * 2
    random.Random(3).shuffle(notices)
    for gap in (" x\n", "\n" + "prose without a notice\n" * 40):  # one block, and pieces of one
        text, want = "", []
        for name, notice in notices:
            want.append((len(text), len(text) + len(notice), name))
            text += notice + gap
        assert licenses(text) == want
    assert [x[2] for x in licenses("Dual licensed under the MIT License and CC BY 4.0")] == ["CC-BY-4.0", "MIT"]
    assert [x[2] for x in licenses("Dual licensed under CC BY 4.0 and the MIT License")] == ["CC-BY-4.0", "MIT"]
    for cut in range(17_900, 20_100, 37):  # across the pieces of a long paragraph
        text = "w " * (cut // 2) + license_scan.TEMPLATES["Apache-2.0-header"][0] + " w" * 6000
        assert [x[2] for x in licenses(text)] == ["Apache-2.0-header"]


def test_license_scan_equals_a_plain_version():
    rnd = random.Random(11)
    terms = [*license_scan.TEMPLATES.items()]
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            words = rnd.choice(terms)[1][0].split()
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(words))
                words[k:k + rnd.randint(0, 1)] = [rnd.choice(["odd", "the", "License", words[k]])] * rnd.randint(0, 1)
            parts.append(" ".join(words))
            parts.append(rnd.choice(["\n", " ", "\n\n", ". text of the version\n"]))
        text = "".join(parts)
        for paragraph in text.split("\n\n"):
            found = {x[2] for x in licenses(paragraph)}
            fits = brute.op2(paragraph, license_scan.TEMPLATES)
            relatives = {n: frozenset(license_scan.TEMPLATES[n][1].split()) for n in fits}
            assert found <= fits and bool(found) == bool(fits and license_scan.CUE.search(paragraph))
            for name in fits - found if found else ():  # given up for a relative only
                assert any(relatives[name] & relatives[x] for x in found), (name, found, paragraph)


def test_classifier(spark, docs, empty):
    rnd = random.Random(1)
    prose = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + rnd.choice(["", ".\n"]) for _ in range(80))
    rows = [(i, prose() if i % 3 else " ".join(w + "$$$ ###" for w in prose().split())) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    model = classifier.train(frame, labels, max_rows=200)
    found = classifier.scored(frame, model).collect()
    held = [r for r in found if r.held_out]
    assert 40 < len(held) < 140 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert classifier.accepted(frame, labels).where("doc_id % 3 = 0").count() < 5
    assert classifier.scored(docs, model).where("score IS NULL").count() == 0
    assert classifier.scored(empty, model).count() == 0
    nothing = classifier.train(empty, labels.limit(0))
    assert classifier.scored(frame, nothing).select("score").distinct().collect() == [(0.5,)]


def test_repeated_rows_null_ids_and_clashing_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, text), (2, text + " tail")], "doc_id long, text string")
    for run, removed in ((substring_dedup.substring_dedup, "n_words"), (suffix_dedup.suffix_dedup, "n_bytes")):
        found = [(r.doc_id, r.n_removed) for r in run(frame).collect()]
        assert sorted(i or 0 for i, _ in found) == [0, 0, 1, 1, 2, 2]
        assert all(n == 0 for i, n in found if i is None) and all(n > 0 for i, n in found if i is not None)
    assert simhash.simhash_groups(frame).where("component_id = 1 AND doc_id IS NULL").count() == 1
    assert line_dedup.line_dedup(frame.withColumn("source", F.lit(None).cast("string"))).count() == 6
    assert packing.best_fit_packing(frame, BYTES).where("doc_id IS NULL").count() == 2
    assert token_counts.token_counts(frame, WORDS).count() == 6


def test_stages_of_the_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
        if name == "SimHash near-dedup":
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for *_, c in brute.op4(
                [(r.doc_id, r.text) for r in before.collect()])})
        if name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            dirty = {w[0] for w in brute.op5([(r.doc_id, r.text) for r in before.collect()], items) if w[5]}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - dirty
    brute.check_packing([(r.doc_id, r.text) for r in before.collect()], docs.collect())
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
    assert common.shared_folder(spark)
