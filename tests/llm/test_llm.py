"""The training-data operators against brute force, exact round trips and held-out labels, and on odd tables."""

from __future__ import annotations

import functools
import hashlib
import random
import shutil
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.llm import decontaminate as D
from narrata.llm import html_text as H
from narrata.llm import jaccard_join as J
from narrata.llm import licenses as L
from narrata.llm import mixing as M
from narrata.llm import quality_classifier as C
from narrata.llm import quality_rules as Q
from narrata.llm import substring_dedup as S
from narrata.llm import token_store as T
from narrata.llm import warc as W
from narrata.llm.components import components
from tests.oracle import assert_same, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, kept boolean"


def sentence(rng, n):
    return " ".join(rng.choice("the of and house river walked green seven mountain letter carried window always morning paper stone".split()) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "   \n\t ", "one", "one two three four", base, base, " ".join(near), long, sentence(rng, 40), "ünï cödé 文字 \U0001f600 " * 20, "a\nb\na\nb\n" * 30]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "k", False) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 3, None, None, None), (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (8, "another text of the same id " * 5, "en", None, None, 1.0, "x", True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


# -- 1 ----------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4))
    model = C.fit(docs, labels.filter(part > 0))
    assert sum(model.exchanged) > 0
    got = C.score(docs, model).join(labels.filter(part == 0), "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.93
    assert all(r["kept"] for r in got if r["quality"] == 1)


def test_exchange_covers_all_documents_in_any_order(spark):
    """Pseudo-labels against the most confident of all unlabelled documents, and the same model from any partitions."""
    rng = random.Random(15)
    rows = [(i, sentence(rng, 30), "en", f"s{i % 3}", 150) for i in range(800)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    rows = [(i, t if i % 2 else "### !!! " * (5 + i % 7), *r) for i, t, *r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    models = [C.fit(spark.createDataFrame(spark.sparkContext.parallelize(part, n), schema), labels, each=30) for part, n in ((rows, 8), (rows[::-1], 3))]
    assert models[0].exchanged == models[1].exchanged and models[0].exchanged[0] > 0
    assert np.array_equal(models[0].models[0].w, models[1].models[0].w) and np.array_equal(models[0].weights, models[1].weights)
    # the choice itself, over all rows
    logits = np.random.default_rng(3).normal(0, 4, len(rows))
    keys = np.arange(len(rows))
    part = [C.counted(logits[k::5], 2.0) for k in range(5)]
    level = C.level_for(sum(part, Counter()), 40)
    chosen = {k for k in keys.tolist() if C.bins(logits[k : k + 1])[0] >= level}
    sure = np.sort(np.abs(logits))[::-1]
    assert 40 <= len(chosen) < 60 and min(abs(logits[k]) for k in chosen) == sure[len(chosen) - 1]


def test_classifier_on_odd_tables(spark, odd, empty):
    none = C.fit(odd, spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int"))
    assert none is None and all(r["kept"] and r["score"] == 1 for r in C.score(odd, none).collect())
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, sentence(rng, 50) if i % 3 else "### !!! " * 40, "en", "s", 1, None, None, None) for i in range(90)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)] + [(0, 1, 0), (None, 1, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    model = C.fit(docs, labels)
    assert [r["doc_id"] for r in C.score(docs, model).filter("not kept").orderBy("doc_id").collect()] == list(range(0, 90, 3))
    assert C.score(odd, model).count() == odd.count() and C.score(empty, model).count() == 0
    kept = C.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 60 and C.keep_good(odd, model).columns == odd.columns


# -- 2 ----------------------------------------------------------------------------------------------------------


def expected_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.default_tokenizer())
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in rows]


def test_store_round_trip(spark, odd, empty):
    got = T.store_and_read(odd).collect()
    want = expected_tokens([(r["doc_id"], r["text"]) for r in odd.collect()])
    digest = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(((d, len(i), digest(i)) for d, i in want), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):  # documents lie one after the other, in ascending order
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)
    assert T.store_and_read(empty).count() == 0


def test_store_keeps_chunks_once_and_finds_damage(spark, tmp_path):
    rng = random.Random(2)
    text = sentence(rng, 4000)
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "start " + text)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    T.write_store(docs, path, T.default_tokenizer(), 2, 49_408, True)
    chunks = T.stored_chunks(spark, path)
    assert chunks.count() == chunks.select("chunk_id").distinct().count() < 2 * spark.read.parquet(f"{path}/recipes").agg(F.max(F.size("chunk_ids"))).first()[0]
    ids = {r["doc_id"]: list(r["ids"]) for r in T.read_ids(spark, path, 49_408).collect()}
    assert ids == dict(expected_tokens([(r["doc_id"], r["text"]) for r in docs.collect()]))
    top = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("level")).first()
    assert len(top["digest"]) == 64
    assert len(T.verify_manifest(spark, path)) == 64
    recipes = spark.read.parquet(f"{path}/recipes")
    for k, change in enumerate(({"start": F.col("start") + 1}, {"doc_id": F.col("doc_id") + 1}, {"n_tokens": F.col("n_tokens") - 1}, {"root": F.unhex(F.lit("00" * 32))})):
        damaged = f"file://{tmp_path}/damaged{k}"
        shutil.copytree(f"{tmp_path}/store", f"{tmp_path}/damaged{k}", ignore=shutil.ignore_patterns("recipes"))
        recipes.withColumns(change).write.parquet(f"{damaged}/recipes")
        with pytest.raises(ValueError, match="don't match the manifest"):
            T.read_digests(spark, damaged, 49_408)
    bad = chunks.withColumn("payload", F.concat("payload", F.lit(b"\0\0")))
    with pytest.raises(Exception, match="doesn't match its address"):
        bad.mapInArrow(T._verify(False), T.CHECKED).collect()


def test_encoder_equals_the_tokenizer_on_strange_texts():
    e = T.Encoder(T.default_tokenizer(), True, "<u2")
    texts = ["Hello, World... don't I'll A.B, c!, <|endoftext|> x<|ENDOFTEXT|>", "ΣΑΣ Σ, İstanbul, ǅ ﬁ", "é x ́y", "a\tb\r\nc d e", "....,,, 12.5, $%& _x_ __", "ÀÉ, Ñandú. straße, µ", "文字。テスト, ٣٤ ²", "", " ", "x" * 300 + "," + "y"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abAB'’.,!?#*$%&;: \n\té文Σ<|>0_-") for _ in range(60)) for _ in range(300)]
    # letters that lower-case to more than letters, marks of all kinds, letters of many scripts
    strange = "aIé\u0130\u0130\u0131\u0307\u0301\u0345\u1e9e\u01c5\ufb01\u00df\u00aa\u00b5Σς文\u0e33\u0915\u093f\u200d.,;:!?#*$%&' -"
    texts += ["".join(rng.choices(strange, k=rng.randint(1, 12))) for _ in range(100_000)]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(b, dtype="<u2").tolist() for b in e.ids(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_crc_of_parts():
    rng = random.Random(4)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 300)), rng.randbytes(rng.randint(0, 300))
        assert T.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# -- 3 ----------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = M.mixture(docs, labels, {(1, 0): 0.6, (1, 1): 0.2, (0, 0): 0.15, (0, 1): 0.05}).toPandas()
    total = got["n_tokens"].sum()
    share = {c: (got["n_tokens"] * got["rate"] * got[c]).sum() / total for c in ("p_q1t0", "p_q1t1", "p_q0t0", "p_q0t1")}
    assert all(abs(share[c] - w) < 0.01 for c, w in zip(share, (0.6, 0.2, 0.15, 0.05), strict=True))
    assert (got["rate"] >= 0).all() and np.allclose(got[list(share)].sum(axis=1), 1)


def test_mixing_leaves_columns_of_its_own_names(spark):
    rng = random.Random(4)
    names = "rate string, p string, n_tokens string, copies string, copy string, b_symbols string, row string, _m_t string"
    docs = spark.createDataFrame([(i, sentence(rng, 30) if i % 2 else "### $$$ " * 20, *["mine"] * 8) for i in range(80)], f"doc_id long, text string, {names}")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = M.mix(docs, labels)
    assert got.columns == docs.columns and got.count() > 0
    assert all(tuple(r)[2:] == ("mine",) * 8 for r in got.collect())
    out = M.mixture(docs, labels)
    assert {r["residual"] < 0.05 for r in out.collect()} == {True} and out.filter("doc_id % 2 = 0 and copies > 0").count() == 0


def test_mixing_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 0), (9, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert M.mixture(odd, labels).count() == odd.count() and M.mixture(empty, labels).count() == 0
    assert all(abs(r["rate"] - 1) < 1e-6 for r in M.mixture(odd, none).collect())
    mixed = M.mix(odd, none)
    assert mixed.columns == odd.columns and pairs(mixed) == pairs(odd)


# -- 4 ----------------------------------------------------------------------------------------------------------


def test_licences(spark, odd, empty):
    rng = random.Random(6)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-NC 4.0."]
    texts = [sentence(rng, 60) + "\n" + (lines[i % 4] if i % 2 else "only a licence to fish was granted by the public office") + "\n" + sentence(rng, 30) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = {(r["doc_id"], r["line"]): r for r in L.licences(docs).collect()}
    family = ["mit", "apache-2.0", "gpl", "cc-by-nc"]
    assert {k: (r["family"], r["confirmed"]) for k, r in got.items()} == {(i, 1): (family[i % 4], True) for i in range(1, 40, 2)}
    assert L.licences(empty).count() == 0


def test_licences_wrapped_over_lines(spark):
    rng = random.Random(16)
    whole = {"mit": L.TEMPLATES["mit"][2], "apache-2.0": L.TEMPLATES["apache-2.0"][2], "gpl": L.TEMPLATES["gpl"][1]}
    docs, expected = [], {}
    for k, (family, notice) in enumerate(whole.items()):
        for j, (width, sign, end) in enumerate([(70, "", "\n"), (70, " * ", "\n *\n"), (40, "# ", "\n#\n"), (1, "", "\n\n")]):
            wrapped = "\n".join(sign + x for x in textwrap.wrap(notice, width, break_long_words=False))
            docs.append((10 * k + j, sentence(rng, 60) + end + wrapped + end + sentence(rng, 30)))
            expected[10 * k + j] = family
    docs.append((90, "\n".join(textwrap.wrap(whole["mit"], 75) + ["Licensed under the Apache License, Version 2.0."] + textwrap.wrap(whole["gpl"], 75))))
    docs += [(100 + i, sentence(rng, 60) + "\n" + sentence(rng, 30)) for i in range(40)]
    got = [(r["doc_id"], r["family"], r["confirmed"]) for r in L.licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got) == [(k, f, True) for k, f in expected.items()] + [(90, f, True) for f in ("apache-2.0", "gpl", "mit")]


# -- 5 ----------------------------------------------------------------------------------------------------------


def dedup_by_brute_force(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            k = b[i : i + 50]
            first[k] = min(first.get(k, S.LAST), S.LAST if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (S.LAST if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [3000, 10_000_000])
def test_substrings_against_brute_force(spark, odd, empty, bucket):
    rng = random.Random(7)
    passages = [sentence(rng, 30) for _ in range(6)]
    texts = [" ".join(rng.choice(passages)[rng.randint(0, 80) :] if rng.random() < 0.6 else sentence(rng, 12) for _ in range(rng.randint(1, 8))) for _ in range(80)]
    docs = spark.createDataFrame([(rng.randint(0, 60), t) for t in texts], "doc_id long, text string").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(1, "ab" * 400), (2, "ab" * 300), (3, "a" * 49), (4, "a" * 50), (5, "a" * 50)], "doc_id long, text string"))
    got = sorted((tuple(r) for r in S.dedup(docs, bucket).drop("kept").collect()), key=repr)
    assert got == dedup_by_brute_force([tuple(r) for r in docs.collect()])
    assert S.dedup(empty).count() == 0


def test_transform_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        data = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        docs, n = [rng.randint(0, 3) for _ in data], rng.randint(1, 8)
        want = [[i for i in range(len(a) - n + 1) if any(e < d and a[i : i + n] in b for b, e in zip(data, docs, strict=True))] for a, d in zip(data, docs, strict=True)]
        assert [x.tolist() for x in S.repeated_starts(data, docs, n)] == want


# -- 6 ----------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/1", body), (3, "http://a/2", body), (7, None, body), (1, "http://b\r\n/x", "short"), (2, "http://b/2", "short"), (4, "u", None), (6, "u", ""), (3, "http://a/2", body), (None, None, body), (9, "http://c", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record_type": F.lit("x"), "payload": F.lit(1)})
    path = f"file://{tmp_path}/w"
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in W.write_and_read(pages, path).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((t or "").encode()), "revisit" if t == body and i != 3 else "response", 3 if t == body and i != 3 else None, sha(t)) for i, _, t in rows]
    assert got == sorted(want, key=repr)
    some = spark.read.format("warc").schema("target_uri string, record_type string, payload_bytes long").load(path).filter("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [tuple(r) for r in some.collect()] == [("http://a/1", "revisit", len(body))]
    assert W.write_and_read(pages.limit(0)).count() == 0


def test_warc_headers_without_payloads(tmp_path, monkeypatch):
    import gzip

    from pyarrow import fs

    data = [W.record({"record_type": k, "record_id": f"urn:{i}", "target_uri": "u", "payload_digest": "d", "payload": b"z" * 50_000}) for i, k in enumerate(["response", "revisit", "response"])]
    assert gzip.decompress(b"".join(map(W.member, data))) == b"".join(data)
    for name, raw in (("own.warc.gz", b"".join(map(W.member, data))), ("other.warc.gz", b"".join(map(gzip.compress, data))), ("plain.warc", b"".join(data))):
        (tmp_path / name).write_bytes(raw)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f:
            got = list(W.records(f, len(raw), lambda r: r["record_type"] == "response", True))
        assert [(r["record_id"], r["payload_bytes"]) for r in got] == [("urn:0", 50_000), ("urn:2", 50_000)]
    inflated = []
    upto = W.Inflating.upto
    monkeypatch.setattr(W.Inflating, "upto", lambda self, n: inflated.append(n) or upto(self, n))
    raw = b"".join(map(W.member, data))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "own.warc.gz")) as f:
        list(W.records(f, len(raw), lambda r: True, False))
    assert max(inflated) < 5000


def test_warc_from_elsewhere(tmp_path):
    import gzip

    from pyarrow import fs

    data = [W.record({"record_type": k, "record_id": f"urn:{i}", "target_uri": "u", "payload_digest": "d", "payload": bytes([97 + i]) * 200_000}) for i, k in enumerate(["response", "revisit", "response", "response"])]

    def read(raw, payloads=True, wanted=lambda r: r["record_type"] == "response"):
        (tmp_path / "w").write_bytes(raw)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "w")) as f:
            return [(r["record_id"], r["payload_bytes"], r["payload"] and r["payload"][:1]) for r in W.records(f, len(raw), wanted, payloads)]

    whole = [("urn:0", 200_000, b"a"), ("urn:2", 200_000, b"c"), ("urn:3", 200_000, b"d")]
    plain, one = b"".join(data), gzip.compress(b"".join(data))
    two = gzip.compress(b"".join(data[:3])) + gzip.compress(b"") + gzip.compress(data[3])
    for raw in (plain, one, two, plain + b"\r\n"):
        assert read(raw) == whole and [r[0] for r in read(raw, False)] == [r[0] for r in whole]
    own = b"".join(map(W.member, data))
    for raw in (plain[:-1000], one[:-10], own[:-10], plain + b"no record", data[0] + b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", gzip.compress(data[0] + b"junk\r\n\r\n")):
        for payloads in (True, False):
            with pytest.raises(ValueError, match="WARC archive"):
                read(raw, payloads)


# -- 7 ----------------------------------------------------------------------------------------------------------


def test_decontamination(spark, odd, empty):
    rng = random.Random(8)
    items = [(i, sentence(rng, 40)) for i in range(12)] + [(90, None), (91, ""), (92, "two words"), (3, "again another item with the same id " * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = items[2][1].split()
    for k in (5, 13, 21, 30):
        edited[k] = "edited"
    del edited[17]
    texts = [sentence(rng, 200) for _ in range(60)]
    texts[10] += " " + items[0][1].upper().replace(" ", ", ")
    texts[20] = texts[20][:300] + " " + " ".join(edited) + " " + texts[20][300:]
    for k in range(30, 50):
        texts[k] += " " + items[5][1]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for words in (500_000, 60):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(docs, bench, block_words=words).collect()}
        assert set(got) == {(110, 0), (120, 2)} | {(k + 100, 5) for k in range(30, 50)}
        assert got[(110, 0)] == 1 and 0.6 < got[(120, 2)] < 1
    clean = D.clean_documents(odd, bench)
    assert clean.columns == odd.columns and pairs(clean) == pairs(odd)
    # each row by its own text: null and shared ids, and columns of any name
    rows = [(None, items[0][1], 1, 1), (None, "clean", 2, 2), (7, items[5][1] + " x", 3, 3), (7, "clean too", 4, 4), (8, None, 5, 5)]
    named = spark.createDataFrame(rows, "doc_id long, text string, _bad long, item_id long")
    for words in (500_000, 60):
        kept = D.clean_documents(named, bench, block_words=words)
        assert kept.columns == named.columns and sorted(r["_bad"] for r in kept.collect()) == [2, 4, 5]
    assert D.clean_documents(empty, bench).count() == 0
    assert D.contaminated(empty, bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


def edit_every_fifth(text):
    return " ".join("edited" if k % 5 == 2 else w for k, w in enumerate(text.split()))


@pytest.mark.parametrize("copies", [1, 40])
def test_decontamination_of_copies_with_over_half_of_their_n_grams_broken(spark, copies):
    rng = random.Random(18)
    items = [(i, sentence(rng, 30)) for i in range(4)]
    texts = [sentence(rng, 100) for _ in range(100)]
    for k in range(copies):
        texts[k] += " " + edit_every_fifth(items[1][1]) + " " + sentence(rng, 50)
    # n-grams of the item that other documents hold by chance don't displace what the copies keep
    w = items[1][1].split()
    texts[90:] = [f"{t} {' '.join(w[k : k + 3])}" for k, t in enumerate(texts[90:], 5)]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(docs, bench).collect()}
    score = D.align(D.words(items[1][1]), D.words(texts[0]))[0] / 60
    assert 0.6 < score < 0.8 and got == {(k, 1): score for k in range(copies)}


def test_decontamination_across_a_long_insertion(spark):
    rng = random.Random(19)
    item = sentence(rng, 30)
    text = " ".join([sentence(rng, 50), *item.split()[:15], *["inserted"] * 25, *item.split()[15:], sentence(rng, 50)])
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["score"] for r in D.contaminated(docs, bench).collect()] == [35 / 60]


def test_decontamination_by_a_single_n_gram(spark):
    """Of a short item one n-gram is left; a copy without any has no seed, as the README says."""
    docs = spark.createDataFrame([(1, "before a X c d Y f g h behind"), (2, "before a b X d e Y g h behind"), (3, "f g h"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert [(r["doc_id"], r["score"]) for r in D.contaminated(docs, bench).collect()] == [(1, 10 / 16)]


def test_alignments_score_at_most_their_bound():
    rng = np.random.default_rng(20)
    for _ in range(200):
        texts = [" ".join(map(str, rng.integers(0, 6, rng.integers(1, 12)))) for _ in range(4)]
        items, h = D.Items(list(enumerate(["", *texts[:3], " "])), 3), D.words(texts[3])
        assert all(D.align(items.words[k], h)[0] <= most for k, most in zip((1, 2, 3), items.most(h, np.array([1, 2, 3])), strict=True))


def test_alignment_against_plain_dynamic_program():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert D.align(a, b)[0] == h.max()


# -- 8 ----------------------------------------------------------------------------------------------------------


def test_rules_equal_sql(spark, sf):
    from narrata.llm import queries

    assert_same(queries.op8_quality_rules(spark, sf), connect(sf), queries.ORACLE["op8_quality_rules"])


def test_rules_on_odd_tables(spark, odd, empty):
    def base(t):
        import re

        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        from collections import Counter

        often = Counter(grams)
        rep = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))

    df = Q.apply_rules(odd.select("doc_id", "text"))
    got = sorted((repr((r["doc_id"], r["text"])), (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["base_failed"]) for r in df.collect())
    want = sorted((repr((r["doc_id"], r["text"])), b := base(r["text"]), b[0] < 10 or 100 * b[4] > 20 * b[0]) for r in odd.collect())
    assert got == want and Q.apply_rules(empty.select("doc_id", "text")).count() == 0


# -- 9 ----------------------------------------------------------------------------------------------------------


def jaccard_by_brute_force(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    return sets, near


def test_jaccard_against_brute_force(spark, odd, empty, monkeypatch):
    rng = random.Random(10)
    texts = []
    for _ in range(12):
        base = sentence(rng, rng.randint(30, 200)).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    _, near = jaccard_by_brute_force(rows)
    want = sorted(((d, len(n)) for (d, _), n in zip(rows, near, strict=True)), key=repr)
    for members, parts in ((512, 16), (3, 16), (3, 0)):  # whole blocks, blocks cut into parts, buckets
        monkeypatch.setattr(J, "PART_MEMBERS", members)
        got = J.near_duplicates(docs, block_parts=parts).collect()
        assert sorted(((r["doc_id"], r["n_links"]) for r in got), key=repr) == want
    assert J.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(spark, odd):
    kept = J.one_of_each_group(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect() if r["doc_id"] is not None)
    assert [i for i, _ in ids] == [0, 1, 2, 3, 4, 5, 8, 8, 9, 10, 11]


def test_jaccard_without_ids_and_with_columns_of_any_name(spark):
    rng = random.Random(12)
    base = sentence(rng, 60)
    near, other = base.replace("0", "00", 1), sentence(rng, 60)
    rows = [(None, base), (None, near), (None, near), (4, other), (4, near + " end"), (None, None), (None, ""), (4, other), (9, None)]
    docs = spark.createDataFrame([(i, t, k, "x", "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _kept long, _key string, row string")
    got = sorted((tuple(r) for r in J.near_duplicates(docs).select("doc_id", "class_id", "group_id", "n_links").collect()), key=repr)
    assert got == sorted([(None, None, 4, 3)] * 3 + [(4, 4, 4, 3), (None, None, None, 0), (None, None, None, 0), (4, 4, 4, 1), (4, 4, 4, 1), (9, 9, 9, 0)], key=repr)
    kept = J.one_of_each_group(docs)
    assert kept.columns == docs.columns and all((r["_key"], r["row"]) == ("x", "y") for r in kept.collect())
    ids = sorted(r["_kept"] for r in kept.collect())
    assert ids in ([3, 4, 5, 6, 8], [4, 5, 6, 7, 8])


def test_bands():
    assert J.bands_for(0.8, 0.9999) == 24
    assert 1 - (1 - 0.8**5) ** 24 >= 0.9999 > 1 - (1 - 0.8**5) ** 23


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 10 ---------------------------------------------------------------------------------------------------------


def page(i, body, article=True):
    inner = f"<article>{body}</article>" if article else f"<div class='text'>{body}</div>"
    return f"<html><head><title>t{i}</title><script>var a='</p>'</script></head><body><nav><ul><li>Home</li><li>m{i}</li></ul></nav><div class=ad>Buy {i}</div><div class='box'>Same on all pages</div>{inner}<div class='comments'><p>me too</p></div><footer>&copy; x</footer></body></html>"


def test_html(spark):
    body = "<h1>Title &amp; more</h1><p>One\n  <b>bold</b>word<p>Two&nbsp;x &lt;y&gt;<ul><li>a<li>b</ul><form>no</form>"
    want = "Title & more\nOne boldword\nTwo x <y>\na\nb"
    rows = [(i, f"http://h.example/{i}", page(i, body)) for i in range(6)]
    rows += [(10 + i, f"http://plain.example/{i}", page(i, f"<p>text {i}</p><p>of page {i}</p>", False)) for i in range(6)]
    rows += [(20, None, None), (21, "not a url", ""), (22, "http://h.example/cut", "<body><article><p>cut &am"), (23, "http://h.example/tag", "<article><p>whole</p><p cl"), (0, "http://h.example/0", page(0, body))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "template": F.lit(1)})
    got = {}
    for r in H.extract(pages).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]] = r["text"]
    assert all(got[i] == want for i in range(6))
    assert all(got[10 + i] == f"text {i}\nof page {i}" for i in range(6))  # the repeated box is template, not text
    assert (got[20], got[21], got[22], got[23]) == ("", "", "cut &am", "whole")
    assert H.extract(pages.limit(0)).count() == 0


def test_html_against_classes_of_whole_vectors(spark):
    """Tokens, classes and main slots from vectors that are kept whole."""
    rng = random.Random(21)
    rows = []
    for h, (inner, pages) in enumerate([("<article><h1>{t}</h1>{p}</article>", 9), ("<div class=story><h2>{t}</h2><div class=body>{p}</div></div>", 7), ("<div class=a>{p}</div>", 1)]):
        for i in range(pages):
            paragraphs = "".join(f"<p>{sentence(rng, 12)}</p>" for _ in range(rng.randint(1, 4)))
            lists = "".join(f"<li><a>{sentence(rng, 1)}</a></li>" for _ in range(rng.randint(2, 4)))
            inner_ = inner.format(t=sentence(rng, 4), p=paragraphs)
            rows.append((100 * h + i, f"http://h{h}.example/{i}", f"<html><body><ul class=m>{lists}</ul><div class=teaser>{sentence(rng, 3)}</div>{inner_}<p class=foot>Same {h}</p></body></html>"))
    pages = H.with_host(spark.createDataFrame(rows, "page_id long, url string, html string"))
    hosts: dict = {}
    for page_id, url, html in rows:
        hosts.setdefault(url.split("/")[2], []).append(H.Page(html))
    every = [p for group in hosts.values() for p in group]
    pool = {t: sum(t in p.tokens() for p in every) / len(every) for p in every for t in p.tokens()}
    want = {}
    for host, group in hosts.items():
        vectors = {t: tuple(p.tokens().get(t, (0,))[0] for p in group) for p in group for t in p.tokens()}
        often = {t for t, v in vectors.items() if np.count_nonzero(v) + H.PRIOR * pool[t] >= (len(group) + H.PRIOR) * H.SUPPORT}
        want[host] = {}
        for t in often:
            around = next(p.tokens()[t][1] for p in group if t in p.tokens())
            if around == H.ROOT or (around in often and np.count_nonzero(vectors[around]) >= np.count_nonzero(vectors[t])):
                want[host].setdefault(vectors[t], set()).add(t)
    got: dict = {}
    for r in H.frequent(H.tokens(pages)).filter(F.col("token") != H.ROOT).collect():
        got.setdefault(r["host"], {}).setdefault(r["class"], set()).add(r["token"])
    assert {h: sorted(map(sorted, c.values())) for h, c in got.items()} == {h: sorted(map(sorted, c.values())) for h, c in want.items()}
    slots, _ = H.main_slots(pages)
    path = lambda *labels: functools.reduce(H.number, labels, H.ROOT)
    assert {r["host"]: r["slot"] for r in slots.collect()}.items() >= {"h0.example": path("html", "body", "article"), "h1.example": path("html", "body", "div.story")}.items()
    # without the template the teaser and the list are text
    texts = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert all(H.main_text(html, None, None, frozenset()) != texts[i] for i, _, html in rows if i < 200)


def test_orders_of_classes():
    assert H.orders([1, 2, 3, 1, 2, 3, 9], {1: 7, 2: 7, 3: 7, 9: 8}).keys() == {7, 8}
    assert H.orders([1, 2, 1, 2], {1: 7, 2: 7})[7] == H.orders([1, 2], {1: 7, 2: 7})[7] != 0
    assert H.orders([1, 2, 2, 1], {1: 7, 2: 7})[7] == 0 and H.orders([1, 2, 1], {1: 7, 2: 7})[7] == 0


def test_html_of_deep_and_long_pages():
    deep = "<div>" * 80_000 + "text"
    began = time.perf_counter()
    assert H.main_text(deep, None, None, frozenset()) == "text" and len(H.Page(deep).volumes(frozenset())) == 80_001
    assert H.main_text("<p>a b" * 50_000 + "</x>" * 50_000, None, None, frozenset()).count("a b") == 50_000
    assert time.perf_counter() - began < 30


# -- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(P.STAGES)
    a = stage["quality classifier"](spark, docs, sf).cache()
    b = stage["n-gram Jaccard join"](spark, a, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in a.collect()]
    _, near = jaccard_by_brute_force(rows)
    seen, heads = set(), set()
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        if i not in seen:
            heads.add(rows[i][0])
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += near[k]
    assert {r["doc_id"] for r in b.collect()} == heads and b.columns == columns
    c = stage["benchmark decontamination"](spark, b, sf).cache()
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holding = {r["doc_id"] for r in b.collect() if any(i in " ".join(r["text"].split()) for i in items)}
    assert holding and {r["doc_id"] for r in b.collect()} - {r["doc_id"] for r in c.collect()} == holding
    d = stage["mixing to target weights"](spark, c, sf).cache()
    assert d.columns == columns and all(before[r["doc_id"]] == r["text"] for r in d.collect())
    out = stage["token-id store"](spark, d, sf)
    want = expected_tokens([(r["doc_id"], r["text"]) for r in d.collect()])
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out.collect()) == sorted((i, len(t)) for i, t in want)


def test_pipeline_on_odd_tables(spark, odd, empty, tmp_path):
    """All stages end to end on nulls, repeats, long texts and columns of any name, and on an empty table."""
    import corpus_pipeline as P

    rng = random.Random(31)
    good = [(1000 + i, sentence(rng, 40), "en", "s", 200, 0.1, "k", True) for i in range(60)]
    bad = [(2000 + i, "### !!! $$$ " * 30, "en", "s", 360, 0.1, "k", True) for i in range(60)]
    docs = odd.unionByName(spark.createDataFrame(good + bad, SCHEMA)).withColumns({"rate": F.lit("mine"), "row": F.lit("mine"), "_key": F.lit("mine"), "n_tokens": F.lit("mine")})
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, good[3][1]), (2, None)], "item_id long, text string")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        where = f"file://{tmp_path}/{name}"
        table.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        bench.write.parquet(f"{where}/benchmark.parquet")
        now = spark.read.parquet(f"{where}/documents.parquet")
        for k, (_, stage) in enumerate(P.STAGES):
            made = stage(spark, now, where)
            assert made.columns == docs.columns or k == len(P.STAGES) - 1
            made.write.parquet(f"{where}/{k}")
            now = spark.read.parquet(f"{where}/{k}")
            if k < len(P.STAGES) - 1:
                assert now.filter("rate <> 'mine' or row <> 'mine' or _key <> 'mine' or n_tokens <> 'mine'").count() == 0
        ids = [r["doc_id"] for r in now.select("doc_id").collect()]
        assert (not ids) if name == "none" else (len(set(ids) & set(range(1000, 1060))) > 30 and 1003 not in ids and not set(ids) & set(range(2000, 2060)))
