"""Operators against brute force, on hard little tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import itertools
import os
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmesh.llm import licences, mixing, outliers, packing, quality, simhash, telephony, tokencount, toxicity, warc
from trailmesh.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string"


def documents(spark, n=40):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeéß"), rng.integers(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    rows = [(i, text(int(rng.integers(1, 200))), "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 1, "x", "y") for i in range(n)]
    base = rows[3][1]
    rows += [(100, base, "en", "s1", 1, None, None), (101, base + " z", "en", "s1", 1, None, None), (102, None, None, None, None, None, None), (103, "", "en", "s0", 0, None, None), (104, " \n\t", "en", "s0", 0, None, None)]
    rows += [(None, "no id at all", "en", "s2", 1, None, None), (3, base, "en", "s3", 1, "x", "y"), (105, text(30_000), "de", "s0", 1, None, None), (106, "x" * 40_000, "de", "s0", 1, None, None), (107, "a  b   c \n\n d <|endoftext|> e", "en", "s0", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(30)] + [(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_mixing(docs, empty):
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == docs.count()
    size = {}
    for r in rows:
        size[r.row.source] = size.get(r.row.source, 0) + r["size"]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, left, open_ = {}, 1.5 * sum(size.values()), dict(w)
    while True:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * w[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            del open_[s]
    target |= {s: level * w[s] for s in open_}
    for r in rows:
        assert r.target == pytest.approx(target[r.row.source]) and 0 <= r.copies <= 2
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, rows))
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0


def test_token_counts(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokencount.count_tokens(docs, chunk_chars=400, overlap_chars=16).collect():
        assert r.n_tokens == len(sp.encode(texts[r.doc_id] or "")), r
    assert tokencount.count_tokens(empty).count() == 0
    encoder = tokencount.ResyncEncoder(public_tokenizers.path("piece_bpe_32k.model"), 100, 8)
    for t in ["a" * 950, "ab " * 400, "▁x y▁ " * 90, "  " * 300 + "q", "word\n" * 200 + " z" * 300, "x" * 300 + " y" * 300]:
        assert encoder.ids(t) == sp.encode(t)
    assert encoder.widened


def test_telephony(docs, empty, spark):
    out = {r.doc_id: r for r in telephony.sound_features(telephony.store_texts(docs)).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        raw += b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (out[r.doc_id].payload_bytes, out[r.doc_id].tail_crc32) == (len(raw), zlib.crc32(raw[-32:]))
    assert telephony.sound_features(telephony.store_texts(empty)).count() == 0
    mu, a = telephony.mu_law_table(), telephony.a_law_table()
    assert (mu[0], mu[0x7F], mu[0xFF], mu[0x80], a[0xD5], a[0x55], a[0x2A]) == (-32124, 0, 0, 32124, 8, -8, -32256)
    blocks = np.random.default_rng(2).integers(0, 256, (5, 36), dtype=np.uint8)
    for block, got in zip(blocks, telephony.decode_adpcm(blocks)):
        value, index, want = int(np.array(block[:2]).view("<i2")[0]), min(int(block[2]), 88), []
        want.append(value)
        for byte in block[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(telephony.STEP_SIZE[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code])))
                want.append(value)
        assert got.tolist() == want
    media = spark.createDataFrame([(1, bytearray(telephony.wav(7, b"\x00" * 10))), (2, None), (3, bytearray(b"junk")), (4, bytearray(telephony.wav(0x11, bytes(72), width=36)))], "id int, media binary")
    got = {r.id: r for r in telephony.decode_media(media).collect()}
    assert len(got[1].pcm) == 40 and got[2].pcm is None and got[3].pcm is None and len(got[4].pcm) == 2 * 65 * 2 * 2


def _groups(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    root = _groups([r.fp for r in rows])
    first = {}
    for r, g in zip(rows, root):
        if r.doc_id is not None:
            first[g] = min(first.get(g, 1 << 60), r.doc_id)
    assert [r.component_id for r in rows] == [first.get(g) for g in root]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 30)]
    fps = set(base)
    for b in base[:10]:
        for d in (1, 2, 3, 4):
            for _ in range(3):
                x = b
                for i in rng.choice(64, d, replace=False):
                    x ^= 1 << int(i)
                fps.add(x - (1 << 64) if x >= 1 << 63 else x if x >= -(1 << 63) else x + (1 << 64))
    fps = sorted(fps)
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(prints).collect()}
    root = _groups(fps)
    assert [got[f] for f in fps] == [min(i for i, g in enumerate(root) if g == root[k]) for k in range(len(fps))]


def test_quality_rules(docs, empty):
    text = "a b c a b c\n\nx\nx\n# |"
    assert outliers.text_stats(text) == (10, 10, 2, 1, 6) and outliers.text_stats(None) == (0, 0, 0, 0, 0)
    rows = outliers.quality_rules(docs).collect()
    assert len(rows) == docs.count() and all(not r.kept for r in rows if r.base_failed)
    assert outliers.quality_rules(empty).count() == 0


def test_mcd_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (400, 5)) * [1, 0.5, 0.2, 0.2, 0.2], rng.normal(6, 0.1, (60, 5))])
    df = spark.createDataFrame([("c", *map(float, v)) for v in x], ["cell", *outliers.VECTOR])
    fit = outliers.mcd(df).first()
    mean, cov = x[:400].mean(0), np.cov(x[:400].T)
    assert np.abs(np.array(fit.mean) - mean).max() < 0.15
    inv = np.array(fit.inverse).reshape(5, 5)
    d = np.einsum("ij,jk,ik->i", x - fit.mean, inv, x - fit.mean)
    assert d[400:].min() > outliers.chi2_quantile(1 - 1e-9, 5) > np.quantile(d[:400], 0.99)
    assert outliers.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3) and np.all(np.linalg.eigvalsh(cov) > 0)


def test_mcd_against_all_subsets(spark):
    """Small cells with as many far outliers as the subset can leave out: the subset of the smallest determinant, found among all, then the reweighting of mcd()."""
    rng, p = np.random.default_rng(8), 5
    cells = {}
    for n, bad in ((12, 3), (13, 4), (14, 4), (15, 5)):
        x = rng.normal(0, 1, (n, p)) * [1, 0.5, 0.3, 0.3, 0.3]
        x[:bad] += rng.choice([-8, 8], (bad, p))
        cells[f"{n}-{bad}"] = x
    df = spark.createDataFrame([(c, *map(float, v)) for c, x in cells.items() for v in x], ["cell", *outliers.VECTOR])
    got = {r.cell: r for r in outliers.mcd(df).collect()}
    for c, x in cells.items():
        size = max(-(-len(x) // 2), (len(x) + p + 1) // 2)
        cov = lambda rows, share: np.cov(rows.T, bias=True) * outliers.consistency(share, p) + np.diag(np.square(outliers.FLOOR))
        best = min(itertools.combinations(range(len(x)), size), key=lambda k: np.linalg.slogdet(cov(x[list(k)], size / len(x)))[1])
        rows = x[list(best)]
        d2 = np.einsum("ij,jk,ik->i", x - rows.mean(0), np.linalg.inv(cov(rows, size / len(x))), x - rows.mean(0))
        near = x[d2 <= outliers.chi2_quantile(0.999, p)]
        assert got[c].n == len(near) and np.allclose(got[c].mean, near.mean(0)) and np.allclose(np.array(got[c].cov).reshape(p, p), cov(near, 0.999)), c


def test_mcd_of_one_row_and_none(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0)], ["cell", *outliers.VECTOR])
    fit = outliers.mcd(one).first()
    assert fit.mean == [1, 2, 3, 4, 5] and np.allclose(np.array(fit.cov).reshape(5, 5), np.diag(np.square(outliers.FLOOR)))
    assert outliers.mcd(one.limit(0)).count() == 0


def test_every_row_past_the_base_rules_has_a_distance(docs):
    for r in outliers.quality_rules(docs).collect():
        assert r.base_failed or r.distance is not None


def test_text_stats_against_a_loop(docs):
    for r in outliers.quality_rules(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        words, text = re.findall(r"[^\x20\x09-\x0D]+", r.text or ""), r.text or ""
        seen = {i + k for i in range(len(words) - 2) if sum(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2)) > 1 for k in range(3)} if len(words) < 3000 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)))
        assert seen is None or r.n_repeat_words == len(seen)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_mcd_with_a_large_bloc(spark):
    """A quarter to nearly half of a cell shifted in symbols; and as many copies of one ordinary row, which must not make outliers of the others."""
    cells = {}
    for share in (0.28, 1 / 3, 0.4, 0.45):
        rng = np.random.default_rng(7)
        x = rng.normal(0, 1, (1000, 5)) * [1, 0.15, 0.05, 0.05, 0.05]
        bloc = int(share * 1000)
        copies = x.copy()
        copies[:bloc] = copies[bloc]
        x[:bloc, 2] += 0.5
        cells |= {f"bloc {share}": (x, bloc), f"copies {share}": (copies, bloc)}
    df = spark.createDataFrame([(c, *map(float, v)) for c, (x, _) in cells.items() for v in x], ["cell", *outliers.VECTOR])
    cutoff, fits = outliers.chi2_quantile(1 - 1e-9, 5), outliers.mcd(df).collect()
    assert len(fits) == len(cells)
    for fit in fits:
        x, bloc = cells[fit.cell]
        kept = np.einsum("ij,jk,ik->i", x - fit.mean, np.array(fit.inverse).reshape(5, 5), x - fit.mean) <= cutoff
        print(fit.cell, kept[:bloc].mean(), kept[bloc:].mean())
        assert kept[bloc:].mean() > 0.99, fit.cell
        assert fit.cell.startswith("copies") or kept[:bloc].mean() < 0.25, fit.cell


def test_quality_rules_of_rare_sources(spark):
    """Few rows of a source are held against their language's, of a rare language against all."""
    rng = np.random.default_rng(3)
    prose = lambda: " ".join("abcdefghij"[: int(k)] + str(rng.integers(1000)) for k in rng.integers(2, 8, 150))
    junk = lambda: " ".join("#$%&|<>*"[: int(k)] + str(rng.integers(1000)) for k in rng.integers(4, 8, 150))
    rows = [(i, prose(), "en", f"s{i % 2}") for i in range(240)] + [(1000 + i, junk(), "en", "rare") for i in range(60)]
    rows += [(2000 + i, junk(), "xx", None) for i in range(9)] + [(3000 + i, prose(), "xx", "t") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = outliers.quality_rules(df).collect()
    assert len(got) == len(rows) and not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if r.kept} == {d for d, *_ in rows if d < 1000 or d >= 3000}
    assert all(r.distance is not None for r in got)


def test_toxicity_finds_unseen_spellings(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("aeiourstnl"), 6))
    bad = ["idiotic", "stupider", "moronish"]
    rows, tags = [], []
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 4 == 0:
            words[5] = bad[i // 4 % 3] + ("" if i % 8 else "zz")
        rows.append((i, " ".join(words)))
        tags.append((i, int(i % 4 == 0)))
    rows += [(1000, "lerota idioticx sorian"), (1001, "lerota sorian tuleri"), (1002, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(tags, "doc_id long, toxic int")).collect()}
    held = [got[i] for i, _ in tags if got[i].held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].predicted == 0 and got[None].held_out


def test_toxicity_gradients_and_scores_against_loops():
    texts, y = ["bad words here", "good words", "other bad thing entirely", None, "fine fine day", "12 34"], np.array([1.0, 0, 1, 0, 0, 1])
    bags, used = toxicity.bagged(texts, 1 << 10, 1)
    rng = np.random.default_rng(1)
    params = [rng.normal(0, 0.5, (len(used), 3)), rng.normal(0, 1, 3), np.array([0.3])]
    weight = np.arange(1, 7) / 21
    for focus in (0.0, 0.5, 2.0):
        value, grads = toxicity.loss(*params, bags, y, weight, focus, 0.1)
        for x, g in zip(params, grads):
            for i in list(np.ndindex(x.shape))[:40]:
                old, ends = x[i], []
                for step in (1e-5, -1e-5):
                    x[i] = old + step
                    ends.append(toxicity.loss(*params, bags, y, weight, focus, 0.1)[0])
                x[i] = old
                assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[i], abs=1e-7)
        s = np.zeros(1 << 10, np.float32)
        s[used] = params[0] @ params[1]
        z = []
        for t in texts:
            parts = []
            for w in set(toxicity.WORDS((t or "").lower())):
                bucket, _ = toxicity.grams([w], 1 << 10)
                parts.append(float(np.mean(s[bucket])))
            pull = [np.exp(focus * x) for x in parts]
            z.append(0.3 + (sum(p * x for p, x in zip(pull, parts)) / sum(pull) if parts else 0))
        assert toxicity.Model(s, 0.3, focus).logits(texts) == pytest.approx(z, abs=1e-6)
        by_hand = sum(w * (np.log1p(np.exp(v)) - t * v) for w, v, t in zip(weight, z, y)) + 0.1 * (params[0] ** 2).sum() / (2 * len(used))
        assert value == pytest.approx(by_hand, abs=1e-5)


def test_training_rows_leave_held_out_labels_alone(spark):
    ids = list(range(60))
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    tags = spark.createDataFrame([(i, i % 2) for i in ids] + [(4, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.y for r in toxicity.training_rows(df, tags, "toxic", (100, 100), 1000)}
    assert got == {i: 1 if i == 4 else i % 2 for i in ids if zlib.crc32(str(i).encode()) % 3 != 1}


def test_classifiers_on_hard_tables(spark, docs, empty, labels):
    assert quality.classify(docs, labels).count() == docs.count() and quality.classify(empty, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).filter("accepted").count() == docs.count()
    assert toxicity.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns == quality.drop_poor(docs, labels).columns


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("a", "x", 0.9 if i % 10 else 0.1) for i in range(200)] + [("b", "x", 0.1 if i % 10 else 0.9) for i in range(200)] + [("c", "x", 0.05), (None, None, 0.5)]
    posts, mean = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r.host: r.host_post for r in posts.collect()}
    assert got["b"] < got["c"] < mean < got["a"] and len(got) == 4


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 5}</p>" * (1 + i % 5)) for i in range(40)] + [(40, None, None), (41, "u", ""), (7, "http://h/7", "<p>2</p>" * 3), (None, "n", "x"), (None, "n", "x"), (10**12, "far", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sums = []
    for _ in range(2):
        folder = scratch(spark, "warc")
        manifest = warc.write_warc(pages, folder, shard_bytes=900, task_bytes=200)
        got = warc.read_warc(manifest, folder).collect()
        sums.append(sorted((r.shard, r.sha256) for r in manifest.collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 3
    assert sorted((r.page_id or -1, r.payload_bytes) for r in got) == sorted((p or -1, len((h or "").encode())) for p, _, h in rows)
    by = {}
    for p, _, h in rows:
        by.setdefault(h or "", []).append(p)
    for r in got:
        if r.record_type == "response":
            own = by[r.payload.decode()]
            assert r.page_id == max((p for p in own if p is not None), default=None)
    assert sum(r.record_type == "response" for r in got) == len(by)
    folder = scratch(spark, "warc")
    assert warc.read_warc(warc.write_warc(pages.limit(0), folder), folder).count() == 0


def test_warc_rolls_at_its_defaults(spark):
    """Incompressible pages in a few ranges: shards end where they have shard_bytes, not where ranges do."""
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15_000)), lambda k: F.sha2(F.concat("id", F.lit("-"), k).cast("string"), 256)), "").alias("html"))
    folder = scratch(spark, "warc")
    manifest = warc.write_warc(pages, folder)
    shards = [r for r in manifest.orderBy("shard").collect()]
    total = sum(r.bytes for r in shards)
    assert len(shards) == -(-total // (32 << 20)) or len(shards) == total // (32 << 20) + 1
    assert len(shards) >= 2 and all((32 << 20) - (4 << 20) <= r.bytes <= (32 << 20) + (4 << 20) for r in shards[:-1])
    assert sum(r.records for r in shards) == 100 and warc.read_warc(manifest, folder, payloads=False).count() == 100
    # gzip itself can read a shard, and ids run on from shard to shard
    ids = []
    for r in shards:
        with open(f"{folder.removeprefix('file://')}/{r.shard}", "rb") as f:
            ids += [x["page_id"] for x in warc.parse(f)]
    assert ids == list(range(100))
    assert not os.path.exists(f"{folder.removeprefix('file://')}/_temporary")


def test_warc_null_ids_are_dealt_and_the_largest_id_is_written(spark):
    rows = [(None, f"u{i}", f"page {i} " * 20) for i in range(50)] + [(2**63 - 1, "last", "z"), (-(2**63), "first", "a"), (None, None, None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc.dealt_pages(pages, 500).filter("page_id is null").select("task").distinct().count() > 5
    folder = scratch(spark, "warc")
    got = warc.read_warc(warc.write_warc(pages, folder, shard_bytes=2000, task_bytes=500, block_bytes=300), folder).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in got) == sorted((p is None, p or 0, len(h or "")) for p, _, h in rows)


def test_licences(spark):
    texts = ["A line. Licensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License. Licensed under CC BY-NC 4.0.", "Redistribution", None, "", "You may obtain a copy of the License at\nyou may not use this file except in compliance with the License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licences) for r in licences.scan_licences(df).collect()}
    assert got == {0: (3, "apache2-notice", "Apache-2.0"), 1: (2, "mit-notice,ccbync4-notice", "CC-BY-NC-4.0,MIT"), 2: (1, "", ""), 3: (0, "", ""), 4: (0, "", ""), 5: (2, "apache2-copy,apache2-compliance", "")}


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.sentence_ids, r.licences) for r in licences.scan_licences(df).orderBy("doc_id").collect()]


def test_licences_looks_at_every_sentence(spark):
    texts = ["GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n", "The above copyright  notice and this permission\tnotice shall be included in all copies or substantial portions of the Software."]
    assert scanned(spark, texts) == [("gpl-title,gpl3-version", "GPL-3.0"), ("gpl-title,gpl2-version", "GPL-2.0"), ("mit-condition", "")]


#: Texts of licences and notices as published, by the name that RULES gives them; lines are joined.
PUBLISHED = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'MIT License\n\nCopyright (c) 2020 A. Nyone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n(1) Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n(2) Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\n\nVersion 2.1, February 1999",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\n\nVersion 3, 19 November 2007",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at\n\nhttps://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
}
PUBLISHED["BSD-3-Clause"] = PUBLISHED["BSD-2-Clause"].replace("(1)", "1.").replace("(2)", "2.") + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def wrapped(text, width, before=""):
    return "\n".join(before + x for line in text.split("\n") for x in textwrap.wrap(line, width, break_long_words=False) or [""])


def test_licences_over_line_ends(spark):
    names = sorted(PUBLISHED)
    for width, before in ((10_000, ""), (78, ""), (60, " * "), (66, "# "), (1, "")):
        got = scanned(spark, [wrapped(PUBLISHED[n], width, before) for n in names])
        assert [x for _, x in got] == names, (width, before)
    ids = scanned(spark, [wrapped(PUBLISHED["MIT"], 78)])[0][0]
    assert ids == "mit-title,mit-grant,mit-condition,mit-warranty"
    # a known sentence needs an end on either side, and a line that is one within another still counts
    assert scanned(spark, ["see the MIT License\nor", "Under the\nMIT\nLicense of old", "under the\nGNU General\nPublic License\n.", "| MIT License | 3", "Released | under the MIT License"]) == [("", ""), ("", ""), ("gpl-title", ""), ("", ""), ("mit-notice", "MIT")]


def test_licences_over_sentence_ends(spark):
    """Each known sentence as published, where that has ; : or a full stop within, on one line and wrapped."""
    grant = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    warranty = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    want = {grant.format(";", ";", 2): ("gpl2-grant", "GPL-2.0"), grant.format(":", ",", 3): ("gpl3-grant", "GPL-3.0"), warranty: ("gpl-warranty,gpl-see", "")}
    want["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."] = ("mpl2-notice", "MPL-2.0")
    for width in (10_000, 75):
        assert scanned(spark, [wrapped(x, width) for x in want]) == list(want.values())
    # every entry of the table, in the wording it has there
    known = list(licences.SENTENCES)
    assert [x.split(",")[0] for x, _ in scanned(spark, [k.capitalize() + "." for k in known])] == list(licences.SENTENCES.values())


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, keep_ids=True).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    for d, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        own = {r.piece: r for r in rows if r.doc_id == d}
        assert b"".join(own[k].ids for k in sorted(own)) == np.array(ids, "<u4").tobytes()
        assert all(own[k].length == 1024 for k in own if k) and all(zlib.crc32(own[k].ids) == own[k].ids_crc32 for k in own)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(7)
    counts = {int(k): int(rng.integers(1, 50)) for k in rng.choice(np.arange(1, 101), 40, replace=False)}
    slots, total = packing.best_fit(counts, 100, 4, 6000 + 4000, rule=rule)
    used = {}
    for s in slots:
        for r in range(s.lo, s.hi):
            b = s.base + (r - s.lo) // s.per
            used.setdefault(b, []).append(s.length)
    assert len(used) == total and {k: sum(v.count(k) for v in used.values()) for k in counts} == counts
    assert all(sum(v) <= 100 and len(v) <= 4 and sum(x * x for x in v) <= 10_000 for v in used.values())


def test_best_fit_against_one_piece_at_a_time():
    """Each piece by itself goes to the sequence of the smallest weighted norm of what then remains."""
    rng = np.random.default_rng(9)
    for caps in ((60, 5, 1800), (60, 60, 3600), (60, 3, 3600)):
        counts = {int(k): int(rng.integers(1, 9)) for k in rng.choice(np.arange(1, 41), 20, replace=False)}
        bins: list[list[int]] = []
        for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            best = None
            for i, b in enumerate(bins):
                used = [sum(b) + x, len(b) + 1, sum(v * v for v in b) + x * x]
                if all(u <= c for u, c in zip(used, caps)):
                    before = (sum(b), len(b), sum(v * v for v in b))
                    score = (sum(((c - u) / c) ** 2 for u, c in zip(used, caps)), before)
                    if best is None or score < best[0]:
                        best = (score, i)
            if best is None:
                bins.append([x])
            else:
                bins[best[1]].append(x)
        slots, total = packing.best_fit(counts, *caps)
        got: dict[int, list[int]] = {}
        for s in slots:
            for r in range(s.lo, s.hi):
                got.setdefault(s.base + (r - s.lo) // s.per, []).append(s.length)
        assert total == len(bins) and sorted(map(sorted, got.values())) == sorted(map(sorted, bins)), caps


def test_byte_bpe_against_the_library():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    bpe, library = packing.ByteBpe(file, most=50), Tokenizer.from_file(file)
    for t in ["", "a<|endoftext|>b  <|endoftext|>", "\u0558x \u208f9 y\u0c5c", "  \n\n x'll 'S I've\t\t", "x" * 5000 + " " * 300 + "é" * 99, "<|endoftext", "\r\n\u00a0\u3000 a", "a\x1c b\x1f\x1f  \x85", "x_y __ _1 a\u0301 e\u0301\u0301", "\u00bd \u00b2 \u2160 3\u00bd", "it's'S we'll 'llama ''s", "\U0001f600\U0001f600 \U0001f600a", *[f"word{i} and {i * 7} more" for i in range(40)]]:
        assert bpe.ids(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def xxh64(data: bytes, seed: int) -> int:
    """XXH64 by its published description."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    mask = (1 << 64) - 1
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & mask
    step = lambda acc, lane: rot((acc + lane * p2) & mask, 31) * p1 & mask
    at = 0
    if len(data) >= 32:
        acc = [(seed + p1 + p2) & mask, (seed + p2) & mask, seed, (seed - p1) & mask]
        while at + 32 <= len(data):
            for k in range(4):
                acc[k] = step(acc[k], int.from_bytes(data[at + 8 * k : at + 8 * k + 8], "little"))
            at += 32
        h = sum(rot(a, r) for a, r in zip(acc, (1, 7, 12, 18))) & mask
        for a in acc:
            h = ((h ^ step(0, a)) * p1 + p4) & mask
    else:
        h = (seed + p5) & mask
    h = (h + len(data)) & mask
    while at + 8 <= len(data):
        h = (rot(h ^ step(0, int.from_bytes(data[at : at + 8], "little")), 27) * p1 + p4) & mask
        at += 8
    if at + 4 <= len(data):
        h = (rot(h ^ (int.from_bytes(data[at : at + 4], "little") * p1 & mask), 23) * p2 + p3) & mask
        at += 4
    for byte in data[at:]:
        h = rot(h ^ (byte * p5 & mask), 11) * p1 & mask
    h = ((h ^ (h >> 33)) * p2) & mask
    h = ((h ^ (h >> 29)) * p3) & mask
    return h ^ (h >> 32)


def test_fingerprints_bit_by_bit(docs):
    assert xxh64(b"", 0) == 0xEF46DB3751D8E999
    for r in simhash.fingerprints(docs.filter("coalesce(length(text), 0) < 3000"), ["text"]).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxh64(s.encode(), 42) for s in shingles]
        assert r.fp & (2**64 - 1) == sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_no_neighbour_is_filtered_out(spark):
    """with_neighbours() by itself: pairs at 0 to 3 bits, wherever the bits lie, and 0 and -1."""
    rng = np.random.default_rng(11)
    wrap = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    pairs, fps = [], {0, -1}
    for k in range(120):
        a = int(rng.integers(0, 2**63)) * 2 + k % 2
        b = a
        for i in rng.choice(64, 1 + k % 3, replace=False) if k % 4 else [20 + k % 5, 41 + k % 3, 63]:
            b ^= 1 << int(i)
        pairs.append((wrap(a), wrap(b)))
        fps |= set(pairs[-1])
    got = {r.fp for r in simhash.with_neighbours(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert all(a in got and b in got for a, b in pairs) and len(got) <= len(fps)
    assert simhash.with_neighbours(spark.createDataFrame([(1 << 40,), (0,), (-1,)], "fp long")).count() == 2


def test_dropping_near_duplicates_with_maps_and_odd_ids(spark):
    rows = [("null", "a b c d", {"k": 1}), (None, "a b c d", {"k": 2}), ("x", "other words entirely here", {"k": 3}), ("x", "other words entirely here", {"k": 3})]
    df = spark.createDataFrame(rows, "doc_id string, text string, more map<string,int>")
    kept = simhash.drop_near_duplicates(df).collect()
    assert sorted(r.doc_id for r in kept) == ["null", "x"] and {r.doc_id: r.more for r in kept}["null"] == {"k": 1}


def test_telephony_of_odd_media(spark):
    odd = [(1, 0, None), (2, 0, bytearray(b"junk")), (3, 0, bytearray(telephony.wav(7, b""))), (4, 3, bytearray(telephony.wav(7, b"abc"))), (5, 3, bytearray(telephony.wav(7, b"abc", rate=0)))]
    got = {r.doc_id: r for r in telephony.sound_features(spark.createDataFrame(odd, "doc_id int, n_bytes long, media binary")).collect()}
    assert [got[i].payload_bytes for i in range(1, 6)] == [None, None, None, 3, None] and got[1].media_bytes is None and got[2].media_bytes == 4
    assert [len(p) for p in telephony.decode_many([(0x11, 36, bytes(36 + k)) for k in range(6)])] == [65, 65, 65, 65, 66, 68]
    pcm = np.arange(-40, 40, dtype="<i2") * 100
    assert len(telephony.resample(pcm, 16000, 8000)) == 40 and np.abs(telephony.resample(np.tile([1000, -1000], 40).astype("<i2"), 16000, 8000)).max() <= 500
    assert telephony.resample(np.full(50, 77, "<i2"), 44100, 8000).tolist() == [77] * 9


def test_telephony_features_by_hand(docs):
    import hashlib

    out = {r.doc_id: r for r in telephony.sound_features(telephony.stored_texts(docs)).collect()}
    for r in docs.filter("coalesce(length(text), 0) < 2000 and doc_id is not null").dropDuplicates(["doc_id"]).collect():
        if r.doc_id == 3:
            continue
        raw = (r.text or "").encode()
        data = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        head = b"RIFF" + (50 + len(data)).to_bytes(4, "little") + b"WAVEfmt " + bytes([18, 0, 0, 0, 7, 0, 1, 0]) + (8000).to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0, 0, 0]) + b"fact" + bytes([4, 0, 0, 0]) + len(data).to_bytes(4, "little") + b"data" + len(data).to_bytes(4, "little")
        mu = []
        for b in data:
            u = ~b & 255
            size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
            mu.append(-size if u & 128 else size)
        x = [v for k in range(len(mu)) for v in (mu[k], (mu[k] + mu[min(k + 1, len(mu) - 1)]) // 2)]
        want = f"mu:{len(x)},{max(map(abs, x))},{sum(v * v for v in x) // len(x)},{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))},{zlib.crc32(np.array(x, '<i2').tobytes()):08x}"
        got = out[r.doc_id]
        assert (got.n_bytes, got.payload_sha256, got.media_bytes, got.media_sha256) == (len(raw), hashlib.sha256(data).hexdigest(), len(head + data), hashlib.sha256(head + data).hexdigest())
        assert got.feature.split(";")[0] == want


def test_a_row_is_no_evidence_for_itself(spark):
    """Leave-one-out sums, against a loop."""
    rng = np.random.default_rng(12)
    rows = [(i, f"h{i % 3}", f"p{i % 5}", float(rng.uniform(0.05, 0.95))) for i in range(60)] + [(60, "lone", "lone", 0.9)]
    df = spark.createDataFrame(rows, "id int, host string, path string, p double")
    sites, mean = quality.posteriors(df.select("host", "path", "p"))
    k = sites.first()
    for r in quality.combined(df, sites, mean, 0.5, 0.5).collect():
        others = [x for x in rows if x[0] != r.id]
        of = lambda rows: (sum(x[3] for x in rows), len(rows))
        hs, hn = of([x for x in others if x[1] == r.host])
        host = (hs + k.host_k * mean) / (hn + k.host_k)
        ps, pn = of([x for x in others if x[1] == r.host and x[2] == r.path])
        path = (ps + k.path_k * host) / (pn + k.path_k)
        logit = lambda p: np.log(p / (1 - p))
        assert (r.host_post, r.path_post) == (pytest.approx(host), pytest.approx(path))
        assert r.score == pytest.approx(1 / (1 + np.exp(-(logit(r.p) + 0.5 * (logit(path) - logit(mean))))))


def test_pipeline_stages(spark, docs, labels, tmp_path):
    """Each stage against a loop over what the operators say of its own input."""
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    d, folder = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    key = lambda rows: sorted(map(str, rows))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "toxicity", "simhash near-dedup", "mixing", "packing"]
    rows = d.collect()
    accepted = {(r.doc_id, r.accepted) for r in quality.classify(d, labels).collect() if r.doc_id != 3}
    got = stages["quality classifier"](spark, d, folder).collect()
    assert key(r for r in got if r.doc_id != 3) == key(r for r in rows if (r.doc_id, True) in accepted)
    predicted = {(r.doc_id, r.predicted) for r in toxicity.toxicity(d, labels).collect() if r.doc_id != 3}
    got = stages["toxicity"](spark, d, folder).collect()
    assert key(r for r in got if r.doc_id != 3) == key(r for r in rows if (r.doc_id, 0) in predicted)
    root = _groups([simhash.fingerprint(r.text) for r in rows])
    first: dict[int, tuple] = {}
    for r, g in zip(rows, root):
        first[g] = min(first.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    got = stages["simhash near-dedup"](spark, d, folder)
    assert got.columns == d.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(first.values())
    copies = [r.row for r in mixing.mix_plan(d).collect() for _ in range(r.copies)]
    got = stages["mixing"](spark, d, folder)
    assert got.columns == d.columns and key(got.collect()) == key(copies)
    pieces = stages["packing"](spark, d, folder).collect()
    held: dict[int, list] = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(len(v) <= 16 and sum(x for _, x in v) <= 1024 for v in held.values()) and sum(r.piece == 0 for r in pieces) == len(rows)
    assert set(corpus_pipeline.run(spark, folder).columns) >= {"doc_id", "sequence_id", "offset"}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from trailmesh.llm.common import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(far)
