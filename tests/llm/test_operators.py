"""Each operator against brute force, and its defined results for nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from inkwell.llm import (
    audio,
    components,
    decontaminate,
    language_id,
    line_dedup,
    near_dedup,
    quality,
    sentencepiece_codec,
    token_counts,
    url_filter,
)
from inkwell.llm.common import text_bytes
from inkwell.llm.words import shingles

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = ["", " ", "a", "  two  spaces ", "▁ sign", "line\nbreak\ttab", "漢字 🙂 é\x00", "no" * 300, "<s> </s> <unk>"]
SCHEMA = "doc_id long, text string, lang string, score double, component_id long"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(k, t, "en", 0.5, 7) for k, t in enumerate([*ODD, LONG, None])]
    rows += [(1, " ", None, None, None), (None, "null id", "fr", None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(docs):
    return docs.where("false")


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r[0]].append(r)
    return out


# -- 1


def test_audio_payloads(odd_docs):
    docs, rows = odd_docs
    found = by_id(audio.features(audio.store(docs)))
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = found[doc_id][0]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(payload) + 44, hashlib.sha256(audio.to_wav(payload)).hexdigest())
    assert len(found[1]) == 2 and found[1][0] == found[1][1]
    assert audio.features(audio.store(empty(docs))).count() == 0


def test_resampling_matches_direct_filtering():
    x = np.random.default_rng(1).standard_normal(500).astype(np.float32)
    taps = np.zeros(audio.TAPS * audio.UP)
    for p in range(audio.UP):
        taps[p :: audio.UP] = audio._PHASES[p]
    raised = np.zeros(len(x) * audio.UP)
    raised[:: audio.UP] = x
    direct = np.convolve(raised, taps)[:: audio.DOWN][:300]
    assert np.allclose(audio.resample(x, 0, 300), direct, atol=1e-4)
    assert np.allclose(np.concatenate([audio.resample(x, 0, 101), audio.resample(x, 101, 199)]), direct, atol=1e-4)


def test_log_mel_equals_a_plain_one():
    payload = bytes(np.random.default_rng(4).integers(0, 256, 64 * 30, dtype=np.uint8))
    got, energy = audio.log_mel(payload)
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = audio.frame_count(len(x))
    signal = audio.resample(x.astype(np.float32), 0, (n - 1) * audio.HOP + audio.FRAME).astype(float)
    rate = audio.RATE * audio.UP / audio.DOWN
    mel, hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hz(k * mel(rate / 2) / (audio.MELS + 1)) for k in range(audio.MELS + 2)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
    for f in range(n):
        window = [signal[f * audio.HOP + k] * (0.5 - 0.5 * np.cos(2 * np.pi * k / (audio.FRAME - 1))) for k in range(audio.FRAME)]
        power = np.abs(turn @ np.array(window)) ** 2
        for m in range(audio.MELS):
            total = 0.0
            for k, p in enumerate(power):
                hertz = k * rate / audio.FRAME
                low, mid, high = edges[m : m + 3]
                total += p * max(0.0, min((hertz - low) / (mid - low), (high - hertz) / (high - mid)))
            assert abs(got[f, m] - max(audio.FLOOR_DB, 10 * np.log10(max(total, 1e-6)))) < 0.05
        assert abs(energy[f] - 10 * np.log10(max(np.mean(np.square(window)), 1e-6))) < 0.05


def test_patches_of_odd_documents(odd_docs):
    docs, rows = odd_docs
    found = by_id(audio.log_mel_patches(audio.store(docs)))
    for doc_id, text, *_ in rows:
        size = max(64, -(-len((text or "").encode()) // 64) * 64)
        copies = sum(r[0] == doc_id for r in rows)
        assert doc_id == 1 or len(found[doc_id]) == copies * -(-audio.frame_count(size) // audio.PATCH)
    assert audio.log_mel_patches(audio.store(empty(docs))).count() == 0


def test_segments_have_hysteresis():
    energy = np.array([0, 0, 0, 0, 5, 1.2, 1.2, 0.2, 1.2, 0, 0, 0], float)
    step = audio.HOP * audio.DOWN / (audio.RATE * audio.UP)
    assert audio.segments(energy) == [(4 * step, 7 * step)]


def test_blocks_and_tensors(spark, monkeypatch):
    payload = bytes(np.random.default_rng(2).integers(0, 256, 64 * 700, dtype=np.uint8))
    whole = audio.log_mel(payload)
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 37)
    assert np.allclose(audio.log_mel(payload)[0], whole[0], atol=1e-3)
    docs = spark.createDataFrame([(1, "some words " * 2000)], "doc_id long, text string")
    table = audio.log_mel_patches(audio.store(docs)).toArrow()
    tensors = audio.tensor_column(table.column("log_mel"))
    assert tensors.type.shape == [audio.PATCH, audio.MELS] and len(tensors) == table.num_rows > 1


def test_audio_query_reads_tensors_back(spark, tmp_path):
    from inkwell.llm import queries

    texts = {1: "a" * 50, 2: "some words " * 3000, 3: None, 4: "é" * 6144}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = by_id(audio.log_mel_patches(audio.store(docs)))
    for doc_id, (r,) in by_id(queries.op1_audio(spark, str(tmp_path))).items():
        rows = sorted(wanted[doc_id], key=lambda p: p.patch)
        spans = np.array([(p.start_s, p.end_s) for p in rows])
        tensors = np.array([p.log_mel for p in rows], np.float32)
        feature = dict(x.split("=") for x in r.feature.split(";"))
        assert int(feature["patches"]) == len(rows) and feature["end_s"] == f"{rows[-1].end_s:.3f}"
        assert feature["tensors"] == hashlib.sha256(spans.tobytes() + tensors.tobytes()).hexdigest()


# -- 2


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7?x#y", "x://b.de.net/de/1", "https://example.net/de/8", "no host", None, "://org/es/", "ftp://org", "http://notexample.com/en/1?://z", "http://sub.org/es/x\ny"]
    pages = spark.createDataFrame([(k, u, None, "z") for k, u in enumerate(urls)] + [(None, urls[0], "", "z"), (0, urls[0], None, "z")], "page_id long, url string, html string, verdict string")
    found = by_id(url_filter.judge(pages))
    got = {k: (r[0].host, r[0].path, r[0].rule) for k, r in found.items()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7") and found[0][0].verdict == "allow" and len(found[0]) == 2
    assert got[1] == ("b.de.net", "/de/1", "net/de/")
    assert got[2] == ("example.net", "/de/8", "example.net/de/8") and found[2][0].verdict == "block"
    assert got[3] == got[4] == ("", "", None) and found[3][0].verdict == "allow"
    assert got[5] == ("org", "/es/", "org/es/") and got[6] == ("org", "", None)
    assert got[7] == ("notexample.com", "/en/1", "com/en/")
    assert got[8][2] == "org/es/"
    assert url_filter.judge(empty(pages)).count() == 0


def test_links_carry_distrust_back(spark):
    pages = [(1, "http://bad.org/es/1", ""), (2, "http://friend.io/1", '<a href="http://bad.org/x">'), (3, "http://good.net/de/1", "<a href=//fine.io/>"), (4, "http://fine.io/2", None)]
    found = by_id(url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert found[2][0].verdict == "block" and found[4][0].verdict == "allow"
    assert found[2][0].distrust > 0 and found[4][0].trust > 0


# -- 3 and 4


def test_tokens_equal_the_library(odd_docs):
    docs, rows = odd_docs
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = sentencepiece_codec.encode(docs, MODEL)
    ids, texts = by_id(encoded), by_id(sentencepiece_codec.decode(encoded, MODEL))
    counts = by_id(token_counts.count_tokens(docs, MODEL))
    for doc_id, text, *_ in rows:
        wanted = sp.encode(text or "")
        assert ids[doc_id][0].token_ids == wanted
        assert texts[doc_id][0].decoded == sp.decode(wanted)
        assert (counts[doc_id][0].n_bytes, counts[doc_id][0].n_tokens) == (len((text or "").encode()), len(wanted))
        assert counts[doc_id][0].over_limit == (len(wanted) > 4096)
    assert len(ids[1]) == len(counts[1]) == 2
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(empty(docs), MODEL), MODEL).count() == 0
    assert token_counts.count_tokens(empty(docs), MODEL).count() == 0


def test_random_texts_encode_as_the_library(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.PieceTable(MODEL))
    rng = random.Random(4)
    texts = ["".join(rng.choice(" abtheing▁\n\té漢字ﬁ.,12<>s/\x00🙂가") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["  " * k for k in range(12)] + ["a" * k for k in range(30)]
    got = [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(texts)]
    assert got == [sp.encode(t) for t in texts]
    monkeypatch.setattr("inkwell.llm.pretokens.PART_CHARS", 50)
    encoder.words.clear()
    text = "".join(rng.choice("ab  c\n") for _ in range(3000))
    assert np.frombuffer(encoder.encode([text])[0], "<i4").tolist() == sp.encode(text)


def test_long_words_encode_as_the_library(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.PieceTable(MODEL))
    rng = random.Random(14)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [draw("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/", 60_000), draw("漢字學習機器算法很好用的是不了", 30_000)]
    texts += ["a" * 30_001, "-" * 20_011, "abc" * 9_000, "the" * 9_000, draw("🙂é漢a", 12_000), "x " + draw("etaoin", 20_000) + " y"]
    assert [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(texts)] == [sp.encode(t) for t in texts]
    assert max(map(len, encoder.words)) <= sentencepiece_codec.LONG_BYTES
    monkeypatch.setattr(sentencepiece_codec, "WINDOW", 64)
    monkeypatch.setattr(sentencepiece_codec, "OVERLAP", 5)  # often no common token
    assert np.frombuffer(encoder.long_word(texts[0][:9000]), "<i4").tolist() == sp.encode(texts[0][:9000])
    assert np.frombuffer(encoder.long_word(texts[4][:9000]), "<i4").tolist() == sp.encode(texts[4][:9000])


@pytest.mark.parametrize("unit", ["a", "=", "ab", "abc", "-------x", "漢", "🙂é"])
def test_periodic_runs_take_linear_time(unit):
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.PieceTable(MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = unit * (120_000 // len(unit))
    began = time.time()
    found = np.frombuffer(encoder.encode([text])[0], "<i4").tolist()
    assert time.time() - began < 20 and found == sp.encode(text)


def test_words_relaxed_in_order_encode_as_the_library(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "STRETCH", 7)
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.PieceTable(MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(8)
    for _ in range(200):
        word = "".join(rng.choice(["a", "b", "=", "漢", "the", "ing", "🙂", "zz", "\x00"]) for _ in range(rng.randrange(1, 60)))
        assert np.frombuffer(encoder.in_order((" " + word).encode()), "<i4").tolist() == sp.encode(word)


def test_whole_tokens_are_proved():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    whole = token_counts.whole_tokens(MODEL)
    assert {"the", ""} <= whole
    assert all(len(sp.encode(w)) == 1 for w in random.Random(1).sample(sorted(whole - {""}), 500))


# -- 5


def sets(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 9, 14, 20, 40, 70, 300])] + [(8, None), (None, "a b c d e"), (3, None), (9, "")]
    texts = []
    for k, t in items[:8]:
        w = t.split()
        texts += [t, " ".join([*(word() for _ in range(2000)), *w, *(word() for _ in range(50))]), t.upper().replace(" ", ",\n")]
        cut = w[: max(1, int(len(w) * rng.uniform(0.6, 1)))]
        texts += [" ".join([word(), *cut, word()]), " ".join(w[::-1])]
    rows = [(k, t, "x") for k, t in enumerate([*texts, "", None])] + [(0, texts[0], "x"), (None, texts[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = set()
    for d, t, _ in rows:
        for i, q in items:
            s = sets(q)
            if d is not None and i is not None and s and 100 * len(s & sets(t)) >= 75 * len(s):
                wanted.add((d, i))
    found = decontaminate.contained_items(docs, bench)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted(wanted) and len(wanted) > 20
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in rows} - {d for d, _ in wanted}
    assert decontaminate.contained_items(empty(docs), bench).count() == 0
    assert decontaminate.contained_items(docs, bench.where("false")).count() == 0
    shuffled = decontaminate.contained_items(docs, bench, broadcast_bytes=0)
    assert sorted((r.doc_id, r.item_id) for r in shuffled.collect()) == sorted(wanted)
    low = decontaminate.minima(bench.select("item_id", F.array_distinct(decontaminate.shingle_hashes(F.col("text"))).alias("shingles")).where("size(shingles) > 0"))
    assert low.where(~decontaminate.among_minima(low, F.col("shingle"))).count() == 0
    others = spark.range(10_000).select(F.xxhash64("id").alias("shingle"))
    assert others.where(decontaminate.among_minima(low, F.col("shingle"))).count() < 500


# -- 6


def test_quality(spark, odd_docs):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "quietly"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW!!", "$$$", "win###"]) for _ in range(60))
    rows = [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 200] + [(0, None), (None, 1), (5, 1)], "doc_id long, quality int")
    machine = quality.train(docs, labels)
    scored = {r.doc_id: r.s for r in docs.select("doc_id", quality.score(docs, machine).alias("s")).collect()}
    assert all((scored[k] >= 0.7) == bool(y) for k, _, y in rows if k >= 200)
    odd, _ = odd_docs
    assert all(0 <= r.s <= 1 for r in odd.select(quality.score(odd, machine).alias("s")).collect())
    assert empty(odd).select(quality.score(odd, machine).alias("s")).count() == 0
    alone = quality.train(docs, labels.where("false"))
    assert docs.select(quality.score(docs, alone).alias("s")).first().s > 0.99


def test_quality_training_is_bounded_and_independent_of_partitions(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "ZZ", "Y!"]) + str(rng.randrange(9000)) for _ in range(6000 if k < 6 else 30)) for k in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, f"another text {n}") for n in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    one, many = quality.train(docs.repartition(1), labels), quality.train(docs.repartition(7), labels)
    assert one.bias == many.bias and np.array_equal(one.linear, many.linear) and np.array_equal(one.factors, many.factors)
    few = quality.train(docs, labels, max_rows=10)
    assert not np.array_equal(few.linear, one.linear)


def test_one_step_equals_a_plain_one():
    """A batch's gradient against sums over explicit pairs."""
    first, at, x, stats = quality.inputs(*text_bytes(pa.array(["one two TWO three!", "x y"])))
    examples = [(at[first[k] : first[k + 1]], x[first[k] : first[k + 1]], stats[k]) for k in range(2)]
    plain, labels = quality.Machine(), np.array([1.0, 0.0])
    start = plain.factors.astype(float)
    line, bend, bias = np.zeros(len(plain.linear)), np.zeros(plain.factors.shape), 0.0
    for (cols, vals, extra), y in zip(examples, labels):
        cols, vals = np.append(cols, np.arange(stats.shape[1]) + quality.BUCKETS), np.append(vals, extra).astype(float)
        pairs = sum(start[cols[i]] @ start[cols[j]] * vals[i] * vals[j] for i in range(len(cols)) for j in range(i))
        slope = (1 / (1 + np.exp(-pairs)) - y) / 2
        bias += slope
        for i, c in enumerate(cols):
            line[c] += slope * vals[i]
            bend[c] += slope * vals[i] * sum(start[cols[j]] * vals[j] for j in range(len(cols)) if j != i)
    used = np.unique(np.concatenate([*(e[0] for e in examples), np.arange(stats.shape[1]) + quality.BUCKETS]))
    bend[used] += quality.DECAY * start[used]
    step = lambda g: quality.RATE * g / np.sqrt(1e-3 + g**2)
    machine = quality.Machine()
    epochs, quality.EPOCHS = quality.EPOCHS, 1
    machine.fit(examples, labels)
    quality.EPOCHS = epochs
    assert np.allclose(machine.linear, -step(line), atol=1e-4) and np.allclose(machine.factors, start - step(bend), atol=1e-4)
    assert np.isclose(machine.bias, -step(bias), atol=1e-6)


def test_quality_query(spark, tmp_path):
    """Held-out labels, languages, sources and ids don't enter; the cut is at 0.7."""
    from inkwell.llm import queries

    rng = random.Random(8)
    text = lambda y: " ".join(rng.choice(["calm", "clear", "prose"] if y else ["BUY", "$$", "win#"]) for _ in range(40))
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    rows = [(k, text(k % 2), "en", "s", 1) for k in range(120)]
    labels = [(k, k % 2, 0) for k in range(120)]
    found = []
    for turn in range(2):
        folder = f"{tmp_path}/{turn}"
        changed = [(k, 1 - y if turn and out(k) else y, t) for k, y, t in labels]
        moved = [(k, t, "de" if turn else a, "other" if turn else b, n) for k, t, a, b, n in rows]
        spark.createDataFrame(moved, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(changed, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found.append({r.doc_id: r for r in queries.op6_quality(spark, folder).collect()})
    assert {k: r.score for k, r in found[0].items()} == {k: r.score for k, r in found[1].items()}
    assert all(r.held_out == out(k) and r.predicted == int(r.score >= 0.7) for k, r in found[0].items())
    assert all(r.predicted == k % 2 for k, r in found[0].items() if out(k))


def test_sum_of_squares_identity():
    machine = quality.Machine()
    rng = np.random.default_rng(0)
    machine.linear[:] = rng.standard_normal(len(machine.linear))
    first, at, x, stats = quality.inputs(*text_bytes(pa.array(["one two TWO three!", "", "x"])))
    got = machine.parts(first, at, x, stats)[-1]
    for k in range(3):
        cols = np.concatenate([at[first[k] : first[k + 1]], np.arange(stats.shape[1]) + quality.BUCKETS])
        vals = np.concatenate([x[first[k] : first[k + 1]], stats[k]])
        pairs = sum(machine.factors[cols[i]] @ machine.factors[cols[j]] * vals[i] * vals[j] for i in range(len(cols)) for j in range(i))
        assert np.isclose(got[k], machine.linear[cols] @ vals + pairs, atol=1e-3)


# -- 7


def word_sets(text):
    raw = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_of(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_near_duplicates(spark, odd_docs):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    texts = list(ODD)
    for _ in range(12):
        base = [word() + word() for _ in range(rng.randint(4, 120))]
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy))
    rows = [(k, t, "l", 0.0, 3) for k, t in enumerate(texts)]
    s = {k: word_sets(t) for k, t, *_ in rows}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    wanted = components_of(links, s)
    docs = spark.createDataFrame([*rows, (None, texts[20], None, None, None), rows[30]], SCHEMA)
    found = by_id(near_dedup.near_duplicates(docs))
    assert {k: (r[0].n_shingles, r[0].component_id, r[0].kept) for k, r in found.items() if k is not None} == {k: (len(s[k]), wanted[k], wanted[k] == k) for k in s}
    assert found[None][0].component_id is None and not found[None][0].kept and len(found[30]) == 2
    assert near_dedup.near_duplicates(empty(docs)).count() == 0
    kept = near_dedup.without_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in s if wanted[k] == k} | {None}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:]
    sig = near_dedup.signatures([a, b, pool[:1], pool[:0]], 256)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12
    assert sorted(sig[2] >> np.uint64(32)) == list(range(256)) and (sig[3] == near_dedup._NONE).all()


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = pool[: rng.integers(1, 300)], pool[rng.integers(0, 299) :]
        maps = near_dedup.parity(a) ^ near_dedup.parity(b)
        assert sum(int(x).bit_count() for x in maps.view(np.uint64)) <= len(np.setxor1d(a, b))


def test_shingle_sets_match_plain_code():
    texts = [*ODD, "A b C d E f g", "a b c d e f G", "x " * 50]
    assert [len(x) for x in shingles(*text_bytes(pa.array(texts)))] == [len(word_sets(t)) for t in texts]


def test_components(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4300)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    wanted = components_of([e for e in edges if e[0] != e[1]], nodes)
    df = spark.createDataFrame([*edges, (None, 3), edges[0]], "a long, b long").repartition(7)
    for limit in (components.TASK_EDGES, 0):  # by one task, and by rounds
        monkeypatch.setattr(components, "TASK_EDGES", limit)
        assert {r.node: r.component for r in components.connected_components(df).collect()} == wanted
    assert components.connected_components(df.where("false")).count() == 0


def test_components_limit_crossed_in_mid_run(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)]
    edges = [e for e in edges if e[0] != e[1]]
    wanted = components_of(edges, {x for e in edges for x in e})
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    counts, state = [], components._state
    monkeypatch.setattr(components, "_state", lambda e: counts.append(state(e)) or counts[-1])
    monkeypatch.setattr(components, "TASK_EDGES", -1)
    components.connected_components(df)
    first, *later = (n for n, _ in counts)
    limits = {n for n in later if n < first}
    assert limits
    for limit in limits:
        monkeypatch.setattr(components, "TASK_EDGES", limit)
        found = components.connected_components(df).collect()
        assert len(found) == len(wanted) and {r.node: r.component for r in found} == wanted


# -- 9


def test_language_id(spark, odd_docs):
    rng = random.Random(6)
    words = {"en": "the of and house with water".split(), "de": "der und nicht schön haus wasser".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, text(lang := rng.choice(["en", "de"]), 30), lang) for k in range(60)]
    docs = spark.createDataFrame([*rows, (60, "zzz", None), (61, None, "fr"), (None, "xx", "en")], "doc_id long, text string, lang string")
    names, model = language_id.learn(docs, docs["lang"])
    assert names == ["de", "en"]
    found = by_id(language_id.predict(docs, names, model))
    assert all(found[k][0].lang_pred == lang for k, _, lang in rows)
    assert (found[61][0].lang_pred, found[61][0].score) == ("und", 0.0)
    mixed = spark.createDataFrame([(1, text("en", 60) + " " + text("de", 30)), (2, "123 !?"), (3, "")], "doc_id long, text string")
    found = by_id(language_id.predict(mixed, names, model))
    assert found[1][0].lang_pred == "en" and 0.5 < found[1][0].score < 0.8 and "de" in found[1][0].languages
    assert found[2][0].lang_pred == found[3][0].lang_pred == "und"
    odd, _ = odd_docs
    assert language_id.predict(odd, names, model).count() == odd.count()
    assert language_id.learn(empty(docs), docs["lang"])[0] == []
    nothing = language_id.predict(docs, *language_id.learn(empty(docs), docs["lang"]))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_mixture_equals_plain_em():
    rng = random.Random(11)
    model = np.log(np.random.default_rng(1).dirichlet(np.full(language_id.BUCKETS, 0.2), 3).T + 1e-12).astype(np.float32)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n)) for n in (1, 3, 40, 400)]
    share, _ = language_id.infer(*text_bytes(pa.array(texts)), model)

    def em(likes, allowed, rounds):
        p = {k: 1 / len(allowed) for k in allowed}
        for _ in range(rounds):
            parts = [{k: p[k] * w[k] / sum(p[j] * w[j] for j in allowed) for k in allowed} for w in likes]
            p = {k: sum(x[k] for x in parts) / len(parts) for k in allowed}
        return p, sum(np.log(sum(p[k] * w[k] for k in allowed)) for w in likes)

    for text, got in zip(texts, share):
        likes = []
        for word in text.split():
            grams, *_ = language_id.trigrams(*text_bytes(pa.array([word])))
            logs = [sum(float(model[g, k]) for g in grams) for k in range(3)]
            likes.append([np.exp(max(x - max(logs), -language_id.SPREAD)) for x in logs])
        p, _ = em(likes, [0, 1, 2], language_id.ROUNDS)
        ranked, best = sorted(p, key=lambda k: -p[k]), None
        for size in (1, 2, 3):
            q, like = em(likes, ranked[:size], 1 if size == 1 else language_id.ROUNDS // 2)
            like -= language_id.PENALTY * (size - 1) * np.log(len(likes) + 1)
            if best is None or like > best[0]:
                best = like, q
        assert np.allclose(got, [best[1].get(k, 0) for k in range(3)], atol=1e-3)


def test_all_languages_of_a_text():
    rng = random.Random(4)
    names = ["aa", "bb", "cc", "dd", "ee"]
    words = [["".join(rng.choice(letters) for _ in range(6)) for _ in range(30)] for letters in ("abcde", "fghij", "klmno", "pqrst", "uvwxyz")]
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = np.full((language_id.BUCKETS, len(names)), 0.5)
    for k in range(len(names)):
        grams, *_ = language_id.trigrams(*text_bytes(pa.array([text(k, 500)])))
        model[:, k] += np.bincount(grams, minlength=language_id.BUCKETS)
    model = np.log(model / model.sum(axis=0)).astype(np.float32)
    wanted = [(0.25, 0.25, 0.25, 0.25, 0), (0.2,) * 5, (0.97, 0.03, 0, 0, 0), (1, 0, 0, 0, 0)]
    texts = [" ".join(text(k, round(p * 20_000)) for k, p in enumerate(ps) if p) for ps in wanted]
    share, _ = language_id.infer(*text_bytes(pa.array(texts)), model)
    assert ((share > 0) == (np.array(wanted) > 0)).all()
    assert np.allclose(share, wanted, atol=0.01)


# -- 10


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    out = list(text + " ")
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], ["é"], [out[k], "q"]])
    return "".join(out)


def test_banded_distance():
    rng = random.Random(5)
    left = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 14))) for _ in range(3000)]
    right = [edited(rng, x, rng.randint(0, 4)) if rng.random() < 0.9 else x[::-1] for x in left]
    plain = [distance(a, b) for a, b in zip(left, right)]
    found = line_dedup.distances(left, right).tolist()
    assert [min(d, 3) for d in found] == [min(d, 3) for d in plain]
    assert all(line_dedup.near(a, b, k) == (d <= k) for a, b, d in zip(left, right, plain) for k in range(3))
    edits = [min(2, min(len(a), len(b)) // 12) for a, b in zip(left, right)]
    assert line_dedup.linked(left, right).tolist() == [d <= e for d, e in zip(plain, edits)]


def test_very_long_lines_are_compared_by_equal_stretches():
    a = "lorem ipsum " * 500_000
    for b, same in ((a[:7] + "x" + a[7:-3] + "yz", False), (a[:7] + "x" + a[8:-1] + "y", True), (a[1:-1], True), ("x" + a[1:4_000_000] + a[4_000_002:], False)):
        assert line_dedup.linked([a], [b]).tolist() == [same]


def test_line_parity_maps_bound_the_edits():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(30, 80)))
        b = edited(rng, a, rng.randint(0, 2))[:-1] if rng.random() < 0.5 else a[1:-1]
        maps = line_dedup.parity(line_dedup.Lines([a + "\n", b]))
        if distance(a, b) <= line_dedup.TAU:
            differ = sum(int(x).bit_count() for x in (maps[0] ^ maps[1]).view(np.uint64))
            assert differ <= 2 * line_dedup.GRAM * line_dedup.TAU


@pytest.mark.parametrize("at_once", [1, 7, 1 << 18])
def test_keys_are_matched_whatever_fits_at_once(monkeypatch, at_once):
    monkeypatch.setattr(line_dedup, "LOOKUP_KEYS", at_once)
    rng = random.Random(at_once)
    rows, held = [], defaultdict(lambda: (set(), set()))
    for part in range(4):
        for probe in (0, 1):
            for _ in range(rng.randint(0, 9)):
                pairs = [(part + 4 * min(rng.randint(0, 30), rng.randint(0, 30)), rng.randint(-5, 60)) for _ in range(rng.randint(1, 12))]
                rows.append((part, probe, [k for k, _ in pairs], [x for _, x in pairs]))
                for k, x in pairs:
                    held[k][probe].add(x)
    expected = {(k, x) for k, (own, met) in held.items() if own and len(own | met) > 1 for x in own | met}
    table = pa.table({n: [r[k] for r in rows] for k, n in enumerate(["part", "probe", "keys", "lines"])})
    found = [tuple(r.values()) for b in line_dedup._match_keys(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()]
    assert expected and set(found) == expected
    assert not list(line_dedup._match_keys(iter([])))


def test_a_task_tells_the_lines_it_has_met():
    rng = np.random.default_rng(4)
    fresh, met = line_dedup.Fresh(50), []
    for _ in range(40):
        names = rng.integers(-30, 30, rng.integers(0, 12))
        places = fresh(names)
        assert len(set(names[places])) == len(places) and len(fresh.known) <= 50
        met += names[places].tolist()
        assert set(names) <= set(met)
    assert len(met) > len(set(met))  # it forgets, and then tells them again
    plain = line_dedup.Fresh()
    assert plain(np.array([5, 3, 5])).tolist() == [0, 1] and plain(np.array([3, 9, 5])).tolist() == [1]


def test_line_dedup(spark, odd_docs):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    bases = [" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(60)]
    rows = []
    for k in range(60):
        lines = [edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 3])) if rng.random() < 0.7 else rng.choice(["short", "", bases[0][:24], edited(rng, bases[1][:14], 1).strip(), bases[2][:12], " ".join(word() for _ in range(20))]) for _ in range(rng.randint(0, 8))]
        rows.append((k, "\n".join(lines), "l", 0.0, 1))
    lines = [(d, n, x) for d, t, *_ in rows for n, x in enumerate(t.split("\n")) if x.strip()]
    distinct = sorted({x for *_, x in lines})
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 12)]
    assert len(links) > 30
    of = components_of(links, distinct)
    seen, gone = set(), set()
    for d, n, x in lines:
        (gone.add((d, n)) if of[x] in seen else seen.add(of[x]))
    extra = [(None, bases[0], "l", 0.0, 1), rows[3], (99, None, "l", 0.0, 1)]
    docs = spark.createDataFrame([*rows, *extra], SCHEMA)
    kept, counted = line_dedup.dedup_lines(docs)
    found = by_id(counted)
    for d, t, *_ in rows:
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
        assert (found[d][0].n_removed, found[d][0].text) == (sum(g[0] == d for g in gone), left)
    assert found[None][0].text == bases[0] and found[99][0].text is None and len(found[3]) == 2
    assert kept.columns == docs.columns
    lost = {d for d, *_ in rows if found[d][0].n_removed and found[d][0].n_removed == found[d][0].n_compared}
    assert sum(r[0].n_short for r in found.values()) > 0
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in [*rows, *extra]} - lost
    assert line_dedup.dedup_lines(empty(docs))[1].count() == 0
    odd, odd_rows = odd_docs
    assert line_dedup.dedup_lines(odd)[1].count() == len(odd_rows)


def test_documents_with_lines_left_stay(spark):
    import corpus_pipeline

    header = "one header line that is repeated everywhere"
    rows = [(1, header), (2, f"{header}\nshort verse\nall its own"), (3, f"{header}\n \n"), (4, " \n"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_lines(spark, docs, "").collect()}
    assert kept == {1: header, 2: "short verse\nall its own", 4: " \n", 5: None}


def test_lines_that_allow_no_edit_are_cut_exactly(spark, tmp_path):
    from inkwell.llm import queries

    texts = {1: "Les.\n\nAnd ornd.\n漢字の文。", 2: "Les.\n\nand ornd.\nLes.", 3: "漢字の文。\nx\n\u3000", 4: "x\ny\n" + "a long line " * 3, 5: "y", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = {1: texts[1], 2: "\nand ornd.", 3: "x\n\u3000", 4: "y\n" + "a long line " * 3, 5: ""}
    removed = {1: 0, 2: 2, 3: 1, 4: 1, 5: 1}
    found = by_id(queries.op10_line_dedup(spark, str(tmp_path)))
    assert {k: r[0].n_removed for k, r in found.items()} == {**removed, 6: 0}
    assert all(found[k][0].text_sha256 == hashlib.sha256(t.encode()).hexdigest() for k, t in left.items())
    assert {k: r[0].n_compared for k, r in found.items()} == {1: 3, 2: 3, 3: 2, 4: 3, 5: 1, 6: 0}
    kept = {r.doc_id for r in line_dedup.dedup_lines(docs)[0].collect()}
    assert kept == {1, 2, 3, 4, 6}


def test_edits_follow_from_the_length(spark):
    rows = [(1, "short line here 1234\na line of twenty four ch\neleven char"), (2, "short line here 1235\na line of twenty four cj\neleven chas")]
    rows += [(3, "short line hier 1236\na line off twenty four cx"), (4, "short line\na line of twenty four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_short) for r in line_dedup.dedup_lines(docs)[1].collect()}
    assert found == {1: (rows[0][1], 0), 2: ("eleven chas", 1), 3: ("short line hier 1236", 0), 4: ("short line\na line of twenty four", 0)}


AWKWARD = ["a.b", "__text", "__lines", "__names", "__labelled", "__quality", "DOC_ID", "text ", "c0", "c1", "lines", "labelled"]


def test_columns_of_any_name_are_kept(spark):
    import corpus_pipeline

    names = [*AWKWARD[:6], "doc_id", "text", *AWKWARD[6:]]
    lines = ["first line of all the lines", "second line of all the lines"]
    rows = [[k] * 6 + [k, "\n".join(lines[k % 2 :])] + [str(k)] * 6 for k in range(4)]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame(rows, names)
        labels = spark.createDataFrame([(k, k % 2, k) for k in range(4)], ["doc_id", "quality", "a.b"])
        machine = quality.train(docs, labels)
        assert quality.keep(docs, machine, 0.0).collect() == docs.collect()
        kept = corpus_pipeline.cut_repeated_lines(spark, docs, "")
        assert kept.columns == names and [tuple(r) for r in kept.collect()] == [tuple(rows[0])]
        assert line_dedup.dedup_lines(docs)[1].count() == 4
        assert token_counts.count_tokens(docs, MODEL).count() == 4
        one = corpus_pipeline.keep_one_of_copies(spark, docs, "")
        assert one.columns == names
        benchmark = spark.createDataFrame([(1, "some words that no document has at all")], "item_id long, text string")
        assert decontaminate.without_contaminated(docs, benchmark).columns == names
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


# -- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding"]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    clean = [" ".join(word() for _ in range(40)) for _ in range(40)]
    junk = [" ".join(rng.choice(["BUY!!", "$$$", "WIN###"]) for _ in range(40)) for _ in range(20)]
    leak = " ".join(word() for _ in range(20))
    copy = clean[0].split()
    copy[0] = "other"
    rows = [(k, t) for k, t in enumerate([*clean, *junk])] + [(100, " ".join(copy)), (101, clean[1]), (102, clean[2] + " " + leak), (103, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(40)) <= set(found) and not set(range(40, 60)) & set(found)
    assert not {100, 101, 102} & set(found)
    assert all(found[k] == sp.encode(clean[k]) for k in range(40))


def test_pipeline_decodes(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some plain text"), (2, "  two  spaces ")], "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in corpus_pipeline.encode_pieces(spark, docs, "").collect():
        text = {1: "some plain text", 2: "  two  spaces "}[r.doc_id]
        decoded = hashlib.sha256(sp.decode(r.token_ids).encode()).hexdigest()
        assert (r.decoded_sha256, r.round_trip) == (decoded, sp.decode(sp.encode(text)) == text)
