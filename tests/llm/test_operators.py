"""Parts of the ten operators against plain loops: carving, spans, chains, prefix tables, bit widths, stages, odd tables."""

import gzip
import hashlib
import io
import itertools
import random
import zipfile
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import bpe, langid, line_crf, media, minhash, mixing, packing, quality, sharding, suffix_dedup
from tallyweave.llm.common import documents

SF = "/root/testdata/sf0.01"
GIF = b"GIF89a\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b"!\xf9\x04\0\0\0\0\0," + b"\0" * 9 + b"\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04xy\x12\xff\0\x33\xff\xd0\x44\xff\xd9"
OGG = b"OggS\0\x04" + b"\0" * 20 + b"\x01\x02de"
MP4 = b"\0\0\0\x10ftypisom\0\0\0\0\0\0\0\x08moov"
PDF = b"%PDF-1.4 x startxref 12 %%EOF"


def archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr("a", "hello" * 40)
    return out.getvalue()


MEDIA = [(GIF, "image/gif"), (JPEG, "image/jpeg"), (OGG, "audio/ogg"), (PDF, "application/pdf"), (archive(), "application/zip"), (gzip.compress(b"hi" * 90), "application/gzip"), *((media.store(b"ab" * 192, k), k) for k in media.STORED)]


def test_op1_carves_what_was_planted(spark):
    rng = random.Random(1)
    noise = lambda: bytes(rng.choice(b"ab \nBMPK%ftyp\xff") for _ in range(rng.randrange(0, 30))) + b"--"
    rows, expected = [], {}
    for i in range(60):
        parts = rng.sample(MEDIA, rng.randrange(0, 4))
        body, places = (b"" if i % 3 else noise()), []
        for data, kind in parts:
            places.append((len(body), len(data), kind))
            body += data + noise()
        rows.append((i, body, "image/jpeg"))
        expected[i] = places
    rows += [(100, b"", None), (101, None, "image/png"), (102, GIF[:-1], "image/gif"), (103, MP4, "video/mp4")]
    expected |= {100: [], 101: [], 102: [], 103: [(0, len(MP4), "video/mp4")]}
    found = media.sniff_media(spark.createDataFrame(rows, "id long, data binary, declared string"), "data", "declared", "id").collect()
    bodies = {i: b or b"" for i, b, _ in rows}
    for r in found:
        own = expected[r["id"]]
        start = next(((n, k) for a, n, k in own if a == 0), (None, "application/octet-stream"))
        assert (r["media_length"], r["media_type"]) == start and r["was_wrong"] == (start[1] != dict((i, d) for i, _, d in rows)[r["id"]])
        planted = {(a, n, k) for a, n, k in own if a}
        carved = {(x["offset"], x["length"], x["media_type"]) for x in r["embedded"]}
        assert planted <= carved and all(bytes(x["bytes"]) == bodies[r["id"]][x["offset"] : x["offset"] + x["length"]] for x in r["embedded"])


def test_op1_features_and_types(spark):
    texts = [None, "", "a", "é" * 300, "x" * 192 * 5 + "y", "%PDF- PK\x03\x04 BM " * 4000]
    rows = media.media_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        kind = media.STORED[len(payload) // 192 % 3]
        stored, counts = media.store(payload, kind), Counter(payload)
        assert (r["media_bytes"], r["media_sha256"], r["was_wrong"]) == (len(stored), hashlib.sha256(stored).hexdigest(), True)
        assert r["feature"].startswith(f"{kind}|{len(payload) // 192}x192|levels={len(counts)}|mean={sum(payload) // len(payload)}|")
        assert (r["media_at"] > 0) == (len(payload) // 192 // 3 % 3 == 2)


@pytest.mark.parametrize("unit", [b"%PDF-", b"PK\x03\x04", b"\0\0\0\x08ftyp", b"\xff\xd8\xff\xda\0\x02", b"OggS\0\0" + b"\0" * 21])
def test_op1_many_magics_take_few_passes(unit):
    body = media.Body(unit * 200_000)
    assert len(body.hits) >= 200_000 and media.sniff(unit * 200_000) == [] or unit.startswith(b"OggS")


def test_op2_appends_and_edits_equal_fresh_tables():
    coder = bpe.encoder(bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY)), "test", public_tokenizers.PATTERN)
    rng, letters = random.Random(4), "abcdefghinorst éß漢"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n)).encode()
    for _ in range(150):
        table = bpe.PrefixTable(coder, piece(rng.randrange(1, 40)))
        for _ in range(4):
            if rng.random() < 0.5:
                table.append(piece(rng.randrange(1, 9)))
            else:
                a = rng.randrange(len(table.piece))
                table.replace(a, min(len(table.piece), a + rng.randrange(4)), piece(rng.randrange(1, 6)))
            assert table.ids() == bpe.PrefixTable(coder, table.piece).ids()


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 21, 32])
def test_op3_any_width_and_any_range(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 3001, dtype=np.uint64).astype(np.uint32)
    packed = packing.pack_bits(ids, bits)
    assert len(packed) == -(-3001 * bits // 8)
    for start, n in ((0, 3001), (0, 0), (7, 1), (1234, 999), (3000, 1)):
        assert (packing.unpack_bits(packed, bits, start, n) == ids[start : start + n]).all()


def test_op3_reads_ranges(spark):
    docs = documents(spark, SF).limit(300)
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    folder = packing.scratch_dir(spark)
    path = public_tokenizers.path(packing.FILE)
    packing.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, folder)
    with open(path, encoding="utf-8") as f:
        coder = packing.LibraryEncoder(f.read())
    whole = np.concatenate([x for _, t in rows for x in (coder.library.encode(t, add_special_tokens=False).ids, [0])]).astype(np.uint32)
    for start, n in ((0, 10), (len(whole) // 3, 70_000), (len(whole) - 5, 5)):
        assert (packing.read_range(spark, folder, start, n) == whole[start : start + n]).all()


def test_op4_letters_and_spans(spark):
    texts = ["5² ½ Ⅷ", "...", None, "", "12 3"]
    data = [(i, "the house of the old man and the sea", "en") for i in range(30)] + [(50 + i, "das haus und der alte mann und das meer", "de") for i in range(30)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), F.lit(True))
    odd = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in odd} == {("und", 0.0)}
    mixed = "the old man of the house 12 and the sea das alte haus und das meer und der mann"
    spans = langid.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, with_spans=True).first()["spans"]
    assert [(s["lang"], s["first"], s["words"]) for s in spans] == [("en", 0, 10), ("de", 10, 9)]


def test_op4_held_out_accuracy(spark):
    docs = documents(spark, SF)
    found = dict(langid.op4_language(spark, SF).where("held_out").select("doc_id", "lang_pred").collect())
    right = [found[r["doc_id"]] == r["lang"] for r in docs.where("lang is not null and text is not null").collect() if r["doc_id"] in found]
    assert np.mean(right) > 0.97


def test_op5_whole_rows_follow_the_mix(spark):
    docs = documents(spark, SF).where("doc_id < 400")
    docs = docs.union(docs.where("doc_id < 20"))  # rows that are equal in every column
    slim = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    expected, got = Counter(), Counter()
    for r in mixing.with_copies(slim).select("doc_id", "copies").collect():
        expected[r["doc_id"]] += r["copies"]
    out = mixing.mixed(docs.withColumn("key", F.lit("k")).withColumn("row", F.lit(1)))
    assert out.columns == [*docs.columns, "key", "row"]
    got.update(r["doc_id"] for r in out.select("doc_id").collect())
    assert got == +expected


def test_op6_recall_on_given_documents(spark):
    """All links of all pairs, at both settings."""
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in documents(spark, SF).collect()}
    for k, percent in ((3, 85), (5, 80)):
        words = minhash._WordHash()
        sets, least, holders = {i: minhash.shingles(t, k, words) for i, t in rows.items()}, {i: i for i in rows}, {}
        shared = Counter()
        for i in sorted(sets):
            for s in sets[i].tolist():
                for j in holders.setdefault(s, []):
                    shared[j, i] += 1
                holders[s].append(i)
        links = [p for p, n in shared.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
        while True:
            before = dict(least)
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
            if before == least:
                break
        found = minhash.near_duplicates(documents(spark, SF), k, percent / 100).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == least


def test_op7_moves_few_slots():
    m = sharding.table_size(16)
    a, b = sharding.fill(sharding.shard_names(16), m), sharding.fill(sharding.shard_names(15), m)
    counts = Counter(a)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sum(x != y for x, y in zip(a, b)) < 0.2 * m


def test_op8_anchor_shared_by_other_contexts(spark):
    rng = random.Random(8)
    phrase, tail = "common phrase of thirty-odd bytes in every text", "and a longer passage that several of these texts repeat word for word."
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(2, 9) for _ in range(30)) + phrase + rng.choice("xyz") + (tail if i % 5 == 0 else "") + str(rng.random()) for i in range(400)]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if b[j : j + 50] in seen:
                gone[j : j + 50] = b"\1" * 50
        seen.update(b[j : j + 50] for j in range(len(b) - 49))
        expected[i] = sum(gone)
    found = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()} == expected


def test_op9_viterbi_equals_all_labellings():
    rng = np.random.default_rng(9)
    field = line_crf.Field(rng.normal(size=line_crf.N_MARKS), rng.normal(size=(2, 2)))
    texts = [rng.normal(size=(n, line_crf.N_MARKS)) for n in (1, 7, 0, 4, 9)]
    for x, got in zip(texts, field.labels(texts)):
        value = lambda y: sum(x[t] @ field.emit * y[t] + (field.move[y[t - 1], y[t]] if t else 0) for t in range(len(x)))
        assert list(got) == list(max(itertools.product((0, 1), repeat=len(x)), key=value))


def test_op9_labels_change_inside_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    field = line_crf.fit(documents(spark, SF), labels, F.lit(True))
    clean = b"One of the lines that say something in plain words.\nAnother line of plain words follows it here."
    junk = b"BUY!! NOW!! $$$ ### %%% &&&\nBUY!! NOW!! $$$ ### %%% &&&"
    for text, expected in ((clean + b"\n" + junk, [0, 0, 1, 1]), (junk + b"\n" + clean + b"\n" + junk, [1, 1, 0, 0, 1, 1])):
        assert list(field.labels([np.array(line_crf.lines_of(text)[0])])[0]) == expected
    half = "\n".join(["Plain words of some length stand in this line of text."] * 1 + [f"Plain words number {i} of some length stand in this line." for i in range(6)] + ["BUY!! NOW!! $$$ ### %%% &&& " * 2] * 5)
    share = line_crf.rules(spark.createDataFrame([(1, half)], "doc_id long, text string"), field).first()
    assert 0.2 < share["content_share"] < 0.9
    found = line_crf.rules(documents(spark, SF), field).join(labels, "doc_id").where("not base_failed")
    by = {r["quality"]: (r["kept"], r["n"]) for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.count("*").alias("n")).collect()}
    assert by[1][0] > 0.97 and by[0][0] < 0.3


def test_op10_ranks_held_out_rows(spark):
    rows = quality.op10_quality(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_op10_threshold_is_the_quantile_of_all_labelled_rows(spark):
    found = spark.createDataFrame([(i, float(i)) for i in range(100)], "doc_id long, worth double")
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(100)], "doc_id long, quality int")
    cut = quality.threshold(found, labels, F.lit(True))
    assert 29 < cut <= 30


STAGES = dict(corpus_pipeline.STAGES)
ODD = ["score", "_id", "_text", "_key", "_", "key", "row", "node", "n", "size", "bucket", "component_id", "a.b"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(2)
    text = lambda: "\n".join(" ".join(rng.choice(["vel", "mor", "tis", "kan", "dul"]) + str(rng.randrange(50)) for _ in range(9)) for _ in range(8))
    copy = text()
    rows = [(i, text()) for i in range(40)] + [(50, copy), (51, copy), (51, copy), (52, copy + " x"), (None, copy), (None, text()), (7, text()), (60, None), (61, ""), (62, "long " * 400_000 + "end")]
    df = spark.createDataFrame([(i, t, "en", "s" if (i or 0) % 2 else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ODD:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_odd_columns(spark, odd_docs, name):
    out = STAGES[name](spark, odd_docs, SF)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in ODD)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_empty_tables(spark, odd_docs, name):
    assert STAGES[name](spark, odd_docs.limit(0), SF).count() == 0


def test_stages_against_plain_loops(spark, odd_docs):
    docs = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    kept = STAGES["near_dedup"](spark, odd_docs, SF).collect()
    assert len({(r["doc_id"], r["text"]) for r in kept}) == len(kept)
    assert docs - {(r["doc_id"], r["text"]) for r in kept} == {x for x in docs if x[0] in (51, 52)} | {(None, next(t for i, t in docs if i == 50))}
    for r in STAGES["repeat_removal"](spark, odd_docs.where("doc_id in (50, 51, 60, 61)"), SF).collect():
        assert (r["text"] == "") == (r["doc_id"] != 50)
    words = bpe.encode_documents(odd_docs.where("doc_id = 62"), public_tokenizers.path(bpe.VOCABULARY)).first()
    assert words["decoded_sha256"] == hashlib.sha256(("long " * 400_000 + "end").encode()).hexdigest()


OPS = {"op2": lambda d: bpe.encode_documents(d, public_tokenizers.path(bpe.VOCABULARY)), "op1": media.media_digest, "op6": lambda d: minhash.near_duplicates(d, 3, 0.85), "op8": suffix_dedup.remove_repeats, "op9": lambda d: line_crf.rules(d, None)}


@pytest.mark.parametrize("name", OPS)
def test_rows_that_repeat_or_lack_an_id(odd_docs, name):
    found = Counter(r["doc_id"] for r in OPS[name](odd_docs).select("doc_id").collect())
    assert found == Counter(r["doc_id"] for r in odd_docs.select("doc_id").collect())


