"""Operators 11 to 13 against brute force: whole queries on odd rows, and their parts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest

from tallyweave.llm import conversation_trie, fm_index, resampling

from .test_contracts import QUERIES, corpus, write, write_others

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.01"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows():
    rows = corpus()
    rows += [(500, rows[12][1], "aa", "web")] * 3  # whole rows three times, equal keys
    rows += [(None, rows[13][1], None, None), (None, None, None, None), (501, rows[14][1], "aa", "web"), (501, rows[15][1], "aa", "web")]
    rows += [(502, "w" * 300 + " " + " ".join(f"{'lang' * 30}{i}" for i in range(25)), "aa", "web"), (503, "\0a\x01B\x7fc-d_e É é 9", None, "web")]
    return rows


def items_of(rows):
    rng, out = random.Random(9), []
    for i in range(12):
        own = words(rows[5 * i + 3][1])
        at = rng.randrange(max(1, len(own) - 15))
        out.append((i, " ".join(own[at : at + 15]).upper() if i % 2 else "–".join(own[at : at + 15])))
    return [*out, (20, "one"), (21, None), (22, ""), (23, ". , !"), (3, "two words"), (None, " ".join(words(rows[8][1])[:12])), out[4], out[4], (24, out[4][1]), (25, "never in any text")]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    rows = odd_rows()
    folder = tmp_path_factory.mktemp("odd")
    write(folder, rows)
    items = items_of(rows)
    write_others(folder, items, turns())
    return str(folder), rows, items


# resampling


def features(text):
    own = words(text)
    return len(own), [zlib.crc32(" ".join(own[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(own) - k + 1)]


def expected_ranks(docs, items):
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x for _, _, f in found for x in f), Counter(x for r in items for x in features(r)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for i, n, f in found:
        h, weight = int(sha(f"42:{'' if i is None else i}")[:8], 16), sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(str, (r[:5] for r in rows)))


@pytest.mark.parametrize("data", ["odd", "sf"])
def test_op11(spark, odd, data):
    folder = odd[0] if data == "odd" else SF
    docs = [(r["doc_id"], r["text"]) for r in ds.dataset(f"{folder}/documents.parquet").to_table().to_pylist()]
    items = [r["text"] for r in ds.dataset(f"{folder}/benchmark.parquet").to_table().to_pylist()]
    found = [[r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")] for r in QUERIES["op11_resampling"](spark, folder).collect()]
    assert sorted(map(str, found)) == expected_ranks(docs, items)


def test_checksums_of_runs_of_long_and_odd_words():
    texts = [b"a " * 5, b"x" * 400 + b" y " + b"z" * 60 + b" q", "é漢字 ß 🙂".encode() * 3, b"", b"one"]
    rows = next(resampling.featured(enumerate(texts), resampling.Words()))
    for i, t in enumerate(texts):
        assert Counter(rows[3][rows[2] == i].tolist()) == Counter(features(t.decode())[1]), i


@pytest.mark.parametrize("k", [1, 7, 40, 41, 59, 60, 100])
def test_kth_key_and_ranks_with_ties(spark, k):
    """60 of 100 rows have one score; 30 rows are equal in all columns."""
    data = [(i if i < 70 else 70, 5, i if i < 70 else 7, 0 if i >= 20 else 50 - i, 0 if i >= 40 else -i) for i in range(100)]
    rows = spark.createDataFrame([(a, d, c, 10, e, e) for a, b, c, d, e in data], "doc_id long, row_key long, n_words long, n_features long, weight long, score long")
    keys = sorted((-r["score"], r["doc_id"], r["n_features"], r["row_key"]) for r in rows.collect())
    last, below = resampling.kth_key(resampling._with_key(rows), k)
    assert (last[0], *last[2:]) == keys[k - 1] and below == sum(x < keys[k - 1] for x in keys)
    found = resampling.ranked(rows, k).collect()
    assert len(found) == 100 and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, k + 1))
    assert [(-r["score"], r["doc_id"], r["n_features"], r["row_key"]) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == keys[:k]


def test_resampled_keeps_whole_rows(spark, odd):
    docs, target = (spark.read.parquet(f"{odd[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    found, ranks = resampling.resampled(docs, target, percent=50).collect(), resampling.importance_ranks(docs, target, percent=50).where("rank IS NOT NULL").collect()
    assert found and sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in ranks)
    assert not Counter(map(str, found)) - Counter(map(str, docs.collect()))


# decontamination


def expected_hits(docs, items, size=10):
    windows = defaultdict(set)
    for name, text in items:
        own = words(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            windows[tuple(own[i : i + size])].add("" if name is None else str(name))
    lengths = {len(x) for x in windows}
    for i, text in docs:
        own, hit, names = words(text), set(), set()
        for n in lengths:
            for j in range(len(own) - n + 1):
                if (x := tuple(own[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    names |= windows[x]
        yield i, own, hit, sorted(names)


@pytest.mark.parametrize("block", [1 << 22, 150])
@pytest.mark.parametrize("shard", [1 << 20, 900])
def test_op12(spark, odd, monkeypatch, block, shard):
    monkeypatch.setattr(fm_index, "BLOCK", block)
    monkeypatch.setattr(fm_index, "SHARD", shard)
    folder, rows, items = odd
    expected = [(i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)) for i, w, hit, names in expected_hits([r[:2] for r in rows], items)]
    found = [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in QUERIES["op12_decontamination"](spark, folder).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected)) and sum(r[5] for r in found) > 10


def test_op12_on_sf(spark):
    docs, items = (ds.dataset(f"{SF}/{t}.parquet").to_table().to_pylist() for t in ("documents", "benchmark"))
    expected = {i: (len(hit), len(names)) for i, _, hit, names in expected_hits([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])}
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in QUERIES["op12_decontamination"](spark, SF).collect()} == expected


def test_index_counts_and_finds_any_phrase():
    rng = random.Random(3)
    texts = [[rng.choice("abcde") for _ in range(rng.randrange(0, 90))] for _ in range(40)] + [list("ab" * 300)] * 3
    numbers = fm_index.Numbers()
    ids = [np.array([numbers[w.encode()] for w in t], np.int64) for t in texts]
    index = fm_index.Index(*fm_index.Index.build(ids, numbers))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    for _ in range(200):
        phrase = rng.choice([list("ab" * rng.randrange(1, 40)), [rng.choice("abcde") for _ in range(rng.randrange(1, 6))]])
        symbols = np.array([[index.number[w.encode()] for w in phrase]])
        low, high = index.search(symbols, np.array([len(phrase)]))
        places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert places == [int(starts[i]) + j for i, t in enumerate(texts) for j in range(len(t) - len(phrase) + 1) if t[j : j + len(phrase)] == phrase]


def test_without_contamination(spark, odd):
    folder, rows, items = odd
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = fm_index.without_contamination(docs, benchmark).collect()
    assert len(found) == len(rows) and set(found[0].asDict()) == set(docs.columns)
    left = sorted((str(r["doc_id"]), tuple(words(r["text"]))) for r in found)
    assert left == sorted((str(i), tuple(w for j, w in enumerate(own) if j not in hit)) for i, own, hit, _ in expected_hits([r[:2] for r in rows], items))
    clean = {i for i, _, hit, _ in expected_hits([r[:2] for r in rows], items) if not hit}
    texts = {r[0]: r[1] for r in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in found if r["doc_id"] in clean and r["doc_id"] not in (None, 501))


# tries


def turns():
    rng, rows = random.Random(4), []
    says = [f"t{i}" for i in range(3)] + ["", None, "ä漢🙂"]
    for c in range(160):
        rows += [(c, k, rng.choice(["user", None]), rng.choice(says)) for k in range(rng.randrange(1, 9))]
    rows += [(c, k, "user", "same") for c in range(1000, 1120) for k in range(6)]  # one large group
    rows += [(2003, 0, "user", "no first conversation"), (-7, 0, "user", "t1"), (-10, None, "user", "t1"), (-10, 0, "a", "t2"), (None, 0, "user", "t0"), (3001, 0, "user", "t0"), (3001, 0, "user", "t0")]
    return rows


def expected_nodes(rows):
    by = defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            by[c].append((k is not None, k or 0, role or "", text or ""))
    whole = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    paths = {c: whole.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9 :] for c, v in whole.items()}
    nodes, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        if p:
            saved[p] += (len(nodes[p]) - 1) * len(p[-1][1].encode())
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(paths[c]) == len(p))))
        yield min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), children[p], leaves[p], saved[p], sha(ends)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("fan", [32, 2])
def test_op13(spark, odd, monkeypatch, fan):
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    monkeypatch.setattr(conversation_trie, "IDS", 7)
    found = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_trie"](spark, odd[0]).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected_nodes(turns())))


def test_op13_on_sf(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in ds.dataset(f"{SF}/conversations.parquet").to_table().to_pylist()]
    found = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_trie"](spark, SF).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected_nodes(rows)))


def test_trie_of_given_paths(spark):
    """The operator itself, on paths that are no conversations."""
    code = lambda c: c.encode() * 16 + (3).to_bytes(4, "big")
    given = [(i, b"".join(map(code, p))) for i, p in enumerate(["", "ab", "ab", "abc", "b", "abd", "bxyz"])]
    found = conversation_trie.prefix_trie(spark.createDataFrame(given, "conv_id long, path binary"))
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in found.collect()}
    assert got == {(0, 0): (None, 7, 2, 3, 21), (1, 1): (0, 4, 1, 2, 18), (1, 2): (1, 4, 2, 2, 9), (3, 3): (1, 1, 0, 1, 0), (5, 3): (1, 1, 0, 1, 0), (4, 1): (0, 2, 1, 1, 3), (6, 2): (4, 1, 1, 1, 0), (6, 3): (6, 1, 1, 1, 0), (6, 4): (6, 1, 0, 1, 0)}


def test_packed_ids():
    ids = np.array([-5, 0, 3, 10**12], np.int64)
    assert conversation_trie.unpacked(conversation_trie.packed(ids)).tolist() == ids.tolist()
