"""The ten operators and the pipeline against brute force, exact round trips and odd inputs."""

import base64
import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestry.llm import ann, common, components, decontam, html, langid, neardup, packing, queries, simhash, substring, tokens, tokenstore, toxicity, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "the the the the the the", "É" * 300, "x " * 6000, "tab\x0bvt\x1cfs word", "日本語 テキスト ñ é", "<|endoftext|> hi", "é combining", " nbsp em"]
WORDS = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}k" for i in range(400)]


def docs(spark, texts, extra=True):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").select("doc_id", "text", *(["lang", "source", "n_chars", "score"] if extra else []))


def line(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# Tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    from tokenizers import Tokenizer

    path = common.public_tokenizer(name)
    whole = Tokenizer.from_file(path)
    enc = tokens.Encoder(path)
    rng = random.Random(0)
    chars = "abcABC 0129 '’sStTdDlL.,!?-_\n\t\réüßÀÿªº²½µ×÷¡§­<|>"
    texts = [t for t in ODD if t] + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 80))) for _ in range(400)] + ["we'll I'd 'S 'VE don't  two   three\n\n x", "ÀÉ'S"]
    for t in texts:
        assert enc.encode(t) == struct.pack(f"<{len(ids := whole.encode(t, add_special_tokens=False).ids)}I", *ids), repr(t)
    ids, sizes = enc.encode_all([None, *texts, ""], 7)
    want = [[*(whole.encode(t, add_special_tokens=False).ids if t else []), 7] for t in [None, *texts, ""]]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want] and len(enc.encode_all([], 7)[0]) == 0
    tokens_before = enc.encode("hello there")
    enc.pieces.age()
    enc.pieces.age()
    assert enc.encode("hello there") == tokens_before and enc.encode(None) == b""


@pytest.mark.parametrize("name, n", [("byte_bpe_50k.json", 4), ("word_bpe_49k.json", 3)])
def test_encoder_is_the_untouched_library(name, n):
    from tokenizers import Tokenizer

    path = common.public_tokenizer(name)
    whole, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    assert len(enc.encode("one <|endoftext|> two")) == 4 * n
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "don't", "One", "2", "é", "語", "a"]
    texts = [t for t in ODD if t] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    for t in texts:
        assert enc.encode(t) == struct.pack(f"<{len(ids := whole.encode(t, add_special_tokens=False).ids)}I", *ids), repr(t)


def test_pieces_are_cut_alike():
    rng = random.Random(9)
    parts = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", '"', ".", "  ", "\n", "\t", "a", "sam", "l", "e", "12", "3", "é", "µ", "²", "¼", "ÿ", "x" * 20, "abcdefgh", "abcdefg", "abcdefghijklmnop", "-", "--"]
    for _ in range(3000):
        line_ = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        first, size = tokens.cut_unspaced(np.frombuffer(line_.encode("latin-1"), np.uint8))
        assert [line_[a : a + n] for a, n in zip(first.tolist(), size.tolist())] == tokens._UNSPACED.findall(line_), repr(line_)


# Packing


def test_best_two_fit_packs_everything_tightly():
    rng = random.Random(2)
    for cap in (1, 7, 100):
        for _ in range(15):
            counts = {}
            for _ in range(rng.randint(0, 60)):
                x = min(cap, max(1, int(rng.paretovariate(1.0) * cap / 8)))
                counts[x] = counts.get(x, 0) + 1
            plan = packing.best_two_fit(counts, cap)
            used = {}
            for p in plan:
                assert sum(a * n for a, n in p.items) <= cap
                for a, n in p.items:
                    used[a] = used.get(a, 0) + n * p.times
            assert used == counts
            bins, total = sum(p.times for p in plan), sum(a * n for a, n in counts.items())
            assert bins <= -(-total // cap) * 11 / 9 + 1
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2, 5: 1}, 10)[0].items in (((6, 1), (2, 2)), ((6, 1), (3, 1), (2, 0)), ((5, 1), (3, 1), (2, 1)), ((6, 1), (2, 2)))
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def test_packing_places_every_piece(spark):
    texts = [t or "" for t in ODD] + ["word " * 40] * 9
    df = docs(spark, [*ODD, *["word " * 40] * 9])
    df = df.unionAll(df.where("doc_id = 3"))
    enc = tokens.Encoder(common.public_tokenizer("byte_bpe_50k.json"))
    rows = packing.pack(df, common.public_tokenizer("byte_bpe_50k.json"), 64, 0).toPandas()
    assert len(set(zip(rows.sequence_id, rows.offset))) == len(rows)
    for i, t in enumerate(texts):
        ids = enc.encode(t) + b"\0\0\0\0"
        g = rows[rows.doc_id == i].drop_duplicates(["piece", "start"]).sort_values("piece")
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() * 4 == len(ids)
        assert all(n == 64 for n in g.length[1:])
        assert [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(g.start, g.length)] == list(g.ids_crc32)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
    assert packing.pack(df.limit(0), common.public_tokenizer("byte_bpe_50k.json"), 64, 0).count() == 0


# Token store


def test_store_round_trip_and_damage(spark):
    rng = random.Random(4)
    shared = line(rng, 900)
    texts = [*ODD, shared, shared, f"{line(rng, 30)} {shared} {line(rng, 50)}", line(rng, 500)]
    path = common.public_tokenizer("word_bpe_49k.json")
    df = docs(spark, texts)
    df = df.unionAll(df.where("doc_id = 12")).repartition(3)
    manifest = tokenstore.write_store(df, common.new_path(spark, "t"), path, 2)
    rows = tokenstore.read_store(spark, manifest, ids=True).orderBy("start").collect()
    enc, at = tokens.Encoder(path), 0
    for r, (i, t) in zip(rows, sorted([*enumerate(texts), (12, shared)]), strict=True):
        ids = enc.encode(t) + struct.pack("<I", 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert tokenstore.Manifest.load(spark, manifest.path) == manifest
    chunks = spark.read.schema(tokenstore.STORED).parquet(f"{manifest.path}/packs")
    stored = chunks.where("kind = 'chunk'").select(F.col("digests")[0]).collect()
    assert stored and len(stored) == len({bytes(r[0]) for r in stored})
    other = tokenstore.Manifest(**(manifest.__dict__ | {"root": "00"}))
    with pytest.raises(ValueError):
        tokenstore.read_store(spark, other)
    with pytest.raises(Exception, match="doesn't fit"):
        tokenstore.write_store(df, common.new_path(spark, "t"), path, 70_000)
    wide = tokenstore.write_store(df.where("doc_id < 5"), common.new_path(spark, "t"), path, 70_000, width=4)
    assert sorted(r.n_tokens for r in tokenstore.read_store(spark, wide).collect())[:3] == [1, 1, 1]
    empty = tokenstore.write_store(df.limit(0), common.new_path(spark, "t"), path, 2)
    assert tokenstore.read_store(spark, empty).count() == 0


def test_chunks_follow_the_content():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5000, 9000), rng.integers(0, 5000, 321)
    one, two = tokenstore.cuts(a), tokenstore.cuts(np.concatenate([b, a]))
    assert one[-1] == 9000 and all(x < y for x, y in zip(one, one[1:]))
    assert all(y - x <= tokenstore.LARGEST for x, y in zip([0, *one], one))
    assert len({x for x in one} & {x - 321 for x in two}) > 0.8 * len(one)
    assert tokenstore.cuts(np.zeros(0, int)) == [] and tokenstore.cuts(np.zeros(5000, int))[-1] == 5000
    assert tokenstore.merkle_root([b"a", b"b"]) != tokenstore.merkle_root([b"b", b"a"]) != tokenstore.merkle_root([b"a"])


# SimHash


def slow_print(text, width=4):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(8)
    base = [line(rng, rng.choice((3, 30, 200))) for _ in range(30)]
    edited = []
    for t in base * 3:
        w = t.split()
        w[rng.randrange(len(w))] = "zz"
        edited.append(" ".join(w))
    texts = [*ODD, *base, *edited, *base[:5]]
    df = docs(spark, texts)
    df = df.unionAll(df.where("doc_id in (3, 13)"))
    rows = simhash.near_duplicates(df).collect()
    prints = [slow_print(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == find(r.doc_id)
    kept = simhash.keep_first(df, width=4)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "a b")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(nulls).collect()] == [5, 5, 5]
    apart = spark.createDataFrame([(None, line(rng, 50), 1), (None, line(rng, 50), 1), (7, line(rng, 50), 1), (7, line(rng, 50), 1), (7, None, 1), (8, "", 1)], "doc_id long, text string, kept_id int")
    assert sorted(map(str, (r.doc_id for r in simhash.keep_first(apart.unionAll(apart)).collect()))) == ["7", "7", "7", "None", "None"]


def test_near_dedup_stage_is_brute_force_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [*ODD]
    common_line = line(rng, 30)
    for n in (8, 30, 60, 60, 120, 250):
        base = line(rng, n)
        texts += [base, f"{common_line} {base}", base.upper()]
        for k in range(24):
            w = base.split()
            for _ in range(rng.randint(1, 1 + n // 40)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice((["zz"], [], ["yy", "xx"]))
            texts.append(" ".join(w) if k % 3 else " ".join(w[: len(w) * rng.randint(80, 100) // 100]))
    df = docs(spark, texts)
    words = [[x.decode() for x in (t or "").encode().lower().split()] for t in texts]
    sets = [set(slow_shingles(w)) for w in words]
    parent, far = list(range(len(texts))), 0

    def find(x):
        return x if parent[x] == x else find(parent[x])

    prints = [slow_print(t, 5) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * both >= 4 * either:  # no words: equal
            far += (prints[a] ^ prints[b]).bit_count() > 4
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert far > 50
    want = sorted({find(i) for i in range(len(texts))})
    kept = corpus_pipeline.simhash_near_dedup(spark, df.unionAll(df.where("doc_id in (3, 13)")).repartition(3), SF)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(texts) - 30
    assert neardup.keep_first(df.limit(0)).count() == 0
    neardup.CELL, before = 3, neardup.CELL  # keys with many classes are dealt out in cells
    assert sorted(r.doc_id for r in neardup.keep_first(df).collect()) == want
    neardup.CELL = before
    apart = spark.createDataFrame([(None, texts[-1]), (None, texts[20]), (7, texts[-1]), (7, line(rng, 50))], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in neardup.keep_first(apart.unionAll(apart)).collect()))) == ["7", "7", "None"]


def test_bucket_links_in_a_dense_bucket():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 64, 3, np.uint64)
    fps = np.unique(np.array([c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in centre for a, b in rng.integers(0, 64, (300, 2))]))
    table = np.bitwise_count(fps[:, None] ^ simhash.pivots()[None]).astype(np.int8)
    seen = [0, 0, 0, 0]
    a, b = simhash.bucket_links(np.zeros(len(fps), np.int64), fps, table, 4, seen)
    assert len(a) == len(fps) - 3 and (np.bitwise_count(a ^ b) < 64).all()
    assert seen[0] == seen[1] + seen[2] and seen[1] > 0.9 * (seen[0] - seen[3]) and seen[2] >= seen[3] > 0


def test_cells_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 60, np.uint64)
    fps = [int(x) for x in base]
    for x in base:
        for k in (3, 4, 4, 5):
            y = int(x)
            for bit in rng.choice(64, k, replace=False):
                y ^= 1 << int(bit)
            fps.append(y)
    fps = sorted(set(fps))
    frame = common.staged(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long"), "fps")
    parent = {x: x for x in fps}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = len({find(x) for x in fps})
    for agree, crowded in ((2, 4096), (3, 4096), (4, 4096), (2, 2)):  # the last: every cell that matters is dealt anew
        counts = [spark.sparkContext.accumulator(0) for _ in range(4)]
        edges = common.staged(simhash.links(frame, 4, agree, crowded, counts), "edges")
        labels = {r.node: r.label for r in components.connected_components(edges).collect()}
        got = {x: labels.get(x - (1 << 64) if x >> 63 else x, x) for x in fps}
        assert len(set(got.values())) == want
        assert counts[0].value == counts[1].value + counts[2].value and counts[3].value >= len(fps) - want


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((40, 30), (40, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)]
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            return x if parent[x] == x else find(parent[x])

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_sets_meet_by_their_fingerprints():
    rng = np.random.default_rng(3)
    prints = [slow_print(t, 5) for t in ("one two three", "a b c d e f g h i j k l", "x y")]
    assert [int(neardup.fingerprint(neardup.shingle_set(t, 5))[0]) for t in ("one two three", "a b c d e f g h i j k l", "x y")] == prints
    assert neardup.differing(0.8) == 0.1875 and neardup.blocks(100, 0.8) == (0, 1) and neardup.blocks(1 << 30, 0.8)[0] == 18
    bits, bands = neardup.blocks(neardup.CELL * 60, 0.8)
    for _ in range(300):  # similarity of just 0.8
        k = int(rng.integers(1, 60))
        union = rng.integers(0, 1 << 64, 5 * k, np.uint64)
        x = int(rng.integers(0, k + 1))
        a, b = (neardup.fingerprint(h, -(-bits * bands // 64)) for h in (union[: 5 * k - x], union[k - x :]))
        assert sum((int(p) ^ int(q)).bit_count() for p, q in zip(a[: neardup.HEAD], b)) <= neardup.radius(64 * neardup.HEAD, 0.8)
        cut = [sum(int(w) << (64 * i) for i, w in enumerate(p)) for p in (a, b)]
        agree = [all((p >> (bits * n + i) & 1) == (q >> (bits * n + i) & 1) for i in range(bits)) for n in range(bands) for p, q in [cut]]
        keys = neardup.block_keys(np.stack([a, b]), bits, bands)
        assert (keys[0] == keys[1]).tolist() == agree and any(agree)
    n = np.sort(rng.integers(50, 90, 300))
    head = rng.integers(0, 1 << 64, (300, neardup.HEAD), np.uint64)
    for i in range(0, 300, 3):  # some are near others
        head[i] = head[i // 30 * 30] ^ np.bitwise_and.reduce(rng.integers(0, 1 << 64, (2 + i % 2, neardup.HEAD), np.uint64))
    found = {(int(i), int(j), int(d)) for x in neardup.close_pairs(n, head, 0.8) for i, j, d in zip(*x)}
    apart = np.bitwise_count(head[:, None] ^ head[None]).sum(2)
    first = np.bitwise_count(head[:, None, : neardup.FIRST] ^ head[None, :, : neardup.FIRST]).sum(2)
    near = (apart <= neardup.radius(64 * neardup.HEAD, 0.8)) & (first <= neardup.radius(64 * neardup.FIRST, 0.8))
    want = {(i, j, int(apart[i, j])) for i in range(300) for j in range(i + 1, 300) if near[i, j] and n[i] >= 0.8 * n[j] - 1e-9}
    assert found == want and len(want) > 50


def test_coordinates_discard_no_similar_pair():
    rng = np.random.default_rng(0)
    kept = 0
    for _ in range(400):
        n = int(rng.integers(1, 900))
        a = rng.integers(0, 1 << 64, n, np.uint64)
        b = a.copy()
        k = int(rng.integers(0, max(1, n // 3)))
        b[:k] = rng.integers(0, 1 << 64, k, np.uint64)
        b = b[: n - int(rng.integers(0, max(1, n // 10)))]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        may = bool(neardup.can_reach(np.array([len(a)]), np.array([len(b)]), neardup.coordinates(a)[None], neardup.coordinates(b)[None], 0.8)[0])
        assert may or both < 0.8 * (len(a) + len(b) - both)
        kept += may
        if both >= 0.9 * (len(a) + len(b) - both):
            assert np.isin(neardup.signature(a), neardup.signature(b)).any()
    assert 0 < kept < 400
    far = [np.unique(rng.integers(0, 1 << 64, 300, np.uint64)) for _ in range(2)]
    assert not neardup.can_reach(300, 300, *(neardup.coordinates(x) for x in far), 0.8)
    assert len(neardup.signature(np.zeros(0, np.uint64))) == 0 and len(set(neardup.signature(far[0]).tolist())) == neardup.BANDS


# Substring


def slow_substring(texts, window):
    first, out = {}, []
    for i, t in enumerate(texts):
        w = common.WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if first.setdefault(k, i) < i:
                gone[s : s + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_substring_dedup_is_brute_force(spark):
    rng = random.Random(6)
    passages = [line(rng, rng.randint(20, 130)) for _ in range(8)]
    texts = [*ODD, "same " * 130, "same " * 90]
    for _ in range(60):
        parts = [line(rng, rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 15)
            parts.insert(rng.randint(0, len(parts)), " ".join(p[a : len(p) - rng.randint(0, 15)]))
        texts.append("  ".join(parts))
    texts += texts[20:30]
    df = docs(spark, texts).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df).collect()}
    assert [got[i] for i in range(len(texts))] == slow_substring(texts, 50)
    assert sum(x[1] for x in got.values()) > 500
    kept = {r.doc_id: r.text for r in substring.without_repeats(df).collect()}
    for i, (n, removed, digest) in got.items():
        if n and n == removed:
            assert i not in kept
        elif removed:
            assert hashlib.sha256(kept[i].encode()).hexdigest() == digest
        else:
            assert kept[i] == texts[i]
    real = substring.automaton
    try:  # what the automata don't locate isn't removed
        substring.automaton = lambda phrases: real(())
        assert all(r.n_removed == 0 for r in substring.substring_dedup(df).collect())
    finally:
        substring.automaton = real
    assert substring.substring_dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, texts[-1]), (1, texts[-1]), (None, texts[-1])], "doc_id long, text string")
    assert [r.n_removed for r in substring.substring_dedup(twice).collect()] == [0, 0, 0]
    a, b = line(rng, 90), line(rng, 80)
    again = spark.createDataFrame([(1, a), (1, b), (2, f"x {a}"), (2, f"y {b}"), (2, f"y {b}")], "doc_id long, text string")
    assert sorted(r.text for r in substring.without_repeats(again).collect()) == sorted([a, b, "x", "y", "y"])


def test_words_are_hashed_alike_everywhere():
    rng = random.Random(2)
    text = "  ".join(rng.choice(["a", "bé", "語語", "x" * 70_000, "\x1c", "y" * 30]) for _ in range(60)) + "\n" + "z" * (substring.SPAN_BYTES + 9) + " a"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, h = substring.word_hashes(data)
    words = substring.split(text)
    assert [text.encode()[s : s + len(w.encode())].decode() for s, w in zip(starts.tolist(), words, strict=True)] == words
    known = {}
    for w, x in zip(words, h.tolist()):
        assert known.setdefault(w, x) == x
        assert substring.word_hashes(np.frombuffer(f" {w}".encode(), np.uint8))[1].tolist() == [x]
    assert len(set(known.values())) == len(known) and len(substring.word_hashes(np.zeros(0, np.uint8))[0]) == 0
    assert substring.plain(text).split(" ") == words and substring.plain(" \t") == substring.plain(None) == ""


def test_rolling_hash():
    x = np.random.default_rng(0).integers(0, 1 << 63, 200, np.uint64)
    for n in (1, 2, 12, 39, 50):
        got = substring.rolling(x, n, np.uint64(31))
        for i in (0, 7, 200 - n):
            want = 0
            for v in x[i : i + n].tolist():
                want = (want * 31 + v) % (1 << 64)
            assert int(got[i]) == want


# Decontamination


def slow_similarity(a, b):
    from collections import Counter

    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def slow_shingles(words, width=5):
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def test_decontamination_is_brute_force(spark):
    rng = random.Random(9)
    items = [line(rng, n) for n in (14, 20, 36, 50, 59, 6, 3)] + ["", None]
    texts = [*ODD]
    for k in range(40):
        w = rng.choice([x for x in items if x]).split()
        if k % 4 == 1:
            w[rng.choice((0, len(w) - 1))] = "edit"
        if k % 4 == 2:
            w[len(w) // 2] = "edit"
        if k % 4 == 3:
            w = w[: len(w) // 2]
        texts.append(f"{line(rng, rng.randint(0, 60))} {' '.join(w).upper() if k % 5 == 0 else ' '.join(w)} {line(rng, rng.randint(0, 60))}")
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    want = {}
    for i, t in enumerate(texts):
        words = common.WORD.findall((t or "").lower())
        for j, item in enumerate(items):
            iw = common.WORD.findall((item or "").lower())
            if not iw or not words:
                continue
            width = min(5, len(iw))
            best = max(slow_similarity(slow_shingles(words[s : s + len(iw)], width), slow_shingles(iw, width)) for s in range(max(1, len(words) - len(iw) + 1)))
            if best >= 0.8:
                want[i, j] = best
    df = docs(spark, texts)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(df.unionAll(df.limit(20)), bench).collect()}
    assert got == pytest.approx(want) and len(want) > 15
    clean = {r.doc_id for r in decontam.decontaminate(df, bench).collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in want}
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0
    before = decontam.BROADCAST_SHINGLES
    decontam.BROADCAST_SHINGLES = 60  # several passes over the documents, and items by a shuffled join
    assert {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(df, bench).collect()} == pytest.approx(want)
    decontam.BROADCAST_SHINGLES = before
    plan = decontam.contaminated(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_with_shifted_windows(spark):
    rng = random.Random(21)
    items = [line(rng, n) for n in (55, 57, 60, 40)]
    texts = []
    for k in range(60):
        w = rng.choice(items).split()
        if k % 5 == 4:  # halves that change places keep almost all shingles
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        for _ in range(rng.randint(1, 3)):
            at = rng.choice((1, 2, 3, len(w) - 3, len(w) - 2, rng.randrange(len(w))))
            if rng.random() < 0.5:
                w.insert(at, rng.choice(WORDS))
            else:
                del w[at]
        texts.append(f"{line(rng, rng.randint(0, 30))} {' '.join(w)} {line(rng, rng.randint(0, 30))}")
    want, shares = {}, [slow_shingles(x.split()) for x in items]
    for i, t in enumerate(texts):
        words = t.split()
        for j, item in enumerate(items):
            n = len(item.split())
            best = max(slow_similarity(slow_shingles(words[s : s + n]), shares[j]) for s in range(max(1, len(words) - n + 1)))
            if best >= 0.8:
                want[i, j] = best
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert got == pytest.approx(want) and len(want) > 15


def test_decontamination_with_repeats_and_a_long_item(spark):
    rng = random.Random(31)
    long = line(rng, 3000)
    items = ["la la la la la la la la na na na na na na na la la la", "a b c d e " * 12, long]
    texts = [items[0], items[0] + " na", items[0].replace("na", "la", 2), items[1][10:] + "x y", f"q {long[:-30]} z", long[:8000], "la " * 40]
    want = {}
    for i, t in enumerate(texts):
        words = t.split()
        for j, item in enumerate(items):
            n, share = len(item.split()), slow_shingles(item.split())
            best = max(slow_similarity(slow_shingles(words[s : s + n]), share) for s in range(max(1, len(words) - n + 1)))
            if best >= 0.8:
                want[i, j] = best
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert got == pytest.approx(want) and {(0, 0), (4, 2)} <= set(want)


def test_decontaminate_goes_by_row(spark):
    rng = random.Random(22)
    item, a, b = line(rng, 40), line(rng, 60), line(rng, 60)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = spark.createDataFrame([(None, f"{a} {item}"), (None, a), (7, f"{item} {b}"), (7, b), (8, None)], "doc_id long, text string")
    assert sorted(map(str, (r.text for r in decontam.decontaminate(rows, bench).collect()))) == sorted(["None", a, b])


# WARC


def test_warc_round_trip(spark):
    html_ = [None, "", "<p>a</p>", "<p>a</p>", "<p>a</p>", "x\r\n\r\nWARC/1.1\r\n", "é" * 3000, "big " * 400_000]
    rows = [(i, "http://x/ y\n" if i % 2 else None, h) for i, h in enumerate(html_)] + [(2, "again", "<p>a</p>"), (None, "u", "<p>a</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").drop("payload")
    folder = common.new_path(spark, "warc")
    index = warc.write_archives(pages, folder)
    got = warc.read_archives(spark, folder, payloads=True).collect()
    assert len(got) == len(rows) == index.count()
    for r in got:
        assert r.payload_digest in {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in rows}
    by = {r.page_id: r for r in got if r.page_id != 2}
    assert (by[4].record_type, by[3].record_type, by[3].refers_to, by[4].refers_to) == ("response", "revisit", 4, None)
    assert (by[0].record_type, by[0].refers_to, by[0].payload_bytes) == ("revisit", 1, 0) and by[None].refers_to == 4
    assert by[7].payload_bytes == 1_600_000 and bytes(by[7].payload).decode() == html_[7] and bytes(by[5].payload).decode() == html_[5]
    assert {(r.page_id, bytes(r.payload)) for r in warc.fetch(index, [5, 6, 99]).collect()} == {(5, html_[5].encode()), (6, html_[6].encode())}
    some = warc.fetch(index, spark.createDataFrame([(2,), (4,), (None,)], "page_id long")).collect()
    assert sorted((r.page_id, r.record_type) for r in some) == [(2, "revisit"), (2, "revisit"), (4, "response")]
    assert len({r.record_id for r in got}) == len(got)
    again = warc.write_archives(pages.repartition(3), common.new_path(spark, "warc"), broadcast_bytes=0)  # owners by a shuffle
    kinds = lambda ix: sorted((str(r.page_id), r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.fetch(ix, ix.select("page_id")).collect())
    assert kinds(again) == kinds(index) and len(kinds(index)) == len(rows) - 1
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_reads_ranges_and_names_apart(spark):
    rng = random.Random(4)
    pages = spark.createDataFrame([(7, "u", f"{i} {rng.random()} " * 30) for i in range(16)], "page_id long, url string, html string").repartition(8)
    folder = common.new_path(spark, "warc")
    index = warc.write_archives(pages, folder)
    assert len({r.record_id for r in warc.read_archives(spark, folder).collect()}) == 16
    big = spark.createDataFrame([(i, "u", rng.randbytes(300_000).hex()) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    r = warc.write_archives(big, common.new_path(spark, "warc")).where("page_id = 5").first()
    file = warc._Ranges(r.bundle)
    table = file.frames()
    file.read(*table[r.frame][:2])
    assert file.read_bytes < file.size / 4 and len(table) > 6
    fields = next(warc.parse(warc.record(1, "u", b"x", "revisit", 2, "0-0", "http://o/ 1")[1]))[1]
    assert fields["WARC-Refers-To-Target-URI"] == "http://o/%201" and "WARC-Refers-To-Date" in fields


def test_bundle_is_plain_zstandard():
    import zstandard

    b = warc.Bundle()
    raw = [warc.record(i, "u", bytes([i]) * 700_000, "response", None, i)[1] for i in range(3)]
    places = [b.add(r) for r in raw]
    data = b.bytes()
    table = warc.seek_table(data)
    assert [f for f, _ in places] == [0, 1, 2] and len(table) == 3
    assert warc.frame_bytes(data, table[1]) == raw[1]
    out = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert out == b"".join(raw)


# Neighbours


def test_neighbours_are_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((450, 24)).astype(np.float32)
    x[50] = x[51] = x[100]
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0] * 23, [None] + [1.0] * 23]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + 100 * i, v) for i, v in enumerate(bad)] + [(None, [1.0] * 24)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df).collect()}
    assert {q for q, _ in got} == {0, 100, 200, 300, 400} and len(got) == 50
    for q in (0, 100, 200, 300, 400):
        d = np.sqrt(np.cumsum((x.astype(float) - x[q].astype(float)) ** 2, axis=1)[:, -1])
        order = [i for i in np.lexsort((np.arange(450), d)) if i != q][:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, d[i]) for i in order]
    joined = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, broadcast_bytes=0).collect()}
    assert joined == got  # queries by a shuffled join
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.search(few).orderBy("rank").collect()] != [] and ann.search(few).count() == 3
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 7")).count() == 0


def test_codes_choose_what_is_reranked():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 128)) * 3
    x = centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 128)) * 0.3
    turn, centre, ids = ann.rotation(128), x.mean(0), np.arange(3000)
    seen = [0, 0]
    got = ann.nearest(ids, x, *ann.encode(x, centre, turn), ids[:50], x[:50], centre, turn, 10, seen)
    assert seen[0] == 50 * 3000 and seen[1] < 0.2 * seen[0]
    for q in range(50):
        d = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
        assert got[1][got[0] == q].tolist() == [i for i in np.lexsort((ids, d)) if i != q][:10]


# Language, toxicity, html


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op1_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    model = langid.fit_texts(["the cat and the dog of"] * 3 + ["der hund und die katze"] * 3, ["en"] * 3 + ["de"] * 3)
    names, scores = model.predict([*ODD, "und die katze 123", "\U0001f600 42"])
    assert names[:3] == ["und"] * 3 and scores[0] == 0 and names[-2:] == ["de", "und"] and all(0 <= s <= 1 for s in scores)
    df = docs(spark, ODD)
    model.floor = 0.0
    assert langid.accepted(df, model).columns == df.columns and langid.accepted(df, model).count() == len(ODD) - 3
    kept = langid.identify(df, model, keep=True)
    assert dict(kept.dtypes)["score"] == "double" and kept.count() == len(ODD)
    assert langid.identify(df.limit(0), model).count() == 0
    assert langid.fit(df.limit(0)).predict(["abc"]) == (["und"], [0.0])
    assert model.predict(["½ ² Ⅷ ①", "٣", "12 !", "º", "語", "½a"])[0] == ["und"] * 3 + [model.predict([x])[0][0] for x in "º語a"]
    assert "und" not in model.predict(["º", "語", "ñ", "½a"])[0]


def test_language_sample_has_every_language(spark):
    rng = random.Random(3)
    rows = [(i, line(rng, 5), f"l{i % 300:03d}") for i in range(900)] + [(1000 + i, line(rng, 8000) + " y" * i, "long") for i in range(12)] + [(None, "abc def", "nul"), (2000, "½ 12", "num"), (2001, None, "non"), (2002, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame.unionAll(frame), rows_each=2, max_rows=320)
    assert model.languages == sorted({f"l{i:03d}" for i in range(300)} | {"long", "nul"})


def slow_kernel(a, b):
    def sets(t):
        t = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        t = f" {' '.join(t.split())} "
        return [{t[i : i + n] for i in range(len(t) - n + 1)} for n in range(1, 5)]

    return sum(len(x & y) / max(1, len(x) * len(y)) ** 0.5 for x, y in zip(sets(a), sets(b))) / 4


def test_kernel_and_ridge_are_the_definition():
    rng = random.Random(4)
    texts = [("the cat and " if i % 2 else "der hund und ") + line(rng, rng.randint(1, 12)) for i in range(60)]
    labels = ["en" if i % 2 else "de" for i in range(60)]
    model = langid.fit_texts(texts, labels, landmarks_each=10, ridge=0.01)
    marks = [i for k in ("de", "en") for i in [j for j, x in enumerate(labels) if x == k][:10]]
    test = [line(rng, 6), "the dog and", "und die", "a", "É x"]
    want = np.array([[slow_kernel(t, texts[i]) for i in marks] for t in test])
    assert np.allclose(model.kernel(test), want, atol=2e-3)
    # Kernel ridge on the Nystroem approximation K_nm K_mm^-1 K_mn, by the dual solution.
    nm = np.array([[slow_kernel(t, texts[i]) for i in marks] for t in texts])
    inverse = np.linalg.pinv(nm[marks], rcond=1e-6)
    gram, cross = nm @ inverse @ nm.T, want @ inverse @ nm.T
    target = np.where(np.array(labels)[:, None] == np.array(["de", "en"])[None], 1.0, -1.0)
    dual = np.linalg.solve(gram + 0.01 * len(texts) * np.eye(len(texts)), target)
    assert np.allclose(model.kernel(test) @ model.weights, cross @ dual, atol=2e-2)


def test_language_stage_decides(spark):
    rng = random.Random(5)
    model = langid.fit_texts([f"the cat and the dog of {line(rng, 9)}" for _ in range(40)] + [f"der hund und die katze {line(rng, 9)}" for _ in range(40)], ["en"] * 40 + ["de"] * 40)
    texts = ["the dog and the cat", "und der hund", "日本語のテキストです", "Привет мир", None, "12", "½"]
    frame = docs(spark, texts).withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id: r.lang for r in langid.accepted(frame, model).collect()}
    assert kept == {0: "en", 1: "de"} and {r.doc_id for r in langid.accepted(frame, model, ["de"]).collect()} == {1}
    with pytest.raises(ValueError):
        langid.accepted(frame, langid.fit_texts([], []))
    assert langid.accepted(frame.limit(0), langid.fit_texts([], [])).count() == 0


def slow_segments(s):
    """All maximal segments by the recursive definition."""
    best, at = 0.0, None
    for i in range(len(s)):
        t = 0.0
        for j in range(i, len(s)):
            t += s[j]
            if t > best + 1e-12:
                best, at = t, (i, j + 1)
    if at is None:
        return []
    a, b = at
    return slow_segments(s[:a]) + [(a, b, best)] + [(b + x, b + y, v) for x, y, v in slow_segments(s[b:])]


def test_segments_are_the_definition():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice((-5.03, -2.01, -1.17, 1.19, 2.37, 4.71)) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow_segments(s)]
        assert [v for *_, v in got] == pytest.approx([v for *_, v in slow_segments(s)])


def test_toxicity(spark):
    rng = random.Random(2)
    data = [(i, line(rng, 60) + (" you idiotix scumbag " if i % 4 == 0 else " ") + line(rng, 30), int(i % 4 == 0)) for i in range(240)]
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "toxic"), frame.select("doc_id", "text"))
    test = docs(spark, [*ODD, "abk idiotix ack scumbag adk", line(rng, 80), "idiotic scumbags " * 2])
    rows = {r.doc_id: r for r in toxicity.score(test, model).collect()}
    n = len(ODD)
    assert rows[n].predicted == 1 and rows[n + 1].predicted == 0 and rows[0].score == 0 and rows[1].predicted == 0
    assert rows[n].passages[0].first <= 1 and rows[n].passages[-1].end >= 4
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert toxicity.score(test.limit(0), model).count() == 0
    assert toxicity.fit(frame.select("doc_id", "toxic").limit(0), frame).odds == {}


def test_toxicity_is_the_definition(spark):
    import math

    rng = random.Random(8)
    data = []
    for i in range(400):
        words = line(rng, rng.randint(5, 60)).split()
        for w in (["badly", "badness", "vile"] if i % 3 == 0 else ["calm"] * (i % 2)):
            words.insert(rng.randrange(len(words)), w)
        data.append((i, " ".join(words), int(i % 3 == 0)))
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "toxic"), frame.select("doc_id", "text"))
    part = {r.doc_id: r.p for r in frame.select("doc_id", F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(4)).alias("p")).collect()}
    counts = {}
    for i, text, toxic in data:
        if part[i] != 3:
            for u in {u for w in set(text.split()) for u in [w, *(w[:n] + "*" for n in (6, 5, 4) if len(w) > n)]}:
                counts.setdefault(u, [0, 0])[1 - toxic] += 1
    n_t, n_c = (sum(v[k] for u, v in counts.items() if not u.endswith("*")) for k in (0, 1))
    want = {}
    for u, (t, c) in counts.items():
        share = 1000 * (t + c) / (n_t + n_c)
        a, b = t + share, c + share
        odds = math.log(a / (n_t + 1000 - a)) - math.log(b / (n_c + 1000 - b))
        z = odds / math.sqrt(1 / a + 1 / b)
        sure = z >= 3.5 or c == 0 and t * math.log1p(n_c / n_t) >= 14
        if t >= 4 and sure and odds > 1 or z <= -3.5 and odds < 0 and not u.endswith("*"):
            want[u] = odds
    assert model.odds == pytest.approx(want) and "vile" in want and "calm" in want and want["calm"] < 0 < want["vile"]
    texts = ["vile badly akk", "calm " * 5, "badnesses aak " * 3 + "calm vile", "", None, f"vile {line(rng, 30)} vile"]
    for r in toxicity.score(docs(spark, texts), model, expected=1e9).collect():
        words = (texts[r.doc_id] or "").split()
        scores = [next((want[u] for u in [w, *(w[:n] + "*" for n in (6, 5, 4) if len(w) > n)] if u in want), model.drift) for w in words]
        found = slow_segments(scores)
        clean = math.prod(1 - math.exp(-model.scale * len(words) * math.exp(-model.rate * s)) for *_, s in found)
        assert r.score == pytest.approx(1 - clean) and r.predicted == int(r.score >= 0.3)
        assert [(p.first, p.end) for p in r.passages] == [(a, b) for a, b, _ in found]
        assert [p.expected for p in r.passages] == pytest.approx([model.chance * len(words) * math.exp(-model.rate * s) for *_, s in found])
    some = toxicity.score(docs(spark, texts), model, expected=0.0).collect()
    assert all(not r.passages for r in some)


@pytest.fixture(scope="module")
def trees():
    return html.train()


def test_html_on_generated_and_odd_pages(trees):
    rng = random.Random(77)
    want_n = got_n = both = 0
    for _ in range(120):
        page = html._Layout(rng).page()
        want = [w for _, run in html.parse(page).runs for w in run.split() if html.MARK in w]
        want = [w.replace(html.MARK, "") for w in want]
        got = html.main_text([page.replace(html.MARK, "")], trees)[0].split()
        from collections import Counter

        both += sum((Counter(want) & Counter(got)).values())
        want_n, got_n = want_n + len(want), got_n + len(got)
    assert both / want_n > 0.97 and both / got_n > 0.97
    odd = [None, "", "plain", "<", "<p", "</p></div>", "<!-- x", "<script>x", "<a<b>c", "<p>&amp;&nbsp;&#233;", "<div>" * 3000 + "deep", "<table><td>a<td>b", "<p class=>x<br/>y"]
    out = html.main_text(odd, trees)
    assert out[0] == out[1] == "" and len(out) == len(odd)
    text = lambda x: [r for _, r in html.parse(x).runs]
    assert text("<p>a<b>b</b>c<br>d &eacute;\n\n e<p>f</p>g") == ["abc", "d é e", "f", "g"]
    assert text("<p title=it's>hello</p><p title='a>b' x=\"c'>\">you") == ["hello", "you"]
    assert text("a<!-- x --!>b<!-->c<!--->d<!-- <p> -->e") == ["abcde"]
    for control in ("button", "select", "object"):
        assert text(f"<p>one</p><{control}><p>two</p><p>three")[-2:] == ["two", "three"]
    assert text("<p>a <button>b</button> c <select><option>d<option>e</select> f") == ["a", "c", "f"]
    assert text("<p>x = <math><mi>a</mi><mo>+</mo><mn>1</mn></math>, <noscript>no <b>script</b></noscript> <object>file</object>") == ["x = a+1, no script file"]
    assert text("<svg><text>in</text></svg><xmp><b>raw</b> &amp;</xmp>") == ["in", "<b>raw</b> &amp;"]
    assert text("<head><title>t</title>text<p>b") == ["text", "b"] and text("<script>a</scripty></script >b<style>x") == ["b"]
    assert text("a < b <3 </ p> <a\"b>c</a\"b>") == ["a < b <3", "c"] and text("<p a='never closed>x<p>y") == ["x", "y"]


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<a x='", '<a x="', "<div>", "</div", "<p><b>", "<li><ul>", "<", "<!", "<!--", "&#", "&amp", "<table><tr><td>", "<b></i>", "<select>", "<svg><g>", "</x y='", "<script"])
def test_html_takes_time_with_length(piece, trees):
    import time

    began = time.process_time()
    html.main_text([piece * (500_000 // len(piece))], trees)
    assert time.process_time() - began < 4


def test_html_of_an_article_with_odd_markup(trees):
    page = "<html><body><nav class=menu><a href=/a>Home</a> <a href=/b>News</a></nav><article><h1>A title of it</h1><p title=it's>{}</p><p>{}</p></article><footer>&copy; x</footer>"
    a, b = "First sentence of the story here. " * 4 + "<math><mi>E</mi></math> ends.", "Second one, <svg><text>drawn</text></svg> and more of it. " * 3
    out = html.main_text([page.format(a, b)], trees)[0]
    assert out.startswith("A title of it First sentence") and "E ends." in out and "drawn" in out and "title=" not in out and "Home" not in out


def test_html_pages(spark, trees):
    import html as lib
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html.extract(pages, trees).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        a = source[r.page_id]
        a = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", a[a.index("<article>") : a.index("</article>")])
        assert r.text == " ".join(lib.unescape(re.sub("<[^>]*>", "", a)).split()) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>hi")], "page_id long, url string, html string")
    assert html.extract(odd, trees).count() == 3 and html.extract(odd.limit(0), trees).count() == 0


# Queries and pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(5)
    passage = line(rng, 120)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = [(10_000, None), (10_001, "42 !!"), (10_002, f"{line(rng, 200)}"), (10_003, f"{passage} {line(rng, 80)}"), (10_004, f"{line(rng, 70)} {passage}"), (10_005, f"{line(rng, 90)} {bench} {line(rng, 40)}")]
    more.append((10_006, more[2][1]))
    docs_ = base.unionAll(spark.createDataFrame([(i, t, None, "s", 0) for i, t in more], base.schema)).withColumn("score", F.lit(1))
    left, seen = docs_, []
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(stage(spark, left, SF), name)
        if name != "best_fit_packing":
            assert out.columns == docs_.columns
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        left = out
    assert {10_000, 10_001} & seen[0] == set() and {10_002, 10_006} <= seen[0]
    assert 10_006 not in seen[1] and 10_002 in seen[1]
    assert 10_004 in seen[2]
    assert 10_005 in seen[2] and 10_005 not in seen[3]
    assert seen[3] == seen[4]


def test_registered_queries():
    names = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want))


def test_one_very_long_text_through_every_operator(spark, trees):
    rng = random.Random(12)
    body = line(rng, 40_000)
    long = " ".join(" ".join(rng.sample(WORDS, 300)) for _ in range(17_000)) + f" {body}"
    assert len(long) > 20_000_000
    df = docs(spark, [f"short {body[:400]}", body, long, "x"])
    path = common.public_tokenizer("word_bpe_49k.json")
    model = langid.fit_texts([line(rng, 900) for _ in range(8)] + ["der hund und"] * 8, ["en"] * 8 + ["de"] * 8)
    assert langid.identify(df, model).count() == 4 and langid.accepted(df, model).count() >= 3
    assert simhash.near_duplicates(df).count() == 4 and neardup.keep_first(df).count() == 4
    item = " ".join(long.split()[-700:-660])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(df, bench).collect()} == {1, 2}
    rows = {r.doc_id: r for r in tokenstore.round_trip(df, path, 2).collect()}
    assert rows[2].n_tokens > 5_000_000 and rows[2].start == rows[0].n_tokens + rows[1].n_tokens
    placed = packing.pack(df, common.public_tokenizer("byte_bpe_50k.json"), 2048, 0)
    assert placed.where("doc_id = 2").agg(F.sum("length")).first()[0] > 5_000_000
    cut = {r.doc_id: r for r in substring.substring_dedup(df).collect()}
    assert 39_900 <= cut[2].n_removed < 41_000 and cut[1].n_removed == len(body[:400].split())
    bad = spark.createDataFrame([(i, int(i % 2)) for i in range(4)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(bad, df)).count() == 4
    pages = spark.createDataFrame([(1, "u", f"<article><p>{long}</p></article>"), (2, "v", "<p>a")], "page_id long, url string, html string")
    assert html.extract(pages, trees).where("page_id = 1").first().n_chars == len(" ".join(long.split()))
    assert {r.payload_bytes for r in warc.archive(pages).collect()} == {len(f"<article><p>{long}</p></article>"), 4}


def test_pipeline_on_an_empty_table_and_on_repeated_rows(spark):
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = base.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF)
        assert left.count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "½ 12", None, "s", 1)], base.schema)
    few = base.orderBy("doc_id").limit(60)
    once, twice = few.unionAll(odd).withColumn("label", F.lit("x")), few.unionAll(few).unionAll(odd).unionAll(odd).withColumn("label", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        once, twice = (common.staged(stage(spark, x, SF), "stage") for x in (once, twice))
        assert once.columns == twice.columns == [*base.columns, "label"]
        assert {r.doc_id for r in once.collect()} == {r.doc_id for r in twice.collect()}, name
        if name == "simhash_near_dedup":
            assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert corpus_pipeline.best_fit_packing(spark, twice, SF).select("doc_id").distinct().count() == once.count()


def test_near_dedup_blocks_and_radius_go_by_the_size_of_sets():
    rng = np.random.default_rng(4)
    n = 60 * neardup.CELL
    bits, bands = neardup.blocks(n, 0.8)[0], [neardup.blocks(n, 0.8, least)[1] for least in neardup.TIERS]
    # Larger sets have fewer blocks, and postings grow with less than the power 1.3 of the rows.
    assert bands == sorted(bands, reverse=True) and bands[-1] < 0.8 * bands[0] == 0.8 * neardup.blocks(n, 0.8)[1]
    assert all(neardup.blocks(64 * x, 0.8, 64)[1] < 64**0.3 * neardup.blocks(x, 0.8, 64)[1] for x in (n, 64 * n))
    assert neardup.tier(np.array([0, 1, 15, 16, 63, 64, 9999])).tolist() == [0, 0, 0, 1, 1, 2, 2]
    within = neardup.radii(0.8)
    assert within[0].tolist() == [neardup.radius(64 * k, 0.8) for k in (neardup.FIRST, neardup.HEAD)] and (within[-1] < within[0]).all()
    most = max(neardup._words(bits, x) for x in bands)
    for _ in range(600):  # similarity of just 0.8; in unions of 65 and 16 or so the chance of a bit is the greatest of a tier
        k = int(rng.integers(1, 60)) if _ % 2 else int(rng.choice([3, 4, 5, 13, 14, 16]))
        union = rng.integers(0, 1 << 64, 5 * k, np.uint64)
        x = int(rng.integers(0, k + 1))
        sets = sorted((union[: 5 * k - x], union[k - x :]), key=len)
        if len(sets[0]) < 4:
            continue
        tiers = neardup.tier(np.array([len(h) for h in sets])).tolist()
        prints = [np.pad(p := neardup.fingerprint(h, neardup._words(bits, bands[t])), (0, most - len(p))) for h, t in zip(sets, tiers)]
        keys = [neardup.block_keys(p[None], bits, max(bands))[0, : bands[t]] for p, t in zip(prints, tiers)]
        assert np.isin(*keys).any()
        found = list(neardup.close_pairs(np.array([len(h) for h in sets]), np.stack(prints)[:, : neardup.HEAD], 0.8, within))
        assert sum(len(i) for i, _, _ in found) == 1
    # What is beyond its own radius is not found, though it is within that of the smallest sets.
    head = np.zeros((2, neardup.HEAD), np.uint64)
    head[1] = [(1 << 21) - 1] * neardup.HEAD  # 84 bits, 63 of them in the first words
    assert [sum(len(i) for i, _, _ in neardup.close_pairs(np.array([x, x]), head, 0.8, within)) for x in (8, 200)] == [1, 0]


def test_near_dedup_deals_out_a_class_once_and_coordinates_to_few(spark, monkeypatch):
    # Three groups of copies far from one another and their like; a cell that isn't crowded is dealt out once.
    rng = random.Random(21)
    texts = []
    for _ in range(3):
        base = line(rng, 80).split()
        texts += [" ".join([*base[:at], f"x{at}", *base[at + 1 :]]) for at in range(0, 75, 5)]
    df, rows = docs(spark, texts), []
    meeting = neardup._meeting

    def counted(classes, *a, **k):
        out = meeting(classes, *a, **k)
        rows.append((len(classes.first().place) if "place" in classes.columns and not classes.isEmpty() else 0, classes.count()))
        return out

    monkeypatch.setattr(neardup, "_meeting", counted)
    kept = sorted(r.doc_id for r in neardup.keep_first(df).collect())
    assert len(kept) == 3
    # All classes meet first, and those of pairs by their components; none of them meets another component, so no whole coordinates go to cells.
    assert rows == [(0, 45), (neardup.PARTS // neardup.FOLD, 45), (0, 0), (0, 0)]
    for k in (40, 400, 4000):  # folded coordinates only weaken the bound
        union = np.unique(np.random.default_rng(k).integers(0, 1 << 64, k, np.uint64))
        for x in (k // 10, k // 2):
            a, b = union[x:], union[: k - x]
            may = [bool(neardup.can_reach(np.array([len(a)]), np.array([len(b)]), f(neardup.coordinates(a))[None], f(neardup.coordinates(b))[None], 0.8)[0]) for f in (neardup.folded, lambda p: p)]
            assert may[0] or not may[1]
            assert may[0] or x > k // 10
