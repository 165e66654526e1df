"""Documents: line dedup, BPE, packing, near-duplicates, passages, classifiers. Brute force on small tables, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadastra.llm import byte_bpe, compression, line_dedup, minhash_dedup, packing, passage_dedup, quality, shingles, toxicity
from cadastra.runtime import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "one", "\n\n", "a b", "A  B", "x" * 300_000, "word " * 5000, "Ünïcode ẞ 漢字 🙂 \x1c\x85 end"]


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sha"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


# line dedup


def lines_by_hand(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(1)
    shared = [sentence(rng, 12) for _ in range(3)]
    texts = []
    for i in range(30):
        parts = [sentence(rng, rng.randint(1, 20)) for _ in range(4)]
        parts.insert(rng.randint(0, 4), f" {shared[i % 3].upper()}\t" if i % 2 else shared[i % 3])
        texts.append("\n".join(parts))
    texts += [*ODD, shared[0] + "\n" + shared[0], "\n".join([shared[1]] * 3)]
    docs = documents(spark, texts).withColumn("lines", F.lit(1)).withColumn("drops", F.lit(2)).withColumn("rid", F.lit("r"))
    docs = docs.unionByName(docs.where("doc_id = 3"))
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted(lines_by_hand([(r.doc_id, r.text) for r in docs.collect()]))
    assert sum(g[2] for g in got) > 0
    out = line_dedup.dedup_lines(docs)
    assert {"lines", "drops", "rid"} <= set(out.columns)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_runs_are_levelled(spark):
    store = line_dedup.LineRuns(spark)
    for b in range(7):
        store.add(spark.createDataFrame([(1, 1, b), (b, 2, b)], "h1 long, h2 long, doc_id long"))
    assert len(store.runs()) <= 4 and len(store.levels) > 1
    rows = {(r.h1, r.h2): r.last_doc for r in store.repeated(7).collect()}
    assert rows == {(1, 1): 6}
    fresh = store._union(store.runs()).where("fresh")
    assert fresh.count() == fresh.select("h1", "h2").distinct().count() == 8


# tokens


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def fuzz(rng, n):
    alphabet = "aAé ß \n\t\x1c\x85\xa0 'sdtlrev12٣½.,!?#&漢字🙂́<|>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_tiktoken(bpe, spark, sf_dir):
    import tiktoken

    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = [t or "" for t in ODD] + fuzz(random.Random(2), 1500) + ["a" * 5000, "ab" * 3000, " " * 3000]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, bpe.encode_many(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tool.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_tree_merges_one_piece_as_rows_do(bpe):
    for piece in (b" registration", b"zqxjkv", b"\xf0\x9f\x99\x82", b"x" * 100):
        assert byte_bpe.merge_piece(piece, bpe.ranks) == np.frombuffer(bpe.merge([piece])[piece], dtype="<u4").tolist()


def test_bpe_tables(spark):
    docs = documents(spark, ODD)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.decode_table(byte_bpe.encode_table(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    for row in coded.collect():
        assert bytes(row.decoded) == (row.text or "").encode()
    digests = byte_bpe.digest_table(docs, path, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.decoded_sha256 for r in digests} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(ODD)}
    assert byte_bpe.digest_table(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


# packing


def test_words_equal_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t or "" for t in ODD] + fuzz(random.Random(3), 1500) + ["It's 'S a.b... x.### C, É! \x0b", "y <|endoftext|> z"]
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for ids, right in zip(packing.WordTokenizer(path).encode_many([t.encode() for t in texts]), expected, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == right.ids


def check_packing(rows, capacity=2048):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_of_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(documents(spark, ODD, 10**6).select("doc_id", "text"))
    docs = docs.unionByName(docs.where("doc_id = 5"))
    rows = packing.pack(packing.pieces(docs, path)).collect()
    tool = Tokenizer.from_file(path)
    expected = []
    for r in docs.collect():
        ids = [*tool.encode(r.text or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[start : start + 2048], dtype="<u4")
            expected.append((r.doc_id, n, start, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    used = check_packing(rows)
    assert used <= 1.02 * sum(r.length for r in rows) / 2048 + 2
    assert packing.pack(packing.pieces(docs.limit(0), path)).count() == 0


def test_packing_over_levels_is_near_the_bound(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 1500, size=6000))], "doc_id long, length long").withColumn("extra", F.lit("x"))
    out = packing.pack(rows, shard=1000).collect()
    assert len(out) == 6000 and out[0].extra == "x"
    assert check_packing(out) <= 1.01 * sum(r.length for r in out) / 2048 + 1


def test_packing_ends_where_pieces_fill_no_sequence(spark):
    class Few(Workspace):
        def save(self, df, name):
            assert name not in ("level6", "level7"), "levels without end"
            return super().save(df, name)

    sizes = [1500] * 900 + [1100] * 200 + [548] * 100
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    out = packing.pack(rows, shard=100, workspace=Few(spark, "t")).collect()
    assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(sizes))
    # no two of the 1,100 longer pieces share a sequence, and the short ones fit beside them
    assert check_packing(out) == 1100


def test_sum_of_squares_takes_the_least():
    bins, offsets, gaps = packing.sum_of_squares(np.array([6, 4, 5, 5, 3]), 10)
    assert gaps.count(0) == 2 and (bins[0], offsets[1]) == (bins[1], 6)


# near-duplicates


def near_by_hand(rows, width, percent):
    def shingle_set(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets = [(doc, shingle_set(text)) for doc, text in rows]
    parent = {doc: doc for doc, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted((doc, len(s), root(doc), root(doc) == doc) for doc, s in sets)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = sentence(rng, rng.randint(3, 120)).split()
        for edits in (0, 0, 1, 3, 8, 15):
            words = list(base)
            for _ in range(min(edits, len(words) // 3)):
                words[rng.randrange(len(words))] = sentence(rng, 1)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    texts += ODD
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 1"))
    got = minhash_dedup.near_duplicates(docs, Workspace(spark, "t"), width=width)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in got.collect()) == near_by_hand(rows, width, 80)


def test_near_duplicates_of_nothing_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, Workspace(spark, "t")).collect()}
    assert rows == {None: (2, None, True), 1: (2, 1, True), 2: (0, 2, True)}
    assert minhash_dedup.near_duplicates(docs.limit(0), Workspace(spark, "t")).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:700], rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    hasher = shingles.HyperMinHash(2000)
    sketch = hasher.registers([a, b])
    right = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert shingles.estimate(sketch[:1], sketch[1:], np.array([900.0]), np.array([900.0]))[0] == pytest.approx(right, abs=0.04)
    apart = hasher.registers([a, np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))])
    assert shingles.estimate(apart[:1], apart[1:], np.array([900.0]), np.array([900.0]))[0] < 0.005


# passages


def test_passages_are_found_and_removed(spark):
    rng = random.Random(7)
    passage, second = sentence(rng, 60), sentence(rng, 51)
    texts = [sentence(rng, 300) for _ in range(40)]
    for i in range(10):
        words = texts[i].split()
        at = rng.randrange(len(words))
        texts[i] = " ".join([*words[:at], passage if i % 2 else passage.upper(), *words[at:]])
    for i in range(10, 14):
        texts[i] = texts[i] + "\n" + second + "\n" + sentence(rng, 20)
    short = sentence(rng, 20)
    for i in range(20, 30):
        texts[i] = texts[i] + " " + short
    texts += ODD
    docs = documents(spark, texts).withColumn("owner", F.lit(1)).withColumn("spans", F.lit(2))
    docs = docs.unionByName(docs.where("doc_id = 4"))
    workspace = Workspace(spark, "t")
    matches = passage_dedup.find_matches(docs, workspace)
    assert {r.a for r in matches.collect()} == set(range(1, 10)) | {11, 12, 13}
    assert {0, 10} <= {r.b for r in matches.collect()} and all(r.b < r.a for r in matches.collect())
    groups = passage_dedup.clustered(matches, workspace).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in groups} == {i: (0, i == 0) for i in range(10)} | {i: (10, i == 10) for i in range(10, 14)}
    out = {r.doc_id: r.text for r in passage_dedup.remove_passages(docs, matches).collect()}
    for i, text in enumerate(texts):
        if i in set(range(1, 10)) | {11, 12, 13}:
            gone = passage if i < 10 else second
            assert gone.lower() not in out[i].lower() and len(out[i].split()) == len(text.split()) - len(gone.split())
        else:
            assert out[i] == text
    empty = passage_dedup.find_matches(docs.limit(0), Workspace(spark, "t"))
    assert empty.count() == 0 and passage_dedup.remove_passages(docs, empty).count() == docs.count()


def test_passages_with_a_changed_word(spark):
    rng = random.Random(8)
    passage = sentence(rng, 120).split()
    other = list(passage)
    other[60] = "changed"
    texts = [" ".join([sentence(rng, 50), *passage, sentence(rng, 50)]), " ".join([sentence(rng, 40), *other, sentence(rng, 40)])]
    rows = passage_dedup.find_matches(documents(spark, texts), Workspace(spark, "t")).collect()
    assert [(r.a, r.b, r.a_start, r.b_start, r.words) for r in rows] == [(1, 0, 40, 50, 120)]


def test_passages_with_inserted_and_replaced_words():
    rng = random.Random(31)
    words = shingles.Words()
    for length, places, put, drop in ((90, [45], 1, 0), (90, [45], 0, 1), (90, [45], 2, 2), (150, [40, 75, 110], 1, 0)):
        passage = sentence(rng, length).split()
        other = list(passage)
        for at in reversed(places):
            other[at : at + drop] = [f"new{n}" for n in range(put)]
        a, b = (words.hashes(" ".join([sentence(rng, 30), *p, sentence(rng, 30)]).encode()) for p in (other, passage))
        assert passage_dedup.passages(a, passage_dedup.Indexed(b)) == [(30, 30, len(other))]


def test_a_shared_passage_does_not_explain_another(spark):
    rng = random.Random(37)
    noise = lambda: sentence(rng, 40)
    texts = []
    for _ in range(12):
        p, q = sentence(rng, 120), sentence(rng, 52)
        excerpt = " ".join(q.split()[1:50])  # under 50 words, no passage
        texts += [f"{noise()} {p} {noise()} {excerpt} {noise()}", f"{noise()} {p} {noise()} {q} {noise()}", f"{noise()} {q} {noise()}"]
    rows = passage_dedup.find_matches(documents(spark, texts), Workspace(spark, "t")).collect()
    found = {(r.a, r.b) for r in rows}
    assert found == {(3 * n + 1, 3 * n) for n in range(12)} | {(3 * n + 2, 3 * n + 1) for n in range(12)}


def test_paragraph_bands_are_likely_to_meet():
    rng = random.Random(9)
    met = 0
    for _ in range(200):
        words = shingles.Words()
        passage = sentence(rng, 51)
        a, b = (passage_dedup.band_keys(words.hashes(f"{sentence(rng, 80)} {passage} {sentence(rng, 80)}".encode())) for _ in range(2))
        met += len(np.intersect1d(a, b)) > 0
    assert met >= 196


# classifiers


def test_classifiers_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for query, label in ((quality.op4_quality, "quality"), (toxicity.op9_toxicity, "toxic")):
        scored = query(spark, "/root/testdata/sf0.01")
        assert scored.count() == docs.count()
        rows = scored.where("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("truth"), "score").collect()
        assert np.mean([r.predicted == r.truth for r in rows]) >= 0.9
        assert all(0 <= r.score <= 1 for r in rows)


def test_classifiers_without_labels_and_odd_texts(spark):
    docs = documents(spark, ODD).withColumn("score", F.lit(9))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.5}
    texts = {1: [b"idiot scum fool " + bytes([97 + i % 26]) * 9 for i in range(40)], 0: [b"calm plain words " + bytes([97 + i % 26]) * 9 for i in range(40)]}
    fitted = toxicity.ToxicityModel.fit(texts)
    rows = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, fitted).collect()}
    assert rows[0] == rows[1] and all(0 <= s <= 1 for s in rows.values())
    good = quality.QualityModel.fit({1: [b"fine text %d" % i for i in range(30)], 0: [b"### %%%% %d" % i for i in range(30)]})
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, good).collect())
    assert quality.score_quality(docs.limit(0), good).count() == 0


def test_windows_cover_the_text():
    for text in (b"", b"a", b"a b  c " * 50, b"x" * 1000):
        joined = b" ".join(compression.windows(text, 40))
        assert joined.replace(b" ", b"") == text.replace(b" ", b"")


def test_packing_encodes_whole_texts_where_a_vocabulary_needs_it(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"A": 1, "a": 2, "?": 0}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    own.save(str(tmp_path / "own.json"))
    tool = packing.WordTokenizer(str(tmp_path / "own.json"))
    assert not tool.by_chunks and np.frombuffer(tool.encode_many([b"A a b"])[0], dtype="<u4").tolist() == [1, 2, 0]
    assert packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).by_chunks


def test_packing_keeps_columns_of_any_name(spark):
    rows = spark.range(40).selectExpr("id AS doc_id", "0 AS piece", "id * 7 % 50 + 1 AS length", "id AS ids_crc32", "'s' AS shard", "'l' AS left_over", "'_s' AS _shard", "9 AS sequence_id", "9 AS offset")
    out = packing.pack(rows, capacity=64, shard=10)
    assert sorted(out.columns) == sorted(rows.columns) and {(r.shard, r.left_over, r._shard) for r in out.collect()} == {("s", "l", "_s")} and out.count() == 40


def test_packing_ends_where_no_sequence_fills(spark):
    rows = spark.createDataFrame([(i, 0, 0, 1500, i) for i in range(200)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(rows, shard=50)
    assert packed.count() == 200 and packed.select("sequence_id").distinct().count() == 200


def test_passages_with_each_kind_of_edit(spark):
    rng = random.Random(41)
    texts, pairs = [], 0
    for words in (55, 60, 80, 95):
        for put, drop in ((["new"], 1), (["new"], 0), ([], 1)):
            for _ in range(8):
                passage = sentence(rng, words).split()
                edited = [*passage[: words // 2], *put, *passage[words // 2 + drop :]]
                texts += [" ".join([sentence(rng, 40), *p, sentence(rng, 40)]) for p in (passage, edited)]
                pairs += 1
    rows = passage_dedup.find_matches(documents(spark, texts), Workspace(spark, "t")).collect()
    assert all(r.a == r.b + 1 and r.b % 2 == 0 for r in rows)
    assert len({r.a for r in rows}) >= 0.9 * pairs


def test_passages_behind_a_line_that_many_hold(spark):
    rng = random.Random(43)
    line = sentence(rng, 14)
    texts = [f"{sentence(rng, 60)} {line} {sentence(rng, 60)}" for _ in range(60)]
    # the last two share 55 words around the line; 60 smaller ids hold the line alone
    before, after = sentence(rng, 20), sentence(rng, 21)
    texts += [f"{sentence(rng, 60)} {before} {line} {after} {sentence(rng, 60)}" for _ in range(2)]
    rows = passage_dedup.find_matches(documents(spark, texts), Workspace(spark, "t")).collect()
    assert {(r.a, r.b) for r in rows} == {(61, 60)}


def test_leader_that_holds_a_key_twice_has_its_least_place(spark):
    for places in ([70, 5], [5, 70]):
        rows = [(1, 0, p, 8) for p in places] + [(1, 3, 9, 8)]
        led = passage_dedup._led(spark.createDataFrame(rows, "key long, doc_id long, place long, words int"), Workspace(spark, "t"), "led")
        assert {(r.a, r.place, r.b, r.b_place) for r in led.collect()} == {(0, 70, None, None), (3, 9, 0, 5)}


def test_line_runs_are_not_shuffled_again(spark):
    store = line_dedup.LineRuns(spark, Workspace(spark, "t"))
    keys = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("doc_id"))
    store.add(keys(0, 100))
    store.add(keys(50, 150))
    rows = {(r.h2, r.n_docs, r.fresh) for name in store.runs() for r in store.workspace.table(name).collect()}
    assert len(rows) == 200 and sum(not f for _, _, f in rows) == 50
    known = store._union(store.runs()).where("fresh")
    text = store.workspace.table(store.runs()[0]).join(known.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in text and "Exchange" not in text.split("== Physical Plan ==")[1]
    assert {r.h2 for r in store.repeated(2).collect()} == set(range(50, 100))


def test_leaders_of_buckets_that_many_ranges_share(spark):
    """Every row is held against its bucket's least document at its least place, and no join stands between."""
    rng = np.random.default_rng(3)
    n = 6000
    keys = np.where(rng.random(n) < 0.6, rng.choice([7, 40], n), rng.integers(0, 1200, n))
    rows = sorted({(int(k), int(d), int(p)) for k, d, p in zip(keys, rng.integers(0, 900, n), rng.integers(0, 5, n), strict=True)})
    frame = spark.createDataFrame([(k, d, p, 9) for k, d, p in rows], "key long, doc_id long, place long, words int")
    led = passage_dedup._led(frame.repartition(7), Workspace(spark, "led"), "led")
    found = led.collect()
    assert "Join" not in led._jdf.queryExecution().executedPlan().toString()
    firsts, several = {}, {}
    for k, d, p in rows:
        firsts.setdefault(k, (d, p))
        several.setdefault(k, set()).add(d)
    others = [(k, d, p) for k, d, p in rows if len(several[k]) > 1 and (d, p) != firsts[k]]
    plain = [(d, p, k, 9, *(firsts[k] if d != firsts[k][0] else (None, None))) for k, d, p in others]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain))


def test_a_level_moves_its_rows_twice_and_runs_python_four_times(spark):
    """On many partitions a level costs its stages: buckets are led, jobs cut their own words, leaders' words are cut, both are compared."""
    rng = random.Random(47)
    line = sentence(rng, 14)
    texts = [f"{sentence(rng, 60)} {line} {sentence(rng, 60)}" for _ in range(6)]
    plans = {}

    class Noted(Workspace):
        def save(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().save(df, name)

    passage_dedup.find_matches(documents(spark, texts), Noted(spark, "t")).collect()
    count = lambda what, *names: sum(len(re.findall(rf"\b{what}\b", plans[n].split("Subquery")[0])) for n in names)
    for level in ("0", "1"):
        assert count("Exchange", f"led{level}") == 1
        assert count("MapInArrow", f"led{level}", f"jobs{level}", f"found{level}") == 4


def test_rows_that_come_twice_are_led_once():
    rows = [(1, 0, 5, 8), (1, 0, 5, 8), (1, 3, 9, 8), (1, 3, 9, 8), (1, 4, 2, 8), (2, 7, 1, 8), (2, 7, 1, 8)]
    for size in (1, 2, 3, 7):
        leaders, outs = passage_dedup._Leaders(), []
        for at in range(0, len(rows), size):
            key, doc, place, words = (pa.array(c) for c in zip(*[(0, 1, 1, 8)] * (at == 0) + rows[at : at + size], strict=True))
            outs += leaders.add(pa.RecordBatch.from_arrays([doc, key, place, words.cast(pa.int32())], names=["doc_id", "key", "place", "words"]))
        got = [(r["a"], r["place"], r["key"], r["b"], r["b_place"]) for out in outs for r in out.to_pylist() if not r["open"]]
        assert sorted(got) == [(3, 9, 1, 0, 5), (4, 2, 1, 0, 5)]


def test_components_of_passages_that_overlap_and_of_documents_on_both_sides(spark):
    rows = [(2, 1, 10, 0, 60, 60), (2, 1, 10, 0, 60, 60), (3, 1, 0, 0, 60, 60), (3, 2, 40, 50, 70, 70), (9, 8, 5, 5, 50, 51), (9, 8, 200, 300, 55, 55)]
    matches = spark.createDataFrame(rows, "a long, b long, a_start long, b_start long, words long, b_words long")
    got = {(r.doc_id, r.start, r.words, r.kept, r.component_id) for r in passage_dedup.clustered(matches, Workspace(spark, "t")).collect()}
    assert got == {(1, 0, 60, True, 1), (2, 10, 110, False, 1), (3, 0, 110, False, 1), (8, 5, 51, True, 8), (9, 5, 50, False, 8), (8, 300, 55, True, 8), (9, 200, 55, False, 8)}


def test_stretches_are_compared_in_groups_as_one_by_one(monkeypatch):
    """Passages and the next round's rows as from row after row, with a few calls for all windows of a group."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(rng.randint(4, 90))] for _ in range(12)]
    rows = []
    for i in range(300):
        mine, theirs = ([word() for _ in range(rng.randint(0, 40))] + rng.choice(shared) + [word() for _ in range(rng.randint(0, 30))] for _ in range(2))
        places = [{"key": rng.randrange(5), "at": 64 + rng.randrange(len(mine)), "words": rng.randint(1, 64)} for _ in range(rng.randint(1, 5))]
        places = [p | {"words": min(p["words"], 64 + len(mine) - p["at"])} for p in places]
        rows.append({"a": 1000 + i, "a_part": i % 3, "a_lo": 64, "b": None if i % 7 == 0 else i, "b_lo": None if i % 7 == 0 else 32, "places": places, "mine": " ".join(mine).encode(), "theirs": None if i % 7 == 0 else " ".join(theirs).encode()})
    place = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("words", pa.int32())])
    types = {"a": pa.int64(), "a_part": pa.int64(), "a_lo": pa.int32(), "b": pa.int64(), "b_lo": pa.int32(), "places": pa.list_(place), "mine": pa.binary(), "theirs": pa.binary()}
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema(types.items()))

    class Frame:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    calls = []
    windows = passage_dedup.windows
    for level, onward in ((passage_dedup.PARAGRAPH, passage_dedup.CONTEXT), (passage_dedup.CONTEXT, passage_dedup.CONTEXT), (passage_dedup.CONTEXT, passage_dedup.VERBATIM), (passage_dedup.VERBATIM, None)):
        monkeypatch.setattr(passage_dedup, "windows", lambda *x: calls.append(1) or windows(*x))
        found = [r for out in passage_dedup._compared(Frame(), level, onward, 50, 80)(iter([batch.slice(0, 130), batch.slice(130)])) for r in out.to_pylist()]
        assert len(calls) < 60
        calls.clear()
        monkeypatch.setattr(passage_dedup, "windows", windows)
        names, passages, onwards = {}, [], []
        for r in rows:
            words = shingles.WORDS.hashes(r["mine"])
            spans = [] if r["theirs"] is None else passage_dedup.aligned(words, passage_dedup.Indexed(shingles.WORDS.hashes(r["theirs"])))
            passages += [(r["a"], r["a_part"], r["b"], 64 + i, 32 + j, m, n) for i, j, m, n in spans]
            rest = [(p["key"], p["at"] - 64, p["words"]) for p in r["places"] if not any(64 + i <= p["at"] and p["at"] + p["words"] <= 64 + i + m for i, _, m, _ in spans)]
            if onward == passage_dedup.VERBATIM:
                starts = {s for _, at, n in rest for s in range(len(words) - 49) if (s <= at and at + n <= s + 50) or (at <= s and s + 50 <= at + n)}
                onwards += [(r["a"], s, 50, tuple(words[s : s + 50].tolist())) for s in starts]
            elif onward == level:
                onwards += [(r["a"], at, n, key) for key, at, n in rest]
            elif onward is not None:
                sides = [(key, at, n, side, words[b : b + 10].tolist()) for key, at, n in rest for side, b in ((1, at - 10), (2, at + n)) if b >= 0]
                onwards += [(r["a"], at, n, (key, side, *context)) for key, at, n, side, context in sides if len(context) == 10]
        assert sorted(passages) == sorted(tuple(r[c] for c in ("a", "part", "b", "a_start", "b_start", "words", "b_words")) for r in found if r["key"] is None)
        got = [(r["a"], r["place"] % passage_dedup.PLACE - 64, r["words"], r["key"], r["place"] // passage_dedup.PLACE) for r in found if r["key"] is not None]
        assert sorted(x[:3] for x in onwards) == sorted(x[:3] for x in got) and all(x[4] == (x[0] - 1000) % 3 for x in got)
        # the same key for the same bucket, and for no other
        named = {}
        for x in got:
            named.setdefault(x[:3], set()).add(x[3])
        for x in onwards:
            names.setdefault(x[:3], set()).add(x[3])
        keys = {tuple(sorted(map(str, v))): tuple(sorted(named[k])) for k, v in names.items()}
        assert len(keys) == len(set(keys.values())) and all(keys[tuple(sorted(map(str, v)))] == tuple(sorted(named[k])) for k, v in names.items())
    assert passages and len(onwards) == 0
