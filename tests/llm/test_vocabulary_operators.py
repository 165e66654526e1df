"""Collocations, spelling variants and SentencePiece pieces: brute force on small tables, the library, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadastra.llm import collocations, piece_bpe, spelling
from cadastra.runtime import Workspace

DOCS = "doc_id long, text string, lang string"
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# collocations


def phrases_by_hand(rows, least=10, cover=50, top=2000, depth=3):
    counts = {}
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, depth + 1):
                counts.setdefault("und" if lang is None else lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found, rows = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in found.items():
            if any(100 * b >= cover * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i, *r[1:]) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def sentences(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(n))


WORDS = ["ka", "Lo", "mi", "tu", "re", "É", "ka\x00", "\x01", "\x01\x02x", "z\x1cz", "é", "K"]


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_collocations(spark, depth):
    rng = random.Random(5)
    rows = [(i, sentences(rng, WORDS[: rng.randint(2, 12)], rng.randint(0, 90)), rng.choice(["en", "fr", None, "und", "a\x00b", ""])) for i in range(120)]
    rows += [(None, None, "en"), (1, "", None), (2, " \t ", "en"), (2, "..", "en"), *[(7, "ka Lo mi " * 200, "de")] * 3, (8, "x" * 200_000 + " end", "de")]
    docs = table(spark, rows).withColumns({c: F.lit("clash") for c in ("path", "n", "rank", "phrase", "a", "score", "lefts")})
    for top in (2000, 3):
        got = [tuple(r) for r in collocations.collocations(docs.repartition(5), top=top, depth=depth).collect()]
        assert sorted(got) == phrases_by_hand(rows, top=top, depth=depth)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_shards_of_any_size_give_the_same_counts(spark, monkeypatch):
    rng = random.Random(6)
    texts = [(sentences(rng, WORDS, rng.randint(0, 80)).encode(), rng.choice([b"en", b"fr"])) for _ in range(30)]
    batch = pa.record_batch([pa.array([t for t, _ in texts]), pa.array([lang for _, lang in texts])], names=["text", "lang"])

    def counted(depth):
        total = Counter()
        for shard_lang in (b"en", b"fr"):
            shard = collocations.Shard(shard_lang, depth, None)
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if lang == shard_lang:
                    for out in shard.add(text):
                        total.update(dict(zip(out.column("path").to_pylist(), out.column("n").to_pylist(), strict=True)))
            for out in shard.flush():
                total.update(dict(zip(out.column("path").to_pylist(), out.column("n").to_pylist(), strict=True)))
        return total

    whole = {d: counted(d) for d in (1, 2, 3)}
    monkeypatch.setattr(collocations, "SHARD_WORDS", 7)
    monkeypatch.setattr(collocations, "BLOCK", 16)
    assert {d: counted(d) for d in (1, 2, 3)} == whole


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, sentences(rng, WORDS, 60), "en") for i in range(60)]
    monkeypatch.setattr(collocations, "MOST_BLOCKS", 1)
    assert sorted(tuple(r) for r in collocations.collocations(table(spark, rows)).collect()) == phrases_by_hand(rows)


def test_ancestors_that_end_the_range_before(spark):
    """Ranges of few rows: nodes stand apart from their ancestors."""
    rng = random.Random(8)
    rows = [(i, sentences(rng, WORDS[:6], 80), "en") for i in range(60)]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert sorted(tuple(r) for r in collocations.collocations(table(spark, rows)).collect()) == phrases_by_hand(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scores_are_exact_beyond_64_bits(spark):
    frame = spark.createDataFrame([(10**13 + 7, 10**13 + 9, 10**13 + 11)], "n long, l long, r long")
    got = frame.select(F.expr("cast(1000000 as decimal(7, 0)) * cast(n as decimal(15, 0)) * cast(n as decimal(15, 0)) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")).first()[0]
    assert got == 10**6 * (10**13 + 7) ** 2 // ((10**13 + 9) * (10**13 + 11))


# spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms_by_hand(rows):
    count = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def made_up_words(rng, n):
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(n)]
    return base + [w[:i] + rng.choice(["", "a", "b", "ÿ"]) + w[i + rng.randint(0, 1) :] for w in base for i in [rng.randint(0, len(w))]]


def test_spelling_forms(spark):
    rng = random.Random(3)
    words = made_up_words(rng, 40)
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.4 else words[rng.randint(0, 4)] for _ in range(rng.randint(0, 120))), None) for i in range(150)]
    chain = ["abcdefgh"] * 2 + ["abcdefghi"] * 30 + ["abcdefghij"] * 400 + ["xabcdefghij"] * 5000
    rows += [(200, "\n".join(chain), "en"), (None, None, None), (201, "", "en"), (202, "ABCDEFGÀ abcdefgà×÷ 1234567", "en"), (203, "x" * 300_000 + " " + "x" * 300_000, "en")]
    docs = table(spark, rows + rows[:3]).withColumns({c: F.lit("clash") for c in ("word", "part", "window", "n", "h", "run", "id")})
    expected = forms_by_hand(rows + rows[:3])
    assert sum(r[1] is not None for r in expected) > 10
    assert sorted(tuple(r) for r in spelling.spelling_forms(docs).collect()) == expected
    # partitions of any size
    assert sorted(tuple(r) for r in spelling.spelling_forms(docs, large=60).collect()) == expected
    assert spelling.spelling_forms(docs.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("aéb", max_size=5)), max_size=40, unique=True))
def test_tries_find_each_near_pair_once(rows):
    rows = sorted(rows)
    got = [tuple(sorted(p)) for p in spelling.near_in_tries(np.array([k for k, _ in rows], dtype=np.int64), [w for _, w in rows]).tolist()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0] and near(rows[i][1], rows[j][1])}


def test_a_hot_partition_is_parted(spark):
    """All words begin and end alike: parts stay small, and no pair is lost."""
    rng = random.Random(4)
    words = sorted({"pre" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) + "end" for _ in range(600)})
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    workspace = Workspace(spark, "test")
    parts = spelling.partitions(frame, workspace, 300)
    sizes = parts.groupBy("part").agg(F.sum(F.char_length("window")).alias("chars"), F.count(F.lit(1)).alias("rows"), F.max(F.char_length("window")).alias("longest"))
    assert sizes.where("chars > 300 AND longest > 2 AND rows > 1").isEmpty()
    got = {(r.word, r.near) for r in spelling.near_words(frame, workspace, 300).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


# pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = [None, "", " ", "  a  b ", "▁▁x ▁", "a\nb\r\n\tc", "x" * 200_000, " " * 5000, "Ünïcode ẞ 漢字 🙂 \x00\x1c\x85 end", "<s> </s> <0x0A> <unk>", "'\"don't\", (a.b)!", "　ﬁ½"]


def test_pieces_are_the_library_s(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(list(enumerate(ODD, 10**6)), "doc_id long, text string")
    docs = docs.unionByName(odd).unionByName(odd.limit(3)).withColumn("ids", F.lit("clash"))
    expected = []
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_bos=True, add_eos=True)
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in piece_bpe.digest_table(docs, MODEL).collect()) == sorted(expected)
    coded = piece_bpe.decode_table(piece_bpe.encode_table(odd.withColumn("extra", F.lit(1)), MODEL), MODEL).collect()
    assert all(r.decoded == LIBRARY.decode(np.frombuffer(r.ids, dtype="<u4").tolist()) and r.extra == 1 for r in coded)
    assert piece_bpe.digest_table(docs.limit(0), MODEL).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab the▁ \n.é漢,'0", max_size=80)))
def test_any_text_is_encoded_as_the_library_does(text):
    tool = piece_bpe.pieces(MODEL)
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(tool.encode(text), dtype="<u4").tolist() == ids
    assert tool.decode(tool.encode(text)) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.sampled_from([28705, 259, 260]), st.integers(0, 31_999)), max_size=12))
def test_any_ids_are_decoded_as_the_library_does(ids):
    assert piece_bpe.pieces(MODEL).decode(np.array(ids, dtype="<u4").tobytes()) == LIBRARY.decode(ids)


def test_other_vocabularies_are_refused(tmp_path):
    (tmp_path / "other.model").write_bytes(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="merge-type"):
        piece_bpe.Pieces(str(tmp_path / "other.model"))
