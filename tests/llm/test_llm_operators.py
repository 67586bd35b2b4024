"""The operators of srcloom.llm against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcloom.llm import chat, licenses, line_dedup, nearest, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, skew, toxicity
from srcloom.llm.queries import op8_license_scans, tokenizer_file
from srcloom.sources.tables import table

DOCS = "doc_id long, text string, score string, n_words string, n_lines string, start string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, "x", None, None, "y"),
    (2, "", None, "a", "b", None),
    (3, "  \t\n ", None, None, None, None),
    (4, LONG, None, None, None, None),
    (5, "one two three", None, None, None, None),
    (5, "one two three", None, None, None, None),
    (6, "Déjà vu\x00 \x1c 漢字 😀 é", None, None, None, None),
    (None, "no id here at all", None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, folder):
    return table(spark, folder, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


# SentencePiece


def best_score(v, text):
    """Highest total score by plain dynamic programming over all pieces."""
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - v.longest), j):
            piece = text[i:j]
            if piece in v.ids:
                best[j] = max(best[j], best[i] + v.scores[v.ids[piece]])
        if text[j - 1] not in v.ids:
            best[j] = max(best[j], best[j - 1] + v.worst)
    return best[-1]


def test_sentencepiece_is_the_best_segmentation(texts):
    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    v = codec.vocabulary
    for text in [t[:400] for t in list(texts.values())[:40]] + ["a  b   c", " lead", "trail ", "漢字 😀"]:
        if not text:
            continue
        ids = np.frombuffer(codec.encode(text), dtype="<u4").tolist()
        unknown = sum(1 for c in " " + text if c not in v.ids)
        score = sum(v.scores[i] for i in ids if i not in v.byte_ids.values()) + unknown * v.worst
        assert math.isclose(score, best_score(v, " " + text), rel_tol=1e-12)
        assert codec.decode(codec.encode(text)) == text


def test_sentencepiece_streams_in_a_small_window(texts):
    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    stream = sentencepiece_codec.StreamingViterbi(codec.vocabulary)
    text = max(texts.values(), key=len)
    marked = " " + text
    ids = [i for k in range(0, len(marked), 7) for i in stream.feed(marked[k : k + 7])] + stream.flush()
    assert ids == np.frombuffer(codec.encode(text), dtype="<u4").tolist()
    assert stream.most_held <= 4 * codec.vocabulary.longest
    assert stream.commits > len(text) / 100


def test_sentencepiece_commits_within_long_stretches():
    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    ids = np.frombuffer(codec.encode(word), dtype="<u4").tolist()
    v = codec.vocabulary
    assert codec.stream.commits > 500 and codec.stream.most_held <= 4 * v.longest
    assert math.isclose(sum(v.scores[i] for i in ids), best_score(v, " " + word), rel_tol=1e-9) and codec.decode(codec.encode(word)) == word


def test_sentencepiece_keeps_the_mark_of_the_vocabulary():
    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    for text in ("a▁b", "▁", " ▁ ▁▁x", "▁the ▁the", "x" * 70_000 + " ▁" + "y z" * 30_000):
        assert codec.decode(codec.encode(text)) == text


def test_sentencepiece_cache_is_bounded_and_dropped():
    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"), most_bytes=30_000)
    whole = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    for k in range(0, 3000, 20):
        text = " ".join(f"word{i}" for i in range(k, k + 20))
        assert codec.encode(text) == whole.encode(text) and codec.kept <= 30_000 + 60 * 400
    codec.forget()
    assert not codec and codec.kept == 0


def test_sentencepiece_matches_the_library_on_words():
    import sentencepiece

    raw = open(tokenizer_file("piece_bpe_32k.model"), "rb").read()
    kind = b"\x18%c\x20\x80\xfa\x01"  # model_type, then vocab_size 32000
    assert raw.count(kind % 2) == 1
    library = sentencepiece.SentencePieceProcessor(model_proto=raw.replace(kind % 2, kind % 1))
    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    for word in "the thing another reading words sentence pieces Bonjour straßenbahn".split():
        assert np.frombuffer(codec.encode(word), dtype="<u4").tolist() == library.nbest_encode_as_ids(word, 3)[0]


def test_sentencepiece_rows(spark, odd, empty):
    model = tokenizer_file("piece_bpe_32k.model")
    got = sentencepiece_codec.report(odd, model).collect()
    assert len(got) == len(ODD) and all(r.round_trip for r in got)
    back = sentencepiece_codec.decoded(sentencepiece_codec.encoded(odd, model), model)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in ODD)
    assert sentencepiece_codec.report(empty, model).count() == 0


# Nearest neighbours


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:160] = x[99]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, [None] * 16), (1100, [float("inf")] + [1.0] * 15), (1150, []), (1200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in nearest.nearest(df, queries_each=50, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wide = x.astype(np.float64)
    for q in range(0, 400, 50):
        scores = nearest.cosine(np.repeat(x[q : q + 1], 400, axis=0), x)
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert [i for i, _ in got[q]] == order
        assert np.allclose([s for _, s in got[q]], [wide[q] @ wide[i] / np.linalg.norm(wide[q]) / np.linalg.norm(wide[i]) for i in order])
    assert set(got) == set(range(0, 400, 50))
    assert nearest.nearest(df.limit(0)).count() == 0


def test_nearest_keeps_doubles(spark):
    far, close = [1.0, 1.0 + 2e-9], [1.0, 1.0 + 1e-9]  # equal as floats
    rows = [(0, [1.0, 1.0]), (1, far), (2, close), (3, [1e300, 1.00001e300]), (4, [1e-300, -1e-300])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4] and [round(r.score, 9) for r in got] == [1.0, 1.0, 1.0, 0.0]
    turned = [(0, [1.0, 0.0]), (1, [1.0, 2e-5]), (2, [1.0, 1e-5]), (3, [1.0, 1e-5 + 1e-12])]
    doubles = nearest.nearest(spark.createDataFrame(turned, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in doubles] == [2, 3, 1]
    whole = nearest.nearest(spark.createDataFrame([(0, [3, 4]), (1, [6, 8]), (2, [16777217, 1])], "vec_id long, embedding array<int>")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 9)) for r in whole] == [(1, 1.0), (2, round((3 * 16777217 + 4) / 5 / (16777217**2 + 1) ** 0.5, 9))]


def test_nearest_with_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest.nearest(df).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 50), (0, 2, 1), (0, 3, 50)]


# Chat


def test_chat_folds_events(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 0, "message", "assistant", ""),
        (1, 1, 1, "delta", None, "wrong"),
        (1, 1, 2, "regenerate", None, None),
        (1, 1, 3, "delta", None, "hel"),
        (1, 1, 4, "delta", None, "lo"),
        (1, 0, 9, "edit", None, "hey <|im_end|>"),
        (2, 0, 0, None, None, None),
    ]
    df = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string")
    rows = chat.formatted(df).orderBy("conv_id", "part").collect()
    assert [r.formatted for r in rows] == ["<|im_start|>user\nhey <\\|im_end|><|im_end|>\n", "<|im_start|>assistant\nhello<|im_end|>\n", "<|im_start|>\n<|im_end|>\n"]
    assert [r.loss for r in rows] == [False, True, False]


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|im_end|>", "a<\\\\/s>b</s>[INST][\\INST]", "<<s>", "plain", ""])
def test_chat_escapes_reversibly(spark, text):
    escaped = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t"))).first()[0]
    assert chat.unescaped(escaped) == text and not any(c in escaped for c in chat.CONTROL)


def test_chat_digest(spark):
    rows = [(None, 0, "user", "a"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (3, 0, "user", None), (4, 0, "assistant", "é" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.events_of_messages(chat.with_probe(spark, df))).collect()}
    assert set(got) == {None, 3, 4, -7}
    assert got[3].n_turns == 3 and got[3].loss_chars == 2 and got[3].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nx\nassistant\nx\n").hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert got[4].loss_chars == 100_000


def test_chat_ties_sort_by_the_text_itself(spark):
    rows = [(1, 0, "assistant", t) for t in ("<\\x", "</s>", "<.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.events_of_messages(df)).first().loss_sha256 == hashlib.sha256(b"<.</s><\\x").hexdigest()


def test_chat_on_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.events_of_messages(df)).count() == 0


# Packing


def test_packing_places_all_ids(documents, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = packing.pack(documents, tokenizer_file("word_bpe_49k.json"), length=256).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert [(r.start, r.length, r.ids_crc32) for r in by_doc[doc]] == [(k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], dtype="<u4").tobytes())) for k in range(0, len(ids), 256)]
    full = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert full.get(r.sequence_id, 0) == r.offset
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 256
    assert len(full) <= math.ceil(sum(full.values()) / 256) * 1.02 + 1


def test_packing_chunks_like_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer, cached = Tokenizer.from_file(path), packing.ChunkIds(path)
    cases = ["It's 5 o'clock, HE'LL say... \"no!!\"", "<|endoftext|>a <|ENDOFTEXT|>", "Straße ÉCOLE École é ﬁ ÷ ×", "a\x1cb\x85c d", "x" * 300, "***bold*** $$$ wh,?!", "Σας ΣΑΣ İi", "漢字 😀🏽 ١٢"]
    for text in cases:
        assert np.frombuffer(cached.encode(text.encode()), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_bounded_bins():
    bins = packing.OpenSequences(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 5, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    bins = packing.OpenSequences(10, 1)
    assert [bins.place(n) for n in (6, 7, 4)] == [(0, 0), (1, 0), (2, 0)]  # the fullest closed


def test_packing_closes_the_fullest_and_stays_full(documents):
    sizes = [r.length for r in packing.tokenised(documents, tokenizer_file("word_bpe_49k.json"), with_ids=False).orderBy("doc_id", "piece").collect()]
    bins, place, full = packing.OpenSequences(4096, 16), [], {}
    for size in sizes:
        place.append(bins.place(size))
    for (sequence, offset), size in zip(place, sizes, strict=True):
        assert full.get(sequence, 0) == offset
        full[sequence] = offset + size
    assert bins.closed > 0 and max(full.values()) <= 4096
    assert len(full) <= math.ceil(sum(sizes) / 4096) * 1.03 + 1


def test_packing_encodes_whole_texts_for_other_tokenizers(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    assert packing.encoded_by_chunks(tokenizer_file("word_bpe_49k.json")) and not packing.encoded_by_chunks(path)
    rows = packing.tokenised(spark.createDataFrame([(1, "The cat  sat\n")], "doc_id long, text string"), path).collect()
    assert np.frombuffer(rows[0].ids, dtype="<u4").tolist() == Tokenizer.from_file(path).encode("The cat  sat\n", add_special_tokens=False).ids + [1]


def test_packing_cache_is_bounded_and_dropped():
    cached = packing.ChunkIds(tokenizer_file("word_bpe_49k.json"), most_bytes=20_000)
    for k in range(0, 5000, 20):
        cached.encode(" ".join(f"word{i}" for i in range(k, k + 20)).encode())
        assert cached.held <= 20_000 + 40 * 300
    cached.forget()
    assert not cached and cached.held == 0


def test_packing_rows(spark, odd, empty):
    rows = packing.pack(odd, tokenizer_file("word_bpe_49k.json")).collect()
    assert sum(r.doc_id == 1 and r.length == 1 for r in rows) == 1 and sum(r.doc_id == 5 for r in rows) == 2
    assert packing.pack(empty, tokenizer_file("word_bpe_49k.json")).count() == 0


# N-gram join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choices(words, k=rng.choice([3, 5, 12, 60, 200])) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w) if rng.random() < 0.5 else "  ".join(w).upper()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_is_brute_force(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_ngram_join_with_hot_elements_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_IN_BLOCK", 3)
    monkeypatch.setattr(ngram_join, "GROUP_ELEMENTS", 200)
    rows = near_copies(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()} == brute_components(rows)


def test_ngram_join_deals_hot_postings_of_like_blocks(spark):
    passage = "a passage that many documents share"
    rows = [(k, passage + f" {k % 40}") for k in range(320)]  # 8 blocks with the same texts, the same one first
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    direct = ngram_join._postings(df, 5, 1000).filter("salt IS NOT NULL").select("bucket").collect()
    assert len(direct) == 8 and len({r.bucket for r in direct}) > 4


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(40, size=rng.integers(1, 40))) for _ in range(80)]
    sizes = np.array([len(s) for s in sets])
    places = np.arange(80)
    left, right = ngram_join.PrefixTree(sets, sizes, 75).join(sets, sizes, places, places)
    want = {(i, j) for i in range(80) for j in range(80) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want


def test_prefix_tree_starts_from_matching_prefixes_in_a_bounded_frontier(monkeypatch):
    sets = [np.array([k, 20_000]) for k in range(20_000)]  # all share one element, which is last in the order
    sizes = np.full(20_000, 2)
    tree = ngram_join.PrefixTree(sets, sizes, 75)
    assert len(tree._starts(sets[:64], sizes[:64])[0]) == 64
    monkeypatch.setattr(ngram_join.PrefixTree, "FRONTIER", 50)
    rng = np.random.default_rng(9)
    sets = [np.unique(np.concatenate((np.arange(30), rng.choice(np.arange(30, 60), 6)))) for _ in range(150)]
    sizes = np.array([len(s) for s in sets])
    tree = ngram_join.PrefixTree(sets, sizes, 75)
    assert len(tree.parent) < 0.5 * sum(map(len, sets)) / tree.STEP * 10 and len(tree.by_level[0]) == 1
    left, right = tree.join(sets, sizes, np.arange(150), np.arange(150))
    want = {(i, j) for i in range(150) for j in range(150) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want


def test_ngram_join_keeps_one_row_a_class_however_many_copies(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, passage if k % 2 else passage + f" q{k % 80}") for k in range(1600)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    merged = ngram_join._postings(df, 5, 12).repartition(12, "bucket").groupBy("bucket").applyInArrow(ngram_join._shared_in_bucket(12), ngram_join._SHARED)
    held = Counter(fp for r in merged.filter("salt IS NOT NULL").collect() for fp in np.frombuffer(r.fps, dtype=np.int64).tolist())
    assert held and max(held.values()) <= 8  # blocks, not copies
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()}
    assert set(got.values()) == {0}


def test_ngram_join_deals_a_giant_group_by_prefix_and_length(spark):
    # a chain: neighbours share half of their words, so prefixes meet all along it, but nothing links
    words = [f"w{i}" for i in range(4000)]
    chain = [(k, " ".join(words[k * 20 : k * 20 + 40])) for k in range(190)]
    near = [(1000 + k, " ".join(words[:39] + [f"x{k}"])) for k in range(20)]
    rows = chain + near
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = spark.createDataFrame(
        [(k, 36, np.array([(1, e) for e in range(k * 20, k * 20 + 36)], dtype=ngram_join._RANKED).tobytes(), list(range(k * 20, k * 20 + 25))) for k in range(190)],
        "fp long, n long, elements binary, prefix array<long>",
    )
    groups = spark.createDataFrame([(k, 0) for k in range(190)], "node long, root long")
    dealt = ngram_join.dealt_groups(sets, groups, 75, group_elements=360)
    n = dealt.count()
    assert dealt.filter("i = j").count() == 190 and n <= 190 * 3  # each class at home once, and at two neighbours' at most
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_ngram_join_without_hot_classes(spark, monkeypatch):
    plain = skew.joined
    monkeypatch.setattr(ngram_join, "joined", lambda *args: plain(*args, share=2.0))
    rows = near_copies(6, 60)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute_components(rows)


def test_ngram_join_rows(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 977, 4), (5, 1, 5), (5, 1, 5), (6, 2, 6), (None, 1, None)], key=str)
    assert ngram_join.near_duplicates(empty).count() == 0


# Quality classifier


def test_quality_classifier_agrees_with_labels(spark, documents, folder):
    labels = table(spark, folder, "labels")
    rows = quality_classifier.report(documents).join(labels, "doc_id").select("quality", "kept").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_label_model_recovers_rates():
    rng = np.random.default_rng(2)
    n = len(quality_classifier.LABELLERS)
    junk = rng.random(200_000) < 0.2
    hit, alarm = np.linspace(0.3, 0.8, n), np.full(n, 0.01)
    fired = rng.random((len(junk), n)) < np.where(junk[:, None], hit, alarm)
    votes, counts = np.unique(fired @ (1 << np.arange(n)), return_counts=True)
    model = quality_classifier.fit_labellers(votes, counts.astype(float))
    assert abs(model.junk - 0.2) < 0.01 and np.abs(model.hit - hit).max() < 0.02 and np.abs(model.false_alarm - alarm).max() < 0.005


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    lines = [x for x in text.split("\n") if x]
    raw = text.encode()
    letters = sum(chr(c).isalpha() if c < 128 else True for c in raw)
    filled = sum(c not in b" \t\n\x0b\x0c\r" for c in raw)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = len(lines) - len(set(lines))
    if not words:
        return [0.0] * 8
    return [
        sum(c in "#*$%&|<>{}[]\\^~=+_@" for c in text) / len(words),
        sum(c in "#*$%&|<>{}[]\\^~=+_@" for c in text) / len(raw),
        sum(c in "!?" for c in text) / len(words),
        sum(65 <= c <= 90 for c in raw) / max(letters, 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
        (len(windows) - len(set(windows))) / len(words),
        repeated / max(len(lines), 1) if repeated >= 3 else 0.0,
        1 - (letters + 0.5 * sum(48 <= c <= 57 for c in raw)) / max(filled, 1),
    ]


def test_quality_measures_votes_and_posteriors_are_brute_force(spark, documents, texts):
    model = quality_classifier.fit(documents)
    got = {r.doc_id: r for r in quality_classifier.scored(documents, model).collect()}
    labellers = model.labellers
    for i, text in texts.items():
        found = brute_measures(text)
        votes = [x > bound for x, (_, bound) in zip(found, quality_classifier.LABELLERS, strict=True)]
        assert got[i].votes == sum(v << k for k, v in enumerate(votes)), (i, found)
        bad, good = labellers.junk, 1 - labellers.junk
        for v, h, f in zip(votes, labellers.hit, labellers.false_alarm, strict=True):
            bad, good = bad * (h if v else 1 - h), good * (f if v else 1 - f)
        assert math.isclose(got[i].posterior, good / (good + bad), rel_tol=1e-9, abs_tol=1e-12)


def test_quality_scorer_follows_its_gradient():
    rng = np.random.default_rng(8)
    n = 60
    text, bucket, value = np.repeat(np.arange(n), 5), rng.integers(0, 30, n * 5), rng.random(n * 5)
    target = (np.bincount(text, weights=(bucket < 10) * value) > 0.7).astype(float)
    w, b = quality_classifier.fit_scorer(text, bucket, value, target, rounds=2000, decay=1e-3)
    g = np.bincount(text, weights=w[bucket] * value) + b
    slope = (1 / (1 + np.exp(-g)) - target) / n
    grad = np.bincount(bucket, weights=slope[text] * value, minlength=len(w)) + 1e-3 * w
    assert np.abs(grad).max() < 1e-3 and abs(slope.sum()) < 1e-3


def test_quality_sample_takes_repeated_rows_once(spark):
    rows = [(1, "the same words again and again here")] * 500 + [(k, f"document number {k} says this") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(quality_classifier.report(docs).collect()) == 528


def test_quality_classifier_rows(odd, empty):
    got = quality_classifier.scored(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.report(empty).count() == 0


# Line dedup


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (len(holders.get(key(x), ())) >= 5 and i < max(holders[key(x)]))]
        out[i] = (len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches, fan_in", [(4, 4), (5, 2)])
def test_line_dedup_is_brute_force(spark, batches, fan_in):
    rng = random.Random(7)
    pool = [f"Line {i} " + "é" * rng.choice([10, 40]) + " End" for i in range(8)]
    rows = [(i, None if i == 3 else "\n".join(rng.choice([" \t" + x, x.upper().replace("É", "é") + "\r", x]) for x in rng.choices(pool, k=rng.randrange(6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_dropped", F.lit("clash"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in line_dedup.deduplicated(df, batches=batches, fan_in=fan_in).collect()}
    assert got == brute_lines(rows)


def test_line_runs_carry_tallies_through_joins_and_compactions(spark, monkeypatch):
    rng = random.Random(11)
    batches = [[(rng.randrange(12), 7, doc) for doc in range(b * 10, b * 10 + 10) for _ in range(3)] for b in range(7)]

    def verdicts():
        runs = line_dedup.LineRuns(fan_in=2)
        for batch in batches:
            runs.add(spark.createDataFrame(batch, "hi long, lo long, doc_id long"))
        return runs, {(r.hi, r.n_docs, r.last_doc) for r in runs.newest().collect()}

    runs, got = verdicts()
    rows = {(h, d) for batch in batches for h, _, d in batch}
    want = {(h, sum(x == h for x, _ in rows), max(d for x, d in rows if x == h)) for h, _ in rows}
    assert got == want and runs.compactions >= 3 and len(runs.levels) >= 3
    assert sum(len(level) for level in runs.levels) < 7
    monkeypatch.setattr(line_dedup, "superseded", lambda newer, older: newer.unionByName(older))
    assert verdicts()[1] != want  # without the anti-join old tallies stay


def test_line_dedup_without_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 2.0)
    rows = [(i, "a line that is held by all the documents here\nown line number {i} of this very document".format(i=i)) for i in range(9)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (2, int(i < 8)) for i in range(9)}


def test_line_dedup_rows(odd, empty):
    assert sorted(str(r.doc_id) for r in line_dedup.digest(odd).collect()) == sorted(str(r[0]) for r in ODD)
    assert line_dedup.digest(empty).count() == 0


def test_nearest_of_long_vectors_is_brute_force(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=3000)
    vectors = [(i, [float(x) for x in (base + rng.normal(size=3000) * 1e-3).astype(np.float32)]) for i in range(120)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()}
    x = np.array([v for _, v in vectors])
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    for q in (0, 50, 100):
        score = unit @ unit[q]
        best = [i for i in np.argsort(-score, kind="stable") if i != q][:5]
        assert [got[q, k + 1][0] for k in range(5)] == best
        assert all(math.isclose(got[q, k + 1][1], score[i], abs_tol=1e-12) for k, i in enumerate(best))


# Licenses


def test_licenses_base_is_brute_force(spark):
    rng = random.Random(9)
    parts = ["MIT", "License", "apache", "license", "version", "2", "cc", "by", "nc", "sa", "-", "É", "x", "licensed under the", "GPL v3", "\n", "9"]
    rows = [(i, rng.choice(["", " "]).join(rng.choices(parts, k=400)) if i % 2 else " ".join(rng.choices(parts, k=400))) for i in range(40)] + [(99, None), (100, "")]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licenses_keep_the_wider_detection(spark):
    text = "Released under the terms of the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 and SPDX-License-Identifier: MIT. All rights reserved"
    row = licenses.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "cc-by-nc-sa,mit,proprietary" and row.n_base == 0 and row.score == 1.0
    assert len(licenses.rules()) > 200


def plain_resolved(found):
    kept = []
    for one in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label)):
        if one[2].base or not any(k[0] <= one[0] and one[1] <= k[1] for k in kept):
            kept.append(one)
    return kept


def test_licenses_own_labels_and_scores_are_brute_force(spark):
    rng = random.Random(12)
    parts = ["MIT", "License", "apache", "license", "version", "2", "cc by", "nc", "sa", "released under the terms of", "GPL v3", "SPDX-License-Identifier:", "all rights reserved", "BSD", "3 clause", "word", "other"]
    rows = [(i, " ".join(rng.choices(parts, k=60))) for i in range(40)]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
        spelt = " " + " ".join(words) + " "
        found = []
        for rule in licenses.rules():  # every rule over the whole text, without keywords or stretches
            for match in rule.pattern.finditer(spelt):
                first = spelt.count(" ", 0, match.start()) - 1
                found.append((first, first + match.group().count(" ") + 1, rule))
        kept = plain_resolved(found)
        assert got[i].labels == ",".join(sorted({d[2].label for d in kept}))
        assert got[i].score == max((d[2].confidence for d in kept), default=0.0)
        assert sorted((d.first_word, d.end_word, d.label) for d in got[i].detections) == sorted((a, b, r.label) for a, b, r in kept)


@settings(max_examples=400, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_licenses_every_match_holds_a_keyword_within_reach(data):
    rule = data.draw(st.sampled_from(licenses.rules()))
    pattern = rule.pattern.pattern.removeprefix("(?<= )").removesuffix("(?= )")
    words = data.draw(st.from_regex(re.compile(pattern), fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz0123456789 ")).split(" ")
    places = [k for k, word in enumerate(words) if word in rule.keywords]
    assert any(k <= licenses.REACH and len(words) - 1 - k <= licenses.REACH for k in places), (rule.label, words)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This program is free software under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2-or-later"),
        ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lgpl-2.1-or-later"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "mit"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
        ("see http://www.apache.org/licenses/LICENSE-2.0.txt", "apache-2"),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl-2"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "gpl-2-syscall"),
        ("Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential", "proprietary"),
        ("The Apache tribe and the public, commons and a foundation of freedom: nothing here is a license.", ""),
    ],
)
def test_licenses_signatures_of_texts_and_headers(text, labels):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    _, found = licenses.Scanner(licenses.rules()).scan(data, np.array([0, len(data)]))
    assert ",".join(sorted({d[2].label for d in found.get(0, [])})) == labels


def test_licenses_resolve_like_pairwise_comparison():
    rng = random.Random(13)
    some = licenses.rules()
    for _ in range(200):
        found = [(a, a + rng.randrange(1, 9), rng.choice(some)) for a in rng.choices(range(30), k=25)]
        assert licenses.resolved(found) == plain_resolved(found)


def test_licenses_on_a_long_text_dense_with_keywords(spark):
    row = licenses.report(spark.createDataFrame([(1, "mit license " * 100_000)], "doc_id long, text string")).first()
    assert row.n_base == 100_000 and row.last_word == 199_998


def test_licenses_query_finds_the_phrases_of_its_contract(spark, tmp_path):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rng = random.Random(14)
    parts = ["Under", "the", "MIT", "License", "under the MIT-license", "apache license", "Version", "2", "cc by", "NC", "sa", "É", "\u212a", "\x7f", "\n", "9"]
    texts = [rng.choice([" ", "", "\x00"]).join(rng.choices(parts, k=300)) for _ in range(60)]
    texts += ["MIT License", "the MIT license", "Licensed under the MIT License.", "under the MIT License, under the mit license", "under the MIT licensed", None, "", "apache license version 2"]
    texts.append("under " * 50_000 + "the mit license")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op8_license_scans(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if words[k : k + phrase.count(" ") + 1] == phrase.split()]
        places, labels = [k for k, _ in found], {label for _, label in found}
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [(got[60 + k].n_base, got[60 + k].labels) for k in range(5)] == [(0, "mit"), (0, "mit"), (1, "mit"), (2, "mit"), (0, "mit")]


def test_licenses_base_phrases_are_checked():
    for phrase in ("", "cc by cc", "word " * 21):
        with pytest.raises(ValueError):
            licenses.rules(base=((phrase, "x"),))


def test_licenses_rows(odd, empty):
    assert licenses.report(odd).count() == len(ODD) and licenses.report(empty).count() == 0


# Toxicity


def test_toxicity_learns_words(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("nt", "rl", "sk", "mp")]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        text = rng.choices(words, k=40) + (rng.choices(["vileword", "grossword"], k=2) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.report(docs, known).collect()
    assert sum((r.predicted == 1) == (r.doc_id % 6 == 0) for r in got) >= 0.98 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_risk_and_slope_are_numeric(spark):
    rng = np.random.default_rng(6)
    positive = rng.random(40) < 0.3
    g = rng.normal(size=40)
    loss = lambda z, y: np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z))

    def parts(z, prior):
        p = np.mean([loss(x, 1) for x in z[positive]]) * prior
        rest = np.mean([loss(x, 0) for x in z[~positive]]) - prior * np.mean([loss(x, 0) for x in z[positive]])
        return p, rest

    for prior in (0.1, 0.9):
        z = g - 3 * (~positive) if prior == 0.9 else g  # negative rest, and positive
        p, rest = parts(z, prior)
        assert (rest < 0) == (prior == 0.9)
        risk, slope = toxicity.pu_risk(z, positive, prior)
        assert math.isclose(risk, p + max(0, rest))
        for k in range(40):
            up, down = z.copy(), z.copy()
            up[k] += 1e-6
            down[k] -= 1e-6
            (pu, ru), (pd_, rd) = parts(up, prior), parts(down, prior)
            want = (pu + ru - pd_ - rd) / 2e-6 if rest >= 0 else -(ru - rd) / 2e-6
            assert math.isclose(slope[k], want, rel_tol=1e-3, abs_tol=1e-7)


def test_toxicity_fit_is_the_constrained_minimum():
    rng = np.random.default_rng(7)
    positive = np.arange(2000) < 600
    toxic = positive | (rng.random(2000) < 0.25)
    rows = [np.flatnonzero(rng.random(4) < np.array([0.5, 0.4, 0.3, 0.3] if t else [0.3, 0.3, 0.25, 0.4])) for t in toxic]
    w, b = toxicity.fit_nnpu(rows, positive, 4, 0.25, rounds=3000, rate=0.02)

    def risk(weights, bias):
        return toxicity.pu_risk(np.array([weights[r].sum() + bias for r in rows]), positive, 0.25)[0] + 0.5e-4 * (weights**2).sum()

    best = risk(w, b)
    assert (w >= 0).all()
    assert w[3] == 0  # this one would be negative
    for k in range(4):
        for step in (0.05, -0.05):
            other = w.copy()
            other[k] = max(0, other[k] + step)
            assert risk(other, b) >= best - 1e-5
    assert risk(w, b + 0.05) >= best - 1e-5 and risk(w, b - 0.05) >= best - 1e-5


def test_toxicity_with_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "vile words")] * 300 + [(k, f"plain words {k % 5}") for k in range(2, 60)] + [(k, "vile") for k in range(60, 90)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1 or k >= 60)) for k in range(1, 90)], "doc_id long, toxic int")
    assert toxicity.report(docs, labels).count() == 388


def test_toxicity_held_out(spark, folder):
    sf = folder.replace("sf0.001", "sf0.01")
    rows = toxicity.report(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def test_toxicity_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(odd, labels).collect()
    assert len(got) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.report(empty, labels).count() == 0


# Quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_are_brute_force(spark, documents, texts):
    got = {r.doc_id: r for r in quality_rules.report(documents).collect()}
    for i, text in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_rules_order_does_not_matter(documents):
    order = quality_rules.rules()
    a = quality_rules.judged(documents, order).select("doc_id", "kept").collect()
    b = quality_rules.judged(documents, order[::-1]).select("doc_id", "kept").collect()
    assert sorted(a) == sorted(b)


def test_quality_rules_stay_linear_under_filters(spark):
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = quality_rules.judged(spark.createDataFrame([(1, text)], "doc_id long, text string"), quality_rules.rules())
    assert rows.filter("n_repeat_words > 0 AND NOT kept").select("n_repeat_words").first()[0] == 60_000


def test_quality_rules_order_is_repeatable(documents):
    names = [r.name for r in quality_rules.ordered_rules(documents)]
    assert sorted(names) == sorted(r.name for r in quality_rules.rules())
    assert names == [r.name for r in quality_rules.ordered_rules(documents.repartition(3))]


def test_quality_rules_rows(odd, empty):
    got = quality_rules.judged(odd).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got if r.text is None or not r.text.strip())
    assert quality_rules.report(empty).count() == 0


def test_line_runs_do_not_move(spark):
    runs = line_dedup.LineRuns(fan_in=3, buckets=4)
    for k in range(4):  # one compacted run and one more
        runs.add(spark.createDataFrame([(h, h * 7, k * 10 + d) for h in range(50) for d in range(2)], "hi long, lo long, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 1] and runs.compactions == 1
    plan = runs.newest()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {(r.hi, r.n_docs, r.last_doc) for r in runs.newest().collect()} == {(h, 8, 31) for h in range(50)}


def test_copies_of_one_vector_are_rescored_in_slices(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000 + i, [1.0, 2.0, 3.0 + i / 100]) for i in range(20)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 500, 5).collect()
    want = {q: [i for i in range(6) if i != q][:5] for q in range(0, 3000, 500)}
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want} == want
    x = np.array([[1.0, 2.0], [0.0, 1.0], [1.0, 2.0], [1.0, 2.0]])
    assert nearest._first_copies(np.array([9, 1, 3, 5]), x, 2).tolist() == [1, 2, 3]
