"""Repeated ids, ties, hot keys, empty tables, clashing columns: each case of each operator against brute force."""

import hashlib
import random
import tarfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lastleg.llm import byte_bpe, common, components, html_text, media, near_dedup, packing, quality, substrings, token_counts, toxicity
from tests.llm.test_operators import brute_removed, make, words


def text(n, seed, size=400):
    return " ".join(words(n, seed, size))


def brute_components(rows, size=2):
    """Least id reachable of each row, linked by texts alone."""
    sets = [set(near_dedup.shingle_set((t or "").encode(), size).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) if rows[i][0] is not None else None for i in range(len(rows))]


def near(base, k):
    w = base.split()
    w[7 * k] = f"changed{k}"
    return " ".join(w)


def test_near_duplicates_of_an_id_with_several_texts(spark):
    """(5, A), (5, B), (7, A'), (9, B'): 9 is linked with 5; both texts of 5 are documents of their own."""
    a, b = text(100, 1, 5000), text(100, 2, 5000)
    rows = [(5, a), (5, b), (7, near(a, 1)), (9, near(b, 1)), (11, text(100, 3, 5000)), (11, text(100, 3, 5000)), (4, ""), (4, None), (4, ""), (None, a)]
    frame = make(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame, words=2).collect()), key=str)
    want = [(i, len(near_dedup.shingle_set((t or "").encode(), 2)), c, i is None or c == i) for (i, t), c in zip(rows, brute_components(rows), strict=True)]
    assert got == sorted(want, key=str) and (9, 99, 5, False) in got
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(frame.withColumns({"_kept": F.lit("x"), "root": F.lit(1)}), words=2).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (11, rows[4][1]), (4, ""), (4, None), (None, a)], key=str)


@pytest.mark.parametrize("hot", [1, 1000])
def test_hubs_and_hot_bands(spark, monkeypatch, hot):
    """A bound of one row makes every key hot: salted joins and broadcast hubs give what plain joins give."""
    monkeypatch.setattr(common, "LEAST_HOT", hot)
    monkeypatch.setattr(components, "FEW", hot)
    base = text(120, 9, 5000)
    rows = [(i, near(base, i % 12)) for i in range(40)] + [(100 + i, text(60, 50 + i, 5000)) for i in range(10)]
    frame = make(spark, [t for _, t in rows], [i for i, _ in rows])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, words=2).collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows)
    star = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(k, k + 100) for k in range(1, 60)] + [(300, 301)], "u bigint, v bigint")
    found = {r.node: r.component for r in components.components(star, common.Written(spark)).collect()}
    assert all(found[k] == 0 for k in range(60)) and found[301] == 300


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_by_key_equals_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(200)] + [(99, 1)], "k bigint, x bigint")
    table = rows.where("k <> 99").groupBy("k").agg(F.count("*").alias("n_rows"), F.max("x").alias("most"))
    got = sorted(map(tuple, common.join_by_key(rows, table, ["k"], rows.count(), how).collect()), key=str)
    assert got == sorted(map(tuple, rows.join(table.drop("n_rows"), "k", how).collect()), key=str)


@pytest.mark.parametrize("hot", [1, 1000])
def test_a_line_of_all_documents(spark, monkeypatch, hot):
    """A licence line in every document, repeated rows and several texts of one id; with every key hot, and with none."""
    monkeypatch.setattr(common, "LEAST_HOT", hot)
    line = text(40, 77)
    texts = [f"{text(20, k)} {line} {text(9, 90 + k)}" for k in range(25)]
    ids = list(range(25))
    texts += [texts[3], texts[4], text(50, 5), None, "", line]
    ids += [3, 3, 3, 40, 41, None]
    want = sorted((str(i), b" ".join(w).decode()) for i, w in zip(ids, brute_removed(texts, ids, 13), strict=True))
    frame = make(spark, texts, ids).withColumns({"anchor": F.lit(1), "starts": F.lit(2), "text_key": F.lit(3)})
    assert sorted((str(r.doc_id), r.kept) for r in substrings.remove_repeats(frame).collect()) == want
    cut = substrings.without_repeats(frame)
    assert cut.columns == frame.columns and cut.count() == len(texts)


def test_spans_are_maximal():
    for seed in range(30):
        r = np.random.default_rng(seed)
        n, width = 60, 5
        starts = r.choice(n - width + 1, r.integers(0, 12), replace=False).tolist()
        gone = {k for s in starts for k in range(s, s + width)}
        found = substrings.spans(starts, width)
        assert {k for a, b in found for k in range(a, b)} == gone
        assert all(b < c for (_, b), (c, _) in zip(found, found[1:], strict=False))
        w = [str(k).encode() for k in range(n)]
        assert substrings.without(w, starts, width) == [x for k, x in enumerate(w) if k not in gone]


def test_media_shards_open_with_a_tar_reader(spark, tmp_path):
    texts = ["a", "a", None, "", "x" * 5000, "a"]
    frame = make(spark, texts, [1, 2, 3, None, 5, 1]).withColumns({"shard": F.lit("clash"), "width": F.lit(1)})
    index = media.write_shards(frame, f"file://{tmp_path}/media", shard_bytes=2048).cache()
    members = {}
    for shard in (tmp_path / "media/shards").glob("*.tar"):
        with tarfile.open(shard) as tar:
            for m in tar:
                members[m.name] = tar.extractfile(m).read()
    stored = {f"{hashlib.sha256(media.padded((t or '').encode())).hexdigest()}.png": media.padded((t or "").encode()) for t in texts}
    assert {k: media.from_png(v) for k, v in members.items()} == stored
    sizes = {r.digest: (r.width, r.height) for r in media.headers(index).collect()}
    assert all(sizes[k[:-4]] == (64, len(v) // 64) for k, v in stored.items())
    assert sorted(str(r.doc_id) for r in media.read_back(media.headers(index)).collect()) == ["1", "1", "2", "3", "5", "None"]


@pytest.mark.parametrize("operator", ["tokens", "bpe", "packing"])
def test_tokenizers_take_repeated_rows_and_nulls(spark, operator):
    long = text(9000, 4)
    texts, ids = ["one two", "one two", None, "", long, "x"], [1, 1, 2, None, 4, 1]
    frame = make(spark, texts, ids).withColumns({"start": F.lit("clash"), "n_tokens": F.lit("clash"), "key": F.lit("clash")})
    empty = frame.where("false")
    if operator == "tokens":
        path = P.path("piece_bpe_32k.model")
        got = sorted(((r.doc_id, r.n_pretokens) for r in token_counts.token_counts(frame, path).collect()), key=str)
        assert got == sorted([(i, len((t or "").split())) for i, t in zip(ids, texts, strict=True)], key=str)
        assert token_counts.token_counts(empty, path).count() == 0
    elif operator == "bpe":
        path = P.path("byte_bpe_50k.tiktoken")
        got = sorted(((r.doc_id, bytes(r.decoded).decode()) for r in byte_bpe.encode_decode(frame, path, P.PATTERN).collect()), key=str)
        assert got == sorted([(i, t or "") for i, t in zip(ids, texts, strict=True)], key=str)
        assert byte_bpe.encode_decode(empty, path, P.PATTERN).count() == 0
    else:
        from tokenizers import Tokenizer

        path = P.path("word_bpe_49k.json")
        library = Tokenizer.from_file(path)
        rows = packing.pack(frame, path, size=256, with_ids=True).collect()
        total = {}
        for r in rows:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        want = {}
        for i, t in zip(ids, texts, strict=True):
            want[i] = want.get(i, 0) + len(library.encode(t or "", add_special_tokens=False).ids) + 1
        assert total == want and sum(r.doc_id == 4 for r in rows) > 30
        assert packing.pack(empty, path).count() == 0


def test_tries_start_anew_and_cut_long_words(spark, monkeypatch):
    pieces = token_counts.zipf_pieces(P.path("piece_bpe_32k.model"))
    monkeypatch.setattr(token_counts, "DEPTH", 3)
    shallow = token_counts.TrieCounter(pieces)
    deep = token_counts.TrieCounter(pieces)
    texts = [text(40, k).encode() + b" " + b"transformation" * 5 for k in range(12)]
    monkeypatch.setattr(token_counts, "TRIE_NODES", 20)
    few = [shallow.count([t]) for t in texts]
    monkeypatch.setattr(token_counts, "DEPTH", 64)
    monkeypatch.setattr(token_counts, "TRIE_NODES", 10**6)
    assert few == [deep.count([t]) for t in texts]
    shared = len(deep.score)
    deep.count([b"transformations"])
    assert len(deep.score) == shared + 1  # one letter more than a word that is there


def test_new_words_of_a_batch_go_down_the_trie_together(monkeypatch):
    pieces = token_counts.zipf_pieces(P.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    letters = ["a", "e", "n", "t", "s", "ing", "tion", "é", "ß", "的", "\U0001f600", "\x00", "\ufffd", token_counts.WORD_START]
    words = [b"\xff", b"a\xe2\x82", b"\xe2\x96", *("".join(rng.choices(letters, k=rng.randrange(1, 12))).encode() for _ in range(3000))]

    def plain(raw):
        w, best = token_counts.WORD_START + raw.decode("utf-8", "replace"), [(0.0, 0)]
        for e in range(1, len(w) + 1):
            size = len(w[e - 1].encode())
            now = (best[e - 1][0] + token_counts.BYTE_SCORE * size, best[e - 1][1] + size)
            for b in range(e - 1, -1, -1):
                if w[b:e] in pieces and best[b][0] + pieces[w[b:e]] > now[0]:
                    now = (best[b][0] + pieces[w[b:e]], best[b][1] + 1)
            best.append(now)
        return best[-1][1]

    own = token_counts.TrieCounter(pieces)
    step = token_counts.TrieCounter._step
    monkeypatch.setattr(token_counts.TrieCounter, "_step", None)  # no character of these is scored alone
    for at in range(0, len(words), 700):
        part = words[at : at + 700]
        assert own.count([b" ".join(part), b"", part[0]]) == ([len(part), 0, 1], [sum(map(plain, part)), 0, plain(part[0])])
    prefixes = {(token_counts.WORD_START + w.decode("utf-8", "replace"))[:n] for w in words for n in range(80)}
    assert len(own.score) == len(prefixes)  # each prefix is one node, the empty one too
    monkeypatch.setattr(token_counts.TrieCounter, "_step", step)
    long = [w * 9 for w in words if len(w) > 20][:40]
    assert own.count([b" ".join(long)]) == ([len(long)], [sum(map(plain, long))])


def test_classes_and_repeated_pages(spark):
    probes = {
        '<div class="layout has-sidebar"><article><p>x</article></div>': "x",
        '<div class="site-content no-sidebar"><p>x</div>': "x",
        '<article class="post has-comments"><p>x</article>': "x",
        '<div class="maintenance"><p>n</div><p>y': "n\n\ny",
        '<form id="page"><article><header class="entry-header"><h1>T</h1></header><p>x<div class="post-comments">no</div></article></form>': "T\n\nx",
    }
    rows = [(k, f"http://p{k}/", h) for k, h in enumerate(probes)] + [(0, "http://p0/", "<p>other</p>"), (0, "http://p0/", "<p>other</p>")]
    long = "<article>" + "".join(f"<p>line {k}</p>" for k in range(20_000)) + "</article>"
    rows.append((99, "http://long/", long))
    got = sorted((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    want = [(k, t) for k, t in enumerate(probes.values())] + [(0, "other")] * 2 + [(99, "\n\n".join(f"line {k}" for k in range(20_000)))]
    assert got == sorted(want)


def labelled(spark, n=60):
    good = [(k, f"calm weather over {text(30, k)}") for k in range(n)]
    bad = [(n + k, f"you {'idiot' if k % 2 else 'moron'} {text(12, 500 + k)} %%% ###") for k in range(n)]
    rows = good + bad
    labels = [(i, int(i < n), int(i >= n)) for i, _ in rows] + [(1, 0, 1), (None, 1, 0), (2, None, None)]
    return make(spark, [t for _, t in rows], [i for i, _ in rows]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_classifiers_on_odd_tables(spark, operator):
    docs, labels = labelled(spark)
    odd = make(spark, ["calm weather", "calm weather", None, "", "other text"], [3, 3, None, 500, 3])
    both = docs.unionByName(odd).withColumns({"y": F.lit("clash"), "k": F.lit("clash"), "held_out": F.lit("clash")})
    got = operator(both, labels).collect()
    assert len(got) == docs.count() + 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (None, 500)}) == 1  # null and empty texts are alike
    assert operator(both.where("false"), labels).count() == 0
    keep = quality.keep_good if operator is quality.quality else toxicity.drop_toxic
    assert keep(both, labels).columns == both.columns and keep(both.where("false"), labels).count() == 0


def test_toxicity_scores_by_hand(spark):
    """Every score again, one n-gram at a time, from the model's numbers."""
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)

    def plain(raw):
        means = []
        for w in raw.lower().split():
            t = f"<{w.decode().strip('.,!?;:|')}>"
            rows = [toxicity.xxhash.xxh3_64_intdigest(t) % toxicity.ROWS]
            for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
                for at in range(len(t) - n + 1):
                    total = sum(ord(c) * int(m) for c, m in zip(t[at : at + n], toxicity._multipliers, strict=False)) % 2**64
                    rows.append(int(common.mix64(np.array([total], dtype=np.uint64))[0]) % toxicity.ROWS)
            means.append(np.mean(model.weights[rows]))
        return 1 / (1 + np.exp(-((np.mean(means) if means else 0.0) + model.bias)))

    texts = [b"calm weather", b"", "You IDIOT, été!".encode()]
    assert np.allclose(toxicity.Scorer(model).scores(texts), list(map(plain, texts)), atol=1e-9)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    for row in docs.where("doc_id % 17 = 0").collect():
        assert abs(got[row.doc_id] - plain(row.text.encode())) < 1e-9


def test_quality_scores_by_hand(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    for row in docs.where("doc_id % 17 = 0").collect():
        x = quality.features(row.text.encode())
        grams = {}
        for a, b, c in zip(*(row.text.encode()[k:] for k in range(3)), strict=False):
            h = ((a | b << 8 | c << 16) * 0x9E3779B1 % 2**32) >> (32 - 9)
            grams[h] = grams.get(h, 0) + 1
        n = sum(grams.values())
        assert np.allclose(x[quality.N_COUNTS :], [np.sqrt(grams.get(k, 0) / n) for k in range(quality.TRIGRAMS)])
        logit = sum((v - c) / s * w for v, c, s, w in zip(x, model.center, model.scale, model.weights, strict=True)) - model.threshold
        assert abs(got[row.doc_id] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_unseen_misspellings_are_caught(spark):
    """One letter doubled in every longer word: the n-grams that are left still tell, and clean texts stay clean."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    known = docs.join(labels.where("toxic in (0, 1)"), "doc_id").select("doc_id", "text", "toxic").collect()
    held = [r for r in known if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]

    def misspelt(t):
        return b" ".join(w[: len(w) // 2] + w[len(w) // 2 : len(w) // 2 + 1] + w[len(w) // 2 :] if len(w) >= 5 else w for w in t.split())

    scores = np.array(scorer.scores([misspelt((r.text or "").encode()) for r in held]))
    toxic = np.array([r.toxic == 1 for r in held])
    assert (scores[toxic] >= 0.5).mean() >= 0.75 and (scores[~toxic] < 0.5).mean() >= 0.95


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows and clashing names pass through every stage; empty tables too."""
    import corpus_pipeline

    docs, labels = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = make(spark, ["calm weather today", "calm weather today", None, "", None], [3, 3, None, 500, None])
    names = ("_kept", "root", "key", "starts", "whole", "__y", "score")
    frame = docs.unionByName(odd.select(docs.columns)).withColumns({c: F.lit("clash") for c in names})
    for source in (frame, frame.where("false")):
        now = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == source.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").distinct().collect()}
