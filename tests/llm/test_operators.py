"""The training-data operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lastleg.llm import byte_bpe, html_text, media, near_dedup, packing, quality, queries, substrings, token_counts, topk, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string"


def make(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd_texts():
    shared = " ".join(words(30, 99))
    base = words(200, 1)
    near = [list(base) for _ in range(4)]
    for k, w in enumerate(near):
        w[10 * k] = "other"
    out = [None, "", "  \n\t ", "one", "one", "ONE", " ".join(base), " ".join(base)] + [" ".join(w) for w in near]
    out += [" ".join(words(25, k) + [shared] + words(25, 50 + k)) for k in range(5)]
    out += [" ".join(words(6000, 7)), "é日本 😀 'll  x   \n y", "a " * 40]
    return out


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, FOLDER).toPandas(), con.execute(sql).fetchdf()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns, name
        assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist())), name


def test_media_round_trip(spark, odd_texts):
    got = {r.doc_id: r for r in media.media_columns(make(spark, odd_texts)).collect()}
    for i, t in enumerate(odd_texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[6][2:] == got[7][2:]
    assert media.media_columns(make(spark, [])).count() == 0


def brute_removed(texts, ids, width):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in zip(ids, split, strict=True):
        for s in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, split, strict=True):
        gone = set()
        for s in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[s : s + width])] < i:
                gone |= set(range(s, s + width))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


@pytest.mark.parametrize("shard", [substrings.SHARD, 1])
def test_substrings(spark, odd_texts, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)  # 1: every anchor with two segments is grouped window by window
    ids = [*range(len(odd_texts) - 1), None]
    want = brute_removed(odd_texts, ids, 13)
    got = {r.doc_id: r for r in substrings.remove_repeats(make(spark, odd_texts, ids)).collect()}
    for i, w in zip(ids, want, strict=True):
        assert got[i].kept == b" ".join(w).decode()
        assert got[i].n_removed == len((odd_texts[ids.index(i)] or "").encode().split()) - len(w)
    assert substrings.remove_repeats(make(spark, [])).count() == 0


def test_suffix_automaton_finds_first_documents():
    r = random.Random(3)
    docs = [[r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(40)]
    automaton = substrings.SuffixAutomaton()
    for d, w in enumerate(docs):
        want = [next((e for e in range(d) if any(docs[e][k : k + 5] == w[s : s + 5] for k in range(len(docs[e]) - 4))), None) for s in range(len(w) - 4)]
        assert automaton.first_documents(w, 5) == want
        automaton.add(w, d)


def test_near_duplicates(spark, odd_texts):
    sets = [set(near_dedup.shingle_set((t or "").encode(), 2).tolist()) for t in odd_texts]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r for r in near_dedup.near_duplicates(make(spark, odd_texts), words=2).collect()}
    assert [got[i].component_id for i in range(len(sets))] == label
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    repeated = make(spark, ["a b c", "a b c", None], [5, 5, None])
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(repeated).collect()) == [(-1, None, True), (5, 5, True), (5, 5, True)]
    assert near_dedup.near_duplicates(make(spark, [])).count() == 0
    kept = near_dedup.keep_one(make(spark, odd_texts), words=2)
    assert kept.columns == make(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_large_bands_lose_no_link(spark, monkeypatch):
    """Blocks of two classes: links across the blocks of a band are found by the cells."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    texts = []
    for g in range(3):  # chains: neighbours are linked, the ends are not
        w = words(120, 40 + g, 5000)
        for k in range(12):
            w[6 * k : 6 * k + 6] = [f"g{g}k{k}n{n}" for n in range(6)]
            texts.append(" ".join(w))
    random.Random(5).shuffle(texts)
    sets = [set(near_dedup.shingle_set(t.encode(), 2).tolist()) for t in texts]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(make(spark, texts), words=2).collect()}
    assert [got[i] for i in range(len(sets))] == label and len(set(label)) == 3


def test_cells_meet_every_outsider(spark, monkeypatch):
    """Each class outside the largest component shares a cell with every other class of its band."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    large = spark.createDataFrame([(7, 40, i) for i in range(40)] + [(8, 10, i) for i in range(10)], "band bigint, size bigint, rep bigint")
    linked = spark.createDataFrame([(i, 0) for i in range(25)], "node bigint, component bigint")
    rows = near_dedup._cells(large, linked).collect()
    cells = {}
    for r in rows:
        cells.setdefault(r.key, set()).add(r.rep)
    met = {(a, b) for own in cells.values() for a in own for b in own}
    assert all((a, b) in met for a in range(25, 40) for b in range(40))
    assert max(map(len, cells.values())) < 40 and {r.rep for r in rows if r.outside} == set(range(25, 40))


def test_block_links_join_what_is_linked():
    base = np.arange(100, dtype=np.uint64)
    sets = [base, np.concatenate((base[:95], base[:3] + np.uint64(1000))), base + np.uint64(5000)]
    assert list(near_dedup.block_links([np.sort(s) for s in sets], np.array([0, 1, 2]), 80)) == [(0, 1)]


def test_topk_with_ties_and_unsound_vectors(spark):
    """Ties, repeated ids (a query's other row is a candidate), vectors of two lengths, clashing columns."""
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)] + [(5, [2.0, 1.0]), (20, [9.0, 1.0]), (7, [1.0, 1.0]), (80, [1.0, 2.0, 3.0]), (81, [1.0, 0.0, 1.0])]
    odd = [(60, None), (61, [float("nan"), 1.0]), (62, [None, 1.0]), (None, [1.0, 1.0]), (63, [float("inf"), 0.0]), (100, [])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("clash") for c in ("score", "row", "block", "lane", "query")})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, 10, 20).collect())
    want = []
    for n, (q, x) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(x, v, strict=True)), i) for m, (i, v) in enumerate(rows) if m != n and len(v) == len(x))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want) and sum(q == 20 for q, *_ in got) == 20
    assert topk.top_k(df.where("false"), 10, 20).count() == 0
    with pytest.raises(Exception, match="63 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e16]), (1, [1e16])], "vec_id bigint, embedding array<double>"), 10, 20).count()


def test_token_counts(spark, odd_texts):
    path = P.path("piece_bpe_32k.model")
    pieces = token_counts.zipf_pieces(path)

    def plain(word):
        w = token_counts.WORD_START + word
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            size = len(w[e - 1].encode())
            now = (best[e - 1][0] + token_counts.BYTE_SCORE * size, best[e - 1][1] + size)
            for b in range(e - 1, -1, -1):
                if w[b:e] in pieces and best[b][0] + pieces[w[b:e]] > now[0]:
                    now = (best[b][0] + pieces[w[b:e]], best[b][1] + 1)
            best.append(now)
        return best[-1][1]

    got = {r.doc_id: r for r in token_counts.token_counts(make(spark, odd_texts), path).collect()}
    for i, t in enumerate(odd_texts):
        split = (t or "").encode().split()
        assert got[i].n_pretokens == len(split)
        assert got[i].n_tokens == sum(plain(w.decode()) for w in split)


def test_byte_bpe(spark, odd_texts):
    import tiktoken

    bpe = byte_bpe.PrefixBPE.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(1)
    parts = [" ", "\n", "\t", "a", "é", "'ll", "12", "!", "日本", "the", "ing", "\x1c", "\xa0", "😀", "<|endoftext|>"]
    for text in odd_texts + ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(500)]:
        assert bpe.encode(text or "") == library.encode_ordinary(text or "")
    word = "transformations".encode()
    table = bpe.last_tokens(word)
    assert bpe.last_tokens(word + b"xy", table, len(word)) == bpe.last_tokens(word + b"xy")  # exact append
    for row in byte_bpe.encode_decode(make(spark, odd_texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        assert bytes(row.decoded) == (odd_texts[row.doc_id] or "").encode()


def test_packing(spark, odd_texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(make(spark, odd_texts), P.path("word_bpe_49k.json"), size=128, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(odd_texts):
        whole = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        assert b"".join(ids for _, ids, _, _ in sorted(pieces[i])) == whole
        assert all(n == len(whole) // 4 and crc == zlib.crc32(ids) for _, ids, n, crc in pieces[i])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 128 or at & (at - 1) == 0
    assert packing.pack(make(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.array([(a, b) for a in range(8) for b in range(8)])
    keys = packing.hilbert_index(cells, 3)
    assert sorted(keys.tolist()) == list(range(64))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li>menu</li></ul></nav><article><h1>A &amp; B</h1><p><b>x<br> y<p>z&nbsp;&lt;w<div class='comments'><p>no</p></div><form>f</form></article><footer>no</footer>"
    df = spark.createDataFrame([(1, "http://h/a", page, "c"), (1, "http://h/a", page, "c"), (2, None, None, "c"), (None, "http://h/b", "", "c"), (3, "bad url", "<p>plain<p>text", "c")], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(0, "", 0), (1, "A & B\n\nx y\n\nz <w", 16), (1, "A & B\n\nx y\n\nz <w", 16), (2, "", 0), (3, "plain\n\ntext", 11)]
    assert html_text.extract(df.where("false")).count() == 0


def test_wrapper_has_repeats_and_optionals():
    pages = [f"<body><div>site</div><ul>{'<li>x</li>' * n}</ul>{'<hr><h2>o</h2>' if n == 2 else ''}<div>text {n}</div></body>" for n in (1, 2, 3)]
    got = html_text.infer(pages)
    assert "+" in got["expression"] and "?" in got["expression"]


def test_texts_take_their_role_from_the_wrapper(spark):
    """One path, two positions: the first holds the same text on all pages, in an article and before it."""
    pages = [f"<body><article><h1>h {n}</h1><div>Share <b>this</b></div><ul>{'<li>x %d</li>' % n * n}</ul><div>By <b>{n}</b></div></article></body>" for n in range(1, 7)]
    rows = [(n, f"http://h/{n}", p) for n, p in enumerate(pages, 1)] + [(90 + n, "http://few/", p) for n, p in enumerate(pages[:2])] + [(95, "http://copies/", pages[0]), (96, "http://copies/", pages[0]), (97, "http://copies/", pages[0])]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    for n in range(1, 7):
        assert got[n] == "\n\n".join([f"h {n}", *[f"x {n}"] * n, f"By {n}"])
    assert all("Share this" in got[n] for n in (90, 91, 95, 96, 97))


def test_wrapper_counts_all_pages_and_whole_streams(spark):
    """A notice after 600 symbols, one on a template of few pages, and a slot that is equal on the first eight pages only."""
    long = "".join(f"<div class='x{chr(97 + k % 26)}{chr(97 + k // 26)}'>{{n}}</div>" for k in range(250))
    pages = [f"<body>{long.format(n=n)}<section>all rights</section></body>" for n in range(4)]
    hosts = [(n, "http://long/", p) for n, p in enumerate(pages)]
    hosts += [(100 + n, "http://mixed/", f"<body><p>{'news' if n < 60 else n}</p><h2>{n}</h2>{'<section>old site</section>' if n >= 60 else ''}</body>") for n in range(64)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(hosts, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert all("all rights" not in got[n] and got[n].count(str(n)) == 250 for n in range(4))
    assert all(got[100 + n] == f"{'news' if n < 60 else n}\n\n{n}" for n in range(64))


def test_wrapper_accepts_every_page():
    def element(r, depth):
        if not depth or r.random() < 0.3:
            return "text "
        tag = r.choice(["div", "p", "b"])
        return f"<{tag}>{''.join(element(r, depth - 1) for _ in range(r.randrange(4)))}</{tag}>"

    for seed in range(20):
        r = random.Random(seed)
        pages = ["".join(element(r, 4) for _ in range(r.randrange(1, 6))) for _ in range(12)]
        streams = [html_text.stream_of(html_text.tokens_of(p))[0] for p in pages]
        matcher = html_text.Matcher(html_text.infer(pages)["wrapper"])
        for symbols in streams:
            at = matcher.positions(symbols)
            assert [matcher.symbol[n] for n in at] == symbols


@pytest.mark.parametrize("operator, label, mod, held", [(quality.quality, "quality", 3, 1), (toxicity.toxicity, "toxic", 5, 0)])
def test_classifiers(spark, odd_texts, operator, label, mod, held):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = operator(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (scored["predicted"] == scored[label]).mean() > (0.97 if label == "quality" else 0.96)
    assert all((zlib.crc32(str(i).encode()) % mod == held) for i in scored["doc_id"])
    odd = operator(make(spark, odd_texts, [*range(len(odd_texts) - 1), None]), labels).collect()
    assert len(odd) == len(odd_texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    none = operator(docs.limit(5), labels.where("false")).collect()
    assert len(none) == 5


def test_toxicity_with_few_labels(spark):
    """Ten toxic labels: held-out texts of the larger corpus are neither all toxic nor all clean. One of each: none is toxic."""
    small, large = (tuple(spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels")) for sf in ("sf0.001", "sf0.1"))
    known = large[0].join(large[1].where("toxic in (0, 1)"), "doc_id").select("text", "toxic").collect()
    scores = np.array(toxicity.Scorer(toxicity.fit(*small)).scores([(r.text or "").encode() for r in known]))
    toxic = np.array([r.toxic == 1 for r in known])
    assert (scores[~toxic] < 0.5).mean() > 0.95 and (scores[toxic] >= 0.5).mean() > 0.4
    scorer = toxicity.Scorer(toxicity.train([(b"some words here", 0), (b"other words there", 1)]))
    assert all(0 < s < 0.45 for s in scorer.scores([b"", b"nothing known", b"words"]))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good, bad = quality.fit(docs, labels), None
    rows = [r for r in docs.collect() if quality._scores(good, [(r.text or "").encode()])[0] >= 0.5]
    bad = toxicity.Scorer(toxicity.fit(spark.createDataFrame(rows, docs.schema), labels))
    rows = [r for r in rows if bad.scores([(r.text or "").encode()])[0] < 0.5]
    sets = [set(near_dedup.shingle_set((r.text or "").encode(), 5).tolist()) for r in rows]
    label = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            low = min(rows[label[i]].doc_id, rows[label[j]].doc_id)
            label[i] = label[j] = label[i] if rows[label[i]].doc_id == low else label[j]
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    kept = brute_removed([r.text for r in rows], [r.doc_id for r in rows], corpus_pipeline.PASSAGE_WORDS)
    texts = {r.doc_id: (r.text or "") if len(w) == len((r.text or "").encode().split()) else b" ".join(w).decode() for r, w in zip(rows, kept, strict=True)}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    got = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
