"""The training-data operators against brute force, round trips and the public libraries."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("seriesforge.llm.queries")

from seriesforge.llm import chat_format, components, decontaminate, hilbert_search, jaccard_join, language_id, pii, queries, shingles, token_counts, trie_bpe, url_filters, warc  # noqa: E402
from seriesforge.llm.vocabulary import default_vocabulary, load_word_bpe  # noqa: E402

ODD_TEXTS = [None, "", " ", "\n\t", "a", "word", "don't!", "<|endoftext|>x<|startoftext|>", "ΑΣ Σς İ ǅ ½²Ⅷ", "ﬁ é é ẛ̣", "中文字 🎉👍🏽‍", "x\x1cy\x0bz\x85q", "the " * 3000, "tion" * 900, "aaaa" * 500]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    parts = list("abcdefghijklmnopqrstuvwxyzABC  '.,!?0123\n\téßñΣςİ½中🎉<|>") + ["the ", "'s", "ing", "<|endoftext|>", "tion "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def documents(spark, texts, **extra):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# -- tokens --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(default_vocabulary())


def test_encoding_equals_the_library(spark, library):
    texts = ODD_TEXTS + random_texts(600) + ["same", "same"]
    got = {r.doc_id: r for r in trie_bpe.encode_documents(documents(spark, texts).withColumn("n_tokens", F.lit("clash")), default_vocabulary()).collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, texts), default_vocabulary()).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k].n_tokens == counts[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert counts[k].n_bytes == len((text or "").encode()) and counts[k].over_limit == (len(ids) > 2048)


@pytest.mark.parametrize("part, before, step", [(5, 0, 1), (7, 3, 2), (20, 20, 64)])
def test_chunk_maps_compose(library, monkeypatch, part, before, step):
    for name, value in {"PART": part, "BEFORE": before, "STEP": step, "WORDS": 3}.items():
        monkeypatch.setattr(token_counts, name, value)
    counter = token_counts.TokenCounter(load_word_bpe(default_vocabulary()))
    for text in random_texts(300, 8) + ["tion" * 50, "internationalisation" * 9 + "é" * 40, "x" * 99]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_a_part_has_one_map_for_all_states(monkeypatch):
    """A part's map at any state equals a walk from that state."""
    monkeypatch.setattr(token_counts, "STEP", 2)
    transducer, rng = token_counts.CountTransducer(load_word_bpe(default_vocabulary())), random.Random(3)
    letters = lambda n: "".join(rng.choice("etaoinsr") for _ in range(n))
    for _ in range(200):
        part, last = letters(rng.randint(2, 40)), rng.random() < 0.3
        state = transducer.walk(transducer.start, letters(rng.randint(1, 9)))[0]
        after, tokens = transducer.walk(state, part[: len(part) - last])
        want = (transducer.start, tokens + transducer.end(after, part[-1])) if last else (after, tokens)
        assert token_counts.Part(transducer, letters(rng.randint(0, 5)), part, last).at(state) == want


def test_round_trip_of_ids(library):
    bpe = load_word_bpe(default_vocabulary())
    for _, _, plain, ids in trie_bpe.TrieEncoder(bpe).encode([t or "" for t in ODD_TEXTS]):
        assert trie_bpe.decode(ids.tolist(), bpe).encode() == plain


# -- URL filters ---------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://a.EXAMPLE.com/en/1?x", "https://www.example.com/en/", "http://example.com", "http://x.net/fr/a#b", "http://notexample.com/en/", "http://net/es/", "x://com/?", "://com/", "http://a\nb.com/x\ny", "http://\ncom/", "http://x.net/fr/" + "z" * 50_000, "http://x.net/fr/a#b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, queries.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("example.com", "", None, "allow"), ("x.net", "/fr/a", "net/fr/", "block"), ("notexample.com", "/en/", "com/", "allow"), ("net", "/es/", "net/es/", "block"), ("com", "/", "com/", "allow"), ("com", "/", "com/", "allow"),
        ("a\nb.com", "/x\ny", "com/", "allow"), ("\ncom", "/", None, "allow"), ("x.net", "/fr/" + "z" * 50_000, "net/fr/", "block"), ("x.net", "/fr/a", "net/fr/", "block"),
    ]
    assert url_filters.judge_urls(pages.where("false"), queries.URL_RULES).count() == 0


def test_index_equals_all_rules():
    rng = random.Random(2)
    rules = [url_filters.Rule(".".join(rng.choice(["a", "bb", "c-d", "com"]) for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("xy/Z") for _ in range(rng.randint(0, 4))), rng.choice(["allow", "block"])) for _ in range(60)]
    index = url_filters.RuleIndex(rules, {})
    for _ in range(500):
        host, path = ".".join(rng.choice(["a", "bb", "c-d", "com", "w"]) for _ in range(rng.randint(1, 4))), "/" + "".join(rng.choice("xy/Z") for _ in range(rng.randint(0, 6)))
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        want = min(fits, key=lambda r: (-len(r.name), -len(r.host), r.name, r.verdict), default=None)
        assert index.judge(host, path) == want


# -- neighbours ----------------------------------------------------------------------------


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).round(2)
    x[40:80] = x[40]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0]), (304, [None] * 8)]
    got = hilbert_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 300, 20):
        scores = [(-sum(a * b for a, b in zip(x[q], c)), k) for k, c in enumerate(x) if k != q]
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [v for _, v in mine] == [k for _, k in sorted(scores)[:20]]
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert hilbert_search.search(few, F.col("vec_id") == 0).count() == 2
    assert hilbert_search.search(few.where("false"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("dimensions", [3, 32])
def test_windows_find_nine_of_ten(spark, monkeypatch, dimensions):
    """Recall of the merged windows alone, over more points than a window holds."""
    monkeypatch.setattr(hilbert_search, "ROWS", 32)
    rng = np.random.default_rng(dimensions)
    x = rng.standard_normal((3000, dimensions)) @ rng.standard_normal((dimensions, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:180] = x[100]  # equal vectors
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(100, [float(v) for v in x[100]])]
    got = hilbert_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit("clash"), "point": F.lit(1)}), F.col("vec_id") % 20 == 0).collect()
    hit, asked = 0, [q for q in range(0, 3000, 20) if q not in range(100, 180)]
    for q in asked:
        scores = x @ x[q]
        true = sorted((-scores[k], k) for k in range(3000) if k != q)[:20]
        hit += len({k for _, k in true} & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * 20 * len(asked)
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 120)[:3] == [(1, 100), (2, 100), (3, 101)]


def test_hilbert_keys_are_neighbours():
    cells = np.array(list(itertools.product(range(4), repeat=3)))
    order = cells[np.argsort(hilbert_search.hilbert_keys(cells, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# -- language ------------------------------------------------------------------------------


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "123 ...", None), (-3, "", "fr")], docs.schema))
    out = language_id.identify(docs, language_id.train(docs, ~language_id.held_out())).collect()
    assert {r.lang_pred for r in out if r.doc_id < 0} == {"und"}
    tested = [r for r in out if r.doc_id >= 0]
    assert sum(r.lang_pred == r.lang for r in tested) / len(tested) > 0.9 and all(0 <= r.score <= 1 for r in out)
    none = language_id.train(docs, F.lit(False))
    assert none is None and {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_codewords_differ():
    for n in (2, 4, 9):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n


# -- Jaccard join --------------------------------------------------------------------------


def test_few_links_are_joined_in_one_task(spark, monkeypatch):
    order = list(range(3000))
    random.Random(3).shuffle(order)
    rows = [(order[k], order[k + 1]) for k in range(2999) if k % 1000 != 999] + [(order[0], order[500])]  # three long paths, one with a loop
    least = {n: min(order[k : k + 1000]) for k in range(0, 3000, 1000) for n in order[k : k + 1000]}
    links, found = spark.createDataFrame(rows, "a long, b long"), []
    for most in (components.TOGETHER, 40):  # with few left, at once; else by rounds until few are left
        monkeypatch.setattr(components, "TOGETHER", most)
        spark.sparkContext.setJobGroup(f"links {most}", "")
        assert {r.node: r.component for r in components.components(links).collect()} == least
        found.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"links {most}")))
    spark.sparkContext.setJobGroup("", "")
    assert found[0] <= 8 and components.components(links.limit(0)).count() == 0
    assert {r.node: r.component for r in components.components(links, stored=True).collect()} == least


def brute_components(texts):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := [x.decode() for x in (t or "").encode().lower().split()]) else set() for k, t in enumerate(texts)}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def test_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"W{k}" if k % 3 else f"é{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A  b c\td e"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w + passage if rng.random() < 0.3 else w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(documents(spark, texts)).collect()}
    assert got == brute_components(texts)
    monkeypatch.setattr(jaccard_join, "BLOCK", 60)  # larger regions are dealt out in blocks, by their shingles
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(documents(spark, texts)).collect()}
    assert got == brute_components(texts)
    assert jaccard_join.link_documents(documents(spark, ["a"]).where("false")).count() == 0


@pytest.mark.parametrize("edits", [5, 60])
def test_region_recursion_is_exact(monkeypatch, edits):
    monkeypatch.setattr(jaccard_join, "LEAF", 40)
    rng = np.random.default_rng(edits)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 1 << 40, 150).astype(np.uint64)
        for _ in range(40):
            s = base.copy()
            k = int(rng.integers(0, edits))
            s[rng.permutation(150)[:k]] = rng.integers(0, 1 << 40, k)
            sets.append(np.unique(s))
    forest = jaccard_join.Forest(len(sets))
    for a, b in itertools.combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if jaccard_join.linked(n, len(sets[a]), len(sets[b])):
            forest.link(a, b)
    want = sorted((k, forest.root(k)) for k in range(len(sets)) if forest.root(k) != k)
    assert sorted(jaccard_join.join_sets(list(range(len(sets))), sets)) == want


def test_shingles_of_many_texts():
    """Together as alone, whatever stands beside them, and in about the time that new words take to be split."""
    pa = pytest.importorskip("pyarrow")
    texts = [*ODD_TEXTS, *random_texts(500), "a\0", "abcdefg", "abcdefg\x07", *("x" * n for n in (7, 8, 9, 15, 16, 17, 60)), "W" * 20]
    keys, ends = shingles.shingle_sets(pa.array(texts)[3:])
    for k, text in enumerate(texts[3:]):
        assert (keys[ends[k] : ends[k + 1]] == shingles.shingle_set(text)).all()
        w = (text or "").encode().lower().split()
        assert ends[k + 1] - ends[k] == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    rows = [" ".join(f"{rng:x}w" for rng in np.random.default_rng(k).integers(1 << 40, size=1000).tolist()) for k in range(300)]
    array, seconds = pa.array(rows), lambda run: min(_process_seconds(run) for _ in range(3))
    assert seconds(lambda: shingles.shingle_sets(array)) < 10 * seconds(lambda: [r.encode().lower().split() for r in rows])


def _process_seconds(run):
    begin = time.process_time()
    run()
    return time.process_time() - begin


def test_shingle_sizes():
    for text in random_texts(200, 9):
        w = text.encode().lower().split()
        assert len(shingles.shingle_set(text)) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)


# -- WARC ----------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    long = "é" * 600
    pages = [(1, "http://a/ b\n", long), (2, None, long), (3, "http://c/", None), (4, "http://d/", "x"), (5, "http://e/", "x"), (2, None, long), (7, "u", "y" * 999), (8, "u", "y" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("shard", F.lit("clash"))
    root = f"file://{tmp_path}/w"
    manifest = warc.write_archives(df, root, roll_bytes=300)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest, root).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = sorted([(1, 1200, sha(long), "revisit", 2), (2, 1200, sha(long), "response", None), (2, 1200, sha(long), "revisit", 2), *[(i, len((h or "").encode()), sha(h), "response", None) for i, _, h in pages if i > 2]], key=str)
    assert sorted(got, key=str) == want
    again = warc.write_archives(df, f"{root}2", roll_bytes=300)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))
    assert warc.archive(df.where("false")).count() == 0


def test_far_off_ids_make_even_shards(spark):
    ids = [*range(200), 1 << 62, -(1 << 62), 5, 5, None, None]
    pages = spark.createDataFrame([(i, f"http://x/{k}", f"page {k} " * (40 * (k % 8))) for k, i in enumerate(ids)], "page_id long, url string, html string")
    root = warc.fresh_path(spark, "warc-test")
    manifest = warc.write_archives(pages, root).collect()
    per = {r.shard: r.records for r in manifest}
    assert sum(per.values()) == len(ids) and len(per) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(per.values()) <= 2 * len(ids) / len(per)
    assert sorted(r.page_id for r in warc.read_archives(spark.read.parquet(f"{root}/manifest"), root).where("page_id is not null").collect()) == sorted(i for i in ids if i is not None)


def test_equal_payloads_far_apart_and_long(spark):
    long = "x" * 3_000_000
    pages = spark.createDataFrame([(1, "u", long), (10**15, "u", long), (500, "v", "y" * 1000), (501, "v", "y" * 1000), (7, "w", "y" * 999)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    assert got == {1: (3_000_000, "revisit", 10**15), 10**15: (3_000_000, "response", None), 500: (1000, "revisit", 501), 501: (1000, "response", None), 7: (999, "response", None)}


# -- decontamination -----------------------------------------------------------------------


def test_search_equals_all_scores():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) + ". " + " ".join(rng.choice(vocabulary) for _ in range(4)) + ".") for k in range(150)]
    index = decontaminate.ItemIndex(items)
    for _ in range(200):
        terms = index.term_ids(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50))))
        present = set(terms.tolist())
        scores = np.zeros(len(index.ids))
        for t in present:
            scores[index.lists[t][0]] += index.lists[t][1]
        want = {k for k in range(len(scores)) if scores[k] >= decontaminate.THRESHOLD - 1e-9}
        assert {k for k, _ in index.search(terms)} == want
        if want:
            assert len(index.promising(np.zeros(len(terms), dtype=np.int64), terms))


def test_leaks_are_found_and_clean_documents_stay(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "so " * 500 + items[3].upper() + " so" * 500, "en", "s", 0)], docs.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} | {(-3, 3)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == want
    left = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert left == set(texts) - {d for d, _ in want}
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("size, step", [(100, 1), (130, 1), (250, 1), (400, 1), (1000, 8), (2000, 21)])
def test_long_items_are_found_at_every_offset(size, step):
    rng = random.Random(size)
    vocabulary = [f"w{k}" for k in range(5000)]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, draw(size - 10 + k) + ". " + draw(10) + ".") for k in range(4)] + [(9, draw(20) + ". " + draw(4) + ".")]
    index = decontaminate.ItemIndex(items)
    texts = [f"{draw(offset)} {items[offset // step % 4][1]} {draw(90)}" for offset in range(0, decontaminate.BLOCK, step)]
    found = {(row, item): score for row, item, score, *_ in index.judge(texts)}
    assert set(found) == {(row, row % 4) for row in range(len(texts))}
    assert min(found.values()) > 1 - 1e-9


def test_promising_passages_hold_all_that_score():
    rng = random.Random(16)
    common = [f"c{k}" for k in range(12)]
    items = []
    for k in range(60):
        size = rng.choice([20, 40, 63, 90, 200])
        items.append((k, " ".join(rng.choice(common) if rng.random() < 0.6 else f"r{k}x{rng.randint(0, 30)}" for _ in range(size))))
    index = decontaminate.ItemIndex(items)
    block = decontaminate.BLOCK
    texts = []
    for _ in range(120):
        copied = rng.choice(items)[1].split()
        copied = sorted(copied, key=lambda w: w[0] == "r") if rng.random() < 0.5 else copied
        copied = [w for w in copied if rng.random() < 0.8]
        cut = rng.randint(0, len(copied))
        filler = [f"z{k}" for k in range(rng.randint(0, 40))]
        texts.append(" ".join([f"z{k}" for k in range(rng.randint(0, 200))] + copied[:cut] + filler + copied[cut:]))
    for text in texts:
        ids = index.term_ids(text)
        known = np.flatnonzero(ids >= 0)
        got = {tuple(x) for x in index.promising(known // block, ids[known]).tolist()}
        for span in set(index.span.tolist()):
            for start in range(len(ids) // block + 1):
                window = ids[start * block : (start + span) * block]
                scores = np.zeros(len(index.ids))
                for t in set(window[window >= 0].tolist()):
                    scores[index.lists[t][0]] += index.lists[t][1]
                if ((scores >= decontaminate.THRESHOLD) & (index.span == span)).any():
                    assert (start, span) in got


def test_shards_give_the_same_rows_and_scores(spark, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(10)
    items = [r.text for r in bench.collect()]
    docs = documents(spark, [" ".join(x.split()[k % 9 :]) for k, x in enumerate(items * 2)] + [None, "nothing here"])
    found = lambda: sorted(tuple(r) for r in decontaminate.find_leaks(docs, bench).collect())
    whole = found()
    assert len(whole) > 10
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 3)
    assert found() == whole
    assert len(decontaminate.drop_leaks(docs, bench).collect()) == docs.count() - len({r[0] for r in whole})


# -- personal data -------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                found.append((kind, *m.span()))
    return found


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    parts = list("ab.@-+ ()0123456789%_é,\n") + ["4111 1111 1111 1111", "a@b.co", "10.0.0.1", "+49 30 123456", "0000", "255."]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_disclosing_terms_and_masks(spark):
    lead = [f"filler{k} words{k} before zanzibar reach ann@corp.example later{k} on" for k in range(6)]
    texts = lead + [f"nothing to see here number {k} for anyone" for k in range(60)] + [None, ""]
    docs = documents(spark, texts)
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert all("term:" in found[k].spans and found[k].base in found[k].spans for k in range(6))
    assert all(found[k].spans == "" for k in range(6, len(texts)))
    out = {r.doc_id: r.text for r in pii.sanitise(docs, pii.find_spans(docs)).collect()}
    assert "ann@corp" not in out[0] and "zanzibar" not in out[0] and "[EMAIL]" in out[0]
    assert all(out[k] == texts[k] for k in range(6, len(texts)))
    assert pii.find_spans(docs.where("false")).count() == 0


def test_flagged_terms_are_masked_at_any_distance(spark):
    far = " ".join(f"far{k}" for k in range(30))
    texts = [f"Zanzibar, {far} {k} filler{k} zanzibar reach ann@corp.example later{k} on {far} (zanzibar)" for k in range(6)]
    texts += [f"nothing to see here number {k} for anyone" for k in range(60)]
    docs = documents(spark, texts)
    out = {r.doc_id: r.text for r in pii.sanitise(docs, pii.find_spans(docs)).collect()}
    assert all("zanzibar" not in out[k].lower() and "far15" in out[k] for k in range(6))
    assert all(out[k] == texts[k] for k in range(6, 66))


def test_entities_are_judged_however_rare(spark):
    texts = ["here zanzibar reach bob@corp.example on"] + [f"the zanzibar {k} is here" for k in range(2)] + ["here is the lone bird kiwi@corp.example on"]
    texts += [f"nothing to see here number {k} for anyone" for k in range(3000)]
    out = {r.doc_id: r.text for r in pii.sanitise(documents(spark, texts), pii.find_spans(documents(spark, texts))).collect()}
    assert "zanzibar" not in out[0] and "here" in out[0] and "bob" not in out[0]
    assert all(out[k] == texts[k] for k in [1, 2, *range(4, len(texts))])


def test_long_words_before_an_entity_are_whole():
    long = ["x" * 200 + str(k) for k in range(pii.REACH + 2)]
    text = " ".join(long) + " ann@corp.example"
    found = [x[3] for x in pii.neighbours(text, pii.base_spans(text))]
    assert found == long[-pii.REACH :]


# -- chat ----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "a:b\n", None]), rng.choice([None, "", "### x", "\\", "</turn>\n", "plain", "\\### Assistant: </turn> ok"])) for c in range(30) for t in range(rng.randint(1, 5))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(200)]
    got = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), keep_text=True).collect()}
    for c in {r[0] for r in rows}:
        turns = [((r[2] or ""), (r[3] or "")) for r in rows if r[0] == c]
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].formatted == chat_format.render(turns) and got[c].formatted_chars == len(got[c].formatted)


def test_templates_that_rewrite_history_are_told():
    with pytest.raises(chat_format.HistoryRewritten):
        chat_format.locate([("u", "a"), ("a", "b")], lambda turns: f"{len(turns)}: " + "".join(t for _, t in turns))


def test_history_rewritten_late_is_told():
    def template(turns):
        return "".join(t if len(turns) < 50 or k < 30 else t.upper() for k, (_, t) in enumerate(turns))

    chat_format.locate([("u", "a")] * 49, template)
    with pytest.raises(chat_format.HistoryRewritten):
        chat_format.locate([("u", "a")] * 60, template)


def test_chat_ties_repeats_and_clashes(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.format_conversations(chats, keep_text=True).collect()}
    assert got[1].formatted == chat_format.render([("", ""), ("user", "a"), ("user", "a"), ("user", "b")]) and got[1].n_turns == 4
    assert got[None].loss_chars == 1
    assert chat_format.format_conversations(chats.where("false")).count() == 0


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
