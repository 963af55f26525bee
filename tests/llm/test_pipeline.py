"""Each stage on nulls, repeated rows, empty tables and clashing columns, and the whole against its parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("seriesforge.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from seriesforge.llm import decontaminate, jaccard_join, language_id, pii, token_counts, trie_bpe  # noqa: E402
from seriesforge.llm.vocabulary import default_vocabulary  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)
CLASHES = ("lang_pred", "score", "ambiguous", "gone", "of", "of_key", "text_key", "spans", "marks", "stays", "base", "node")
WORDS = [f"word{k}" for k in range(400)]


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in every column, repeats, equal ids, very long and wordless texts, and clashing columns."""
    near = prose(1).split()
    near[30] = "changed"
    rows = [(1, prose(1)), (2, " ".join(near)), (3, prose(3)), (3, prose(4)), (4, prose(4)), (5, None), (5, None), (6, ""), (7, "123 ..."), (8, prose(8)), (8, prose(8)), (None, prose(9)), (10, prose(10, 40_000)), (11, "x" * 200_000), (12, None)]
    docs = spark.createDataFrame([(k, t, "en" if k != 2 else None, None if k == 1 else "s", len(t) if t else None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(-5) for c in CLASHES})


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd, name):
    out = STAGES[name](spark, odd, sf_dir)
    empty = STAGES[name](spark, odd.where("false"), sf_dir)
    assert empty.count() == 0
    if name == list(STAGES)[-1]:
        assert out.count() == odd.count() and {"doc_id", "n_tokens"} <= set(out.columns)
        return
    assert out.columns == odd.columns == empty.columns
    assert all(r[c] == -5 for r in out.collect() for c in CLASHES)


def test_near_copies_and_repeats_go(spark, sf_dir, odd):
    kept = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:12]) for r in STAGES["jaccard_join"](spark, odd, sf_dir).collect())
    # 2 is near 1, the second text of 3 stays and stands for 4, of equal rows of 5 and 8 one stays
    want = [(1, prose(1)), (3, prose(3)), (3, prose(4)), (5, ""), (6, ""), (7, "123 ..."), (8, prose(8)), (10, prose(10, 40_000)), (11, "x" * 20), (12, ""), (None, prose(9))]
    assert kept == sorted((k is None, k or 0, t[:12]) for k, t in want)


def test_texts_of_one_id_keep_their_links(spark):
    a, b = prose(21), prose(22)
    rows = [(1, a), (1, b), (2, a + " end"), (3, "start " + b)]
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.component_id) for r in jaccard_join.link_documents(spark.createDataFrame(order, "doc_id long, text string").withColumn("component_id", F.lit("clash"))).collect()]
        assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_words_of_one_pattern_have_different_keys():
    from seriesforge.llm.shingles import shingle_set

    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    assert shingle_set(one)[0] != shingle_set(other)[0]


@pytest.mark.parametrize("copies", [3, 60])
def test_large_regions_are_exact(spark, monkeypatch, copies):
    """Regions dealt out in blocks, with documents that no pivot is near, against one task."""
    rng = random.Random(copies)
    texts = []
    for base in range(4):
        words = [f"b{base}w{k}" for k in range(100)]
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            texts.append(" ".join(w + [f"common{k}" for k in range(30)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lambda: sorted(tuple(r) for r in jaccard_join.link_documents(docs).collect())
    whole = got()
    monkeypatch.setattr(jaccard_join, "BLOCK", 500)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    assert got() == whole


def test_codewords_mend_wrong_bits():
    """Loss-weighted decoding finds the language although a bit of its codeword is predicted wrongly."""
    n = 9
    code = language_id.codewords(n)
    model = language_id.EcocModel([f"l{k}" for k in range(n)], code, np.zeros((1, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1], dtype=np.float32))
    for k in range(n):
        for bit in range(code.shape[1]):
            margins = 3.0 * code[k : k + 1].copy()
            margins[0, bit] *= -1
            best, near = language_id.decode(model, margins)
            assert best[0] == k and near[0] > 0.5
    best, near = language_id.decode(model, np.zeros((1, code.shape[1])))
    assert near[0] < language_id.CLEAR  # all codewords are equally near


def test_many_languages_learn_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 40)
    rows = [(k, " ".join(f"{chr(97 + k % 8)}{chr(97 + k % 8)}{j % 5}x" for j in range(30)), f"l{k % 8}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rank", F.lit("clash"))
    assert language_id.sample_labelled(docs, "lang", F.lit(True)).count() == 40
    out = language_id.identify(docs, language_id.train(docs, F.lit(True))).collect()
    assert sum(r.lang_pred == r.lang for r in out) > 0.9 * len(out)


def test_other_operators_on_odd_tables(spark, sf_dir, odd):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = bench.where("text is not null").first()
    leaky = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(20, item.text, -5), (20, item.text, -5)], "doc_id long, text string, score int"))
    assert sorted(r.doc_id for r in decontaminate.find_leaks(leaky, bench.withColumn("score", F.lit(1))).where(F.col("item_id") == item.item_id).collect()) == [20, 20]
    spans = pii.find_spans(odd)
    assert spans.count() == odd.count() and pii.find_spans(odd.where("false")).count() == 0
    for frame in (trie_bpe.encode_documents(odd, default_vocabulary()), token_counts.count_tokens(odd, default_vocabulary())):
        assert frame.count() == odd.count()
    assert trie_bpe.encode_documents(odd.where("false"), default_vocabulary()).count() == token_counts.count_tokens(odd.where("false"), default_vocabulary()).count() == 0


def brute_flagged(texts, support, disclosure):
    """Disclosing (entity, term) pairs by counting everything."""
    n, beside, df = len(texts), {}, {}
    for d, text in enumerate(texts):
        for t in {pii._clean(w) for w in pii._WORD.findall(text)}:
            df[t] = df.get(t, 0) + 1
        for entity, _, _, term, *_ in pii.neighbours(text, pii.base_spans(text)):
            beside.setdefault(entity, {}).setdefault(term, set()).add(d)
    found = {}
    for entity, terms in beside.items():
        edf = len({d for text_d, text in enumerate(texts) for d in [text_d] if any(x[0] == entity for x in pii.neighbours(text, pii.base_spans(text)))})
        for term, docs in terms.items():
            if df[term] >= support and n > edf:
                share = np.log2(n * len(docs) / (edf * df[term])) / np.log2(n / edf)
                if share >= disclosure:
                    found[entity, term] = share
    return found


def test_flagged_terms_equal_brute_force(spark):
    rng = random.Random(31)
    people = [f"p{k}@corp.example" for k in range(12)]
    texts = []
    for k in range(400):
        words = [rng.choice(WORDS[:60]) for _ in range(rng.randint(5, 40))]
        if rng.random() < 0.4:
            who = rng.randrange(12)
            words[rng.randrange(len(words))] = f"{people[who]} name{who}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = pii.scan(docs).where("kind = 1")
    got = {(r.entity, r.term): r.share for r in pii.disclosing(near, docs, len(texts)).collect()}
    want = brute_flagged(texts, pii.SUPPORT, pii.DISCLOSURE)
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pipeline_equals_its_stages_by_hand(spark, sf_dir):
    """What each stage drops follows from the operators' own results on its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = corpus_pipeline.written(STAGES["language_id"](spark, docs, sf_dir), "test")
    judged = language_id.identify(docs, language_id.train(docs, ~language_id.held_out())).collect()
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= 0.5}
    alone = corpus_pipeline.written(STAGES["jaccard_join"](spark, known, sf_dir), "test")
    assert {r.doc_id for r in alone.collect()} == {r.doc_id for r in jaccard_join.link_documents(known).collect() if r.doc_id == r.component_id}
    clean = corpus_pipeline.written(STAGES["decontaminate"](spark, alone, sf_dir), "test")
    leaks = {r.doc_id for r in decontaminate.find_leaks(alone, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in alone.collect()} - leaks and leaks
    masked = {r.doc_id: r for r in STAGES["pii"](spark, clean, sf_dir).collect()}
    spans = {r.doc_id: r.spans for r in pii.find_spans(clean).collect()}
    assert all(masked[r.doc_id].text == pii.mask(r.text, spans[r.doc_id]) for r in clean.collect())
    assert all(not pii.base_spans(r.text) for r in masked.values())
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(masked)
