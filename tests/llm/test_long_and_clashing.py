"""Every operator on a text above the size of a chunk, and on tables whose extra
columns have the names that operators use inside."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from equitylake.llm import ann, common, jaccard, langid, lm, mixing, neardup, packing, secrets, substring, toxicity

NAMES = ("row", "chunk", "key", "size", "target", "copies", "id", "n", "text_", "doc", "src", "part", "place", "label_", "grams",
         "bands", "cluster", "unit", "words", "spans", "score_", "lang_", "rest", "c0", "c1", "bucket", "keys", "norm", "code",
         "list", "nth", "like", "node", "root", "a", "b", "fold", "row_", "counts", "model", "pair", "rank", "query_id")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in NAMES if c not in df.columns})


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    words = rng.choice(vocabulary, 700_000).tolist()
    near = [*words[:-3], "other", "words", "here"]
    small = [" ".join(rng.choice(vocabulary, 30)) for _ in range(12)]
    assert len(" ".join(words)) > common.CHUNK_BYTES
    texts = [" ".join(words), " ".join(near), *small, None, "", " ".join(words[100:160])]
    return [(i, t, "en" if i % 2 else "fr", f"s{i % 3}") for i, t in enumerate(texts)], words


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows[0], "doc_id long, text string, lang string, source string").repartition(3)).cache()


def test_jaccard(docs):
    got = {r.doc_id: r for r in jaccard.join(docs).collect()}
    assert got[0].n_links == got[1].n_links == 1 and got[1].component_id == 0
    assert all(got[i].n_links == 0 for i in range(2, 17))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, *range(2, 17)]


def test_secrets(spark, rows):
    text = "é " + rows[0][0][1] + " token=abcdef123456"
    df = clashing(spark.createDataFrame([(1, text), (2, "token=abcdef123456")], "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    at = text.index("token=")
    assert got[1].spans.split(",")[-1] == f"assign:{at}:{len(text)}" and got[2].spans == "assign:0:18"
    clean = {r.doc_id: r for r in secrets.redacted(df).collect()}
    assert clean[1].text == text[:at] + "[REDACTED]" and clean[1].chunk == "clash"


def test_lm(docs, rows):
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert got[0].n_tokens == len(rows[1]) + 1 and got[14].n_tokens == got[15].n_tokens == 1 and len(got) == 17


def test_substring(docs, rows):
    got = {r.doc_id: r for r in substring.dedup(docs).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed == len(rows[1]) - 3  # all but the changed words
    assert (got[16].n_words, got[16].n_removed) == (60, 60)


def test_toxicity_and_language(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(17)], "doc_id long, quality long, toxic long")
    scored = toxicity.score(docs, toxicity.train(docs, clashing(labels))).collect()
    assert len(scored) == 17 and all(0 <= r.score <= 1 for r in scored)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert len(got) == 17 and got[14] == got[15] == "und" and got[0] in ("en", "fr")
    assert langid.keep_identified(docs).columns == docs.columns


def test_packing_and_mixing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    ids = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode(
        rows[0][0][1], add_special_tokens=False).ids + [1]
    pieces = sorted((r.start, r.length, r.ids_crc32) for r in packing.pack(docs).where("doc_id = 0").collect())
    at = 0
    for start, length, crc in pieces:
        assert start == at and crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
        at += length
    assert at == len(ids)
    mixed = mixing.mix_sources(docs)
    assert {r.doc_id: r["size"] for r in mixed.select("doc_id", "size").collect()}[0] == len(rows[1])
    assert mixed.select("doc.*").columns == docs.columns


def test_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v[30:] = v[:30] + 1e-6
    df = clashing(spark.createDataFrame([(i, "x", [float(e) for e in x]) for i, x in enumerate(v)],
                                        "vec_id long, label string, embedding array<double>"))
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    assert all(got[i + 30].component_id == got[i].component_id for i in range(30))
    found = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    for q in (0, 20, 40):
        scores = sorted(((float(v[q] @ v[i]), -i) for i in range(60) if i != q), reverse=True)[:20]
        assert [r.vec_id for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == [-i for _, i in scores]
