"""The registered corpus queries without SQL, on the smallest tables, against
plain versions, an exact round trip or held-out accuracy."""
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from equitylake.llm import secrets
from equitylake.llm.queries import QUERIES
from test_operators import plain_spans, split

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_columns(spark):
    expected = {
        "op2_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        "op3_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                  "base_score double, score double",
        "op4_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op6_ann": "query_id bigint, rank int, vec_id bigint, score double",
        "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                       "sequence_id bigint, offset bigint",
        "op8_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op9_neardup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
        "op10_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op11_lines": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
        "op12_ranked": "item_id bigint, rank int, doc_id bigint, score bigint",
        "op13_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                       "cost bigint, audit string, repaired_sha256 string",
    }
    for name, columns in expected.items():
        types = dict(QUERIES[name](spark, SF).dtypes)
        for c in columns.split(", "):
            column, kind = c.split()
            assert types.get(column) == kind, (name, c, types)


def test_secrets_query(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op2_secrets"](spark, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        spans = plain_spans(d.text or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_lm_query(spark, documents):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {d.doc_id: [w.translate(low) for w in split(d.text)] + [None] for d in documents}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c, pair, context = Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            c.update(t)
            pair.update(zip(["start", *t], t))
            context.update(["start", *t][:-1])
    n, v = sum(c.values()), len(c)
    better = []
    for r in QUERIES["op3_lm"](spark, SF).collect():
        t = tokens[r.doc_id]
        p = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        s = sum(math.log10((pair[a, b] + 20 * q) / (context[a] + 20)) for a, b, q in zip(["start", *t], t, p))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(map(math.log10, p)), rel_tol=1e-9)
        assert math.isclose(r.score, s, rel_tol=1e-9)
        if r.held_out:
            better.append((r.score, r.base_score))
    assert sum(s for s, _ in better) > sum(b for _, b in better)  # on texts it has not seen


def test_packing_query(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {d.doc_id: np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4") for d in documents}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op7_packing"](spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at
            at += length
        assert at == len(x)
    pad = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad < 0.02 * sum(map(len, ids.values()))


def test_language_query(spark, documents):
    lang = {d.doc_id: d.lang for d in documents}
    held = [r for r in QUERIES["op10_langid"](spark, SF).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95


def test_toxicity_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    clean = [got[i].predicted for i, t in labels.items() if not t and got[i].held_out]
    assert np.mean(clean) <= 0.05
