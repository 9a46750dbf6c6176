"""Line dedup, ranked search and conversation repair against plain versions:
nulls, empty and very long texts, ties, repeated rows, empty tables, columns with
the names the operators use inside."""
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equitylake.llm import lines, ranked, repair

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string"
CLASH = ("doc", "t1", "h1", "gone", "n", "batch", "key", "first", "seen", "nth", "item", "score", "df", "rank", "part",
         "seg", "flags", "like", "copy", "draw", "edge")


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


# --- 11: line dedup

def lines_plain(rows, least=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    first = {}
    for i, t in rows:
        for k in map(key, (t or "").split("\n")):
            if len(k) >= least and i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not (key(x) in first and (i is None or i > first[key(x)]))]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(n, seed):
    rng = random.Random(seed)
    pool = [f"common line number {k}" + " é" * (k % 3) for k in range(30)] + ["short", "", " \t ", "123456789", "1234567890"]
    rows = []
    for i in range(n):
        some = [rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randint(0, 9))]
        some = [x.upper() if rng.random() < 0.2 else "  " + x + "\r" if rng.random() < 0.2 else x for x in some]
        rows.append((rng.choice([i, i, i, i // 3, None]), "\n".join(some)))
    return rows + [(5, None), (None, None), (6, ""), (7, "\n"), (7, "ÀÉ CAPITALS stay\nàé capitals stay"),
                   (8, "ÀÉ CAPITALS stay")] + [(9, "the same row again")] * 3


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    rows = line_rows(120, batches)
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(5))
    got = lines.dedup(df, batches=batches, fanout=fanout)
    assert got.select("doc.*").columns == df.columns
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str) == lines_plain(rows)


def test_lines_hot_keys_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_KEYS", 3)  # some keys by broadcast, the rest by shuffle
    long_text = "\n".join(f"line {k % 40_000} of a very long text, of which some recur" for k in range(90_000))
    assert len(long_text) > 4 << 20
    rows = line_rows(60, 3) + [(1000, long_text), (1001, "line 7 of a very long text, of which some recur\nmine alone it is")]
    rows += [(2000 + k, "a line that a third of all documents hold") for k in range(40)]
    got = lines.dedup(spark.createDataFrame(rows, DOCS), carry=[])
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str) == lines_plain(rows)


def test_lines_index_takes_batches_as_they_come(spark):
    index = lines.LineIndex(spark, fanout=2)
    seen, held = set(), []
    for b in range(6):
        rows = [(b * 10 + k, f"line that recurs {k * b % 7}\nline of batch {b} and {k}") for k in range(5)]
        r = lines.rows_of(spark.createDataFrame(rows, DOCS))
        out = {x.doc_id: x.text for x in lines.drop_lines(r, index.add(lines.lines_of(r))).collect()}
        fresh = set()
        for i, t in rows:
            kept = [x for x in t.split("\n") if x not in seen and x not in fresh]
            fresh |= set(t.split("\n"))
            assert out[i] == "\n".join(kept)
        seen |= fresh
        held.append([len(level) for level in index.levels])
    assert held == [[1], [2], [1, 1], [2, 1], [1, 0, 1], [2, 0, 1]]
    runs = [r for level in index.levels for r in level]
    assert sum(r.count() for r in runs) == len(seen)  # every hash in one run only
    names = list(index.names)
    index.close()
    assert names and not any(spark.catalog.tableExists(n) for n in names)


def test_lines_runs_are_merged_without_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lines.LineIndex, "close", lambda self: None)
    index = lines.LineIndex(spark)
    rows = lines.rows_of(spark.createDataFrame(line_rows(50, 1), DOCS))
    index.add(lines.lines_of(rows))
    run = index.levels[0][0]
    batch = lines.lines_of(rows).groupBy("h1", "h2").count()
    plan = batch.join(run.hint("merge"), ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount" in plan
    assert plan.count("Exchange hashpartitioning(h1") == 1  # the batch's own aggregation


def test_lines_empty(spark):
    assert lines.dedup(spark.createDataFrame([], DOCS)).count() == 0
    one = lines.dedup(spark.createDataFrame([(None, None)], DOCS)).first()
    assert (one.doc_id, one.text, one.n_lines, one.n_dropped) == (None, "", 1, 0)


# --- 12: ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_plain(items, docs, k=10):
    words = [TERM.findall((t or "").translate(LOW)) for _, t in docs]
    n, length = sum(map(bool, words)), sum(map(len, words))
    tf = [Counter(w) for w in words]
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        terms = TERM.findall((text or "").translate(LOW))
        for (doc, _), c, w in zip(docs, tf, words):
            s = 0
            for t in terms:
                if t in c:
                    m = 25 + (75 * len(w) * n) // length
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    s += weight * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def ranked_docs(n, seed):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["Été", "naïve", "日本", "x1", "UPPER", "a_b", "it's"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 40)))) for i in range(n)]
    rows += [(rng.randrange(n), rows[k][1]) for k in range(20)]  # ties, repeated ids
    return rows + [(None, rows[3][1]), (None, rows[3][1]), (900, None), (901, ""), (902, "... --- ..."), (903, "w1"), (904, "w1")]


def test_ranked(spark, monkeypatch):
    monkeypatch.setattr(ranked, "TILE_TERMS", 7)
    docs = ranked_docs(150, 1)
    items = [(1, "w1 w2 w3 w3 W3 été"), (2, None), (3, ""), (4, "unknown words only"), (5, "it s naïve 日本 a b"),
             (6, docs[3][1]), (6, docs[3][1]), (None, "w5 upper w6"), (7, " ".join(t for _, t in docs[:20] if t))]
    df = clashing(spark.createDataFrame(docs, DOCS).repartition(6))
    got = ranked.search(clashing(spark.createDataFrame(items, "item_id long, text string")), df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked_plain(items, docs)


def test_ranked_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 2)
    docs, items = ranked_docs(40, 2), [(k, f"w{k} w{k + 1} w{k + 2} w{k}") for k in range(5)]
    assert [len(b) for b in ranked.item_blocks(spark.createDataFrame(items, DOCS.replace("doc", "item")), 2)] == [2, 2, 1]
    got = ranked.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, DOCS), k=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked_plain(items, docs, 3)


def test_ranked_very_long_texts(spark):
    docs = [(1, "alpha beta " * 400_000 + "gamma"), (2, "alpha gamma"), (3, "z" * 3_000_000 + " beta"), (4, "beta")]
    assert len(docs[0][1]) > 4 << 20
    items = [(1, "alpha beta gamma"), (2, "beta " * 2000 + "z" * 3_000_000)]
    got = ranked.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, DOCS))
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked_plain(items, docs)


def test_ranked_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(items, docs).count() == 0
    assert ranked.search(items.where("false"), spark.createDataFrame([(1, "a")], DOCS)).count() == 0
    assert ranked.search(items, spark.createDataFrame([(1, None), (2, "")], DOCS)).count() == 0


def test_tiles_stay_exact():
    """No item's weights in a tile, times the largest impact, reach 2**53; the tiles add up to the weights."""
    v = ranked.Vocabulary(["rare " * 2_000_000 + "other", "rare other"])
    tiles = ranked.Tiles(v, 10 ** 6, np.array([1, 5]), most_terms=2).tiles
    total = Counter()
    for terms, item, column, weight in tiles:
        per_item = np.bincount(item, weights=weight)
        assert (per_item * ranked.MOST_IMPACT < ranked.EXACT).all()
        for i, c, w in zip(item.tolist(), column.tolist(), weight.tolist()):
            total[i, int(terms[c])] += int(w)
    w = {d: math.floor(1000 * math.log((2 * 10 ** 6 + 2) / (2 * d + 1))) for d in (1, 5)}
    assert len(tiles) > 2
    for i, (terms, counts) in enumerate(v.items):
        for t, c in zip(terms.tolist(), counts.tolist()):
            assert total[i, t] == c * w[(1, 5)[t]]


def test_terms():
    texts = ["Ab1 c-d", None, "", "é", "éa_日本", "tail", "head"]
    hashes, first = ranked.terms_of(pa.array(texts))
    expected = [TERM.findall((t or "").translate(LOW)) for t in texts]
    assert np.diff(first).tolist() == [len(e) for e in expected]
    assert ranked.terms_of(pa.array(["AB1", "ab1"]))[0].tolist() == [hashes[0]] * 2


# --- 13: conversation structure repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def rows_after(rows):
    """(conv_id -> damaged rows in order) of (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        draw = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        out[conv]
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            out[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for v in out.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{x[1]}:{x[2]}".encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else
                   "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """All edits in turn, no more than two insertions between rows: (cost, audit, repaired)."""
    best = None
    gaps_ = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]

    def step(k, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for more in gaps_:
            c, a, o = cost + 5 * len(more), audit + "I" * len(more), out + [f"{x}:" for x in more]
            if k == len(rows):
                if GRAMMAR.fullmatch("".join(x[:1] for x in o)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, o)
                continue
            _, role, text = rows[k]
            short = 5 * (marks[k] == "truncated")
            step(k + 1, c + 2, a + "D", o)
            if marks[k] not in ("blank", "duplicate"):
                step(k + 1, c + short, a + "K", o + [f"{role}:{text}"])
                for x in ("user", "assistant"):
                    step(k + 1, c + 1 + short, a + "R", o + [f"{x}:{text}"])
    step(0, 0, "", [])
    return best


def repair_plain(rows):
    out = []
    for conv, after in rows_after(rows).items():
        marks = faults(after)
        turns = [t for t, _, _ in after if t is not None]
        gap = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, lines_ = cheapest(after, marks) if after else (0, "", [])
        out.append((conv, gap, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines_).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n, seed, most=5):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ugly", "User"]
    texts = ["Fine.", "Good!", "Why?", "cut", "", " \n", None, "Ends. \t\n", "é", "Other one.", "More of it."]
    return [(rng.choice([c, c, c, None]) if c % 17 == 0 else c, rng.choice([k, k, k, k + 2, 0, None]),
             rng.choice(roles), rng.choice(texts)) for c in range(n) for k in range(rng.randint(1, most))]


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment_rows", [1 << 16, 2])
def test_repair(spark, segment_rows):
    rows = [r for r in conversations(130, 5) if r[0] is not None] + [(None, 1, "user", "A."), (None, 2, "tool", "B.")]
    df = clashing(spark.createDataFrame(rows, CONV).repartition(4))
    got = repair.repair(repair.damage(df), segment_rows=segment_rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == repair_plain(rows)


def test_repair_in_segments_is_the_same(spark):
    rng = random.Random(3)
    rows = [(c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "x"]),
             rng.choice([f"Text {k}.", f"cut {k}", "Again.", ""])) for c in range(3) for k in range(400)]
    rows += [(9, k, "user" if k % 2 == 0 else "assistant", "x" * 3_000_000 + f" {k}.") for k in range(3)]  # very long texts
    df = repair.damage(spark.createDataFrame(rows, CONV))
    whole = sorted(tuple(r) for r in repair.repair(df.coalesce(1)).collect())
    for size in (1, 7, 100):
        assert sorted(tuple(r) for r in repair.repair(df, segment_rows=size).collect()) == whole
    assert sorted(tuple(r) for r in repair.repair(df, segment_bytes=1 << 20).collect()) == whole
    # and against a program over rows that compares whole audits
    for conv, after in rows_after(rows).items():
        marks = faults(after)
        symbols = bytes(8 if m in ("blank", "duplicate") else 2 * ("sua".find(r[:1]) % 4) + (m == "truncated")
                        for (_, r, _), m in zip(after, marks))
        at = {0: (0, "")}
        g = repair.Grammar()
        for s in symbols:
            nxt = {}
            for i, (c, a) in at.items():
                for j in range(4):
                    if g.cost[s][i][j] < repair.INF:
                        nxt[j] = min(nxt.get(j, (repair.INF, "")), (c + g.cost[s][i][j], a + g.via[s][i][j]))
            at = nxt
        cost, audit = min((c + 5 * (0, 2, 1, 0)[j], a + "I" * (0, 2, 1, 0)[j]) for j, (c, a) in at.items())
        assert next((r[6], r[7]) for r in whole if r[0] == conv) == (cost, audit)


def test_grammar_shares_rules():
    g = repair.Grammar()
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 9, n).astype(np.uint8) for n in rng.integers(1, 60, 200)]

    def spelled(s):
        return [s] if g.pair[s] is None else spelled(g.pair[s][0]) + spelled(g.pair[s][1])
    packed = g.compress(sequences)
    assert [list(itertools.chain(*map(spelled, p))) for p in packed] == [s.tolist() for s in sequences]
    pairs = Counter()
    for p in packed:
        last = None
        for k, x in enumerate(zip(p, p[1:])):
            if not (x[0] == x[1] and last == k - 1):  # neighbours in xxx overlap
                pairs[x] += 1
                last = k if x[0] == x[1] else None
    assert max(pairs.values()) < 2
    rules = len(g.pair)
    g.compress(sequences)
    assert len(g.pair) == rules  # found again


def test_repair_edges(spark):
    empty = spark.createDataFrame([], CONV)
    assert repair.repair(repair.damage(empty)).count() == 0
    gone = next((c, 0, "user", "x.") for c in range(100) if zlib.crc32(b"%d:0" % c) % 20 == 0)
    got = repair.repair(repair.damage(spark.createDataFrame([gone], CONV))).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
