"""The training-data operators against plain versions, and on nulls, empty and long texts, ties, repeats, empty tables."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import compare
from pyspark.sql import functions as F

from matrel import llm
from matrel.llm import boosting, chunks, common, embeddings, lm_scoring, mixing, pieces, quality, simhash, suffix_dedup, token_counts, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, extra string, __id int"


def docs_of(spark, rows):
    """Documents with further columns, one of a name that the operators might use themselves."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)


def prose(rng, n, words=40):
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "su", "to") for b in ("n", "r", "s", "ta", "va")]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) + "." for _ in range(n)]


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(llm.queries()[name](spark, sf), llm.oracle_sql()[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, name):
    df = llm.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() == 200 and df.select("doc_id").distinct().count() == 200


# ---- 1 ------------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    big = "é" * 80
    rows = [(3, "http://a b/\n", big), (1, None, big), (2, "u", "tiny"), (5, "u", "tiny"), (4, "u", None), (None, "u", big), (6, "u", "y" * 300_000), (6, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, digest int")
    folder, index = warc.write_archives(pages, frame_bytes=2000, bundle_bytes=4000)
    got = warc.read_archives(spark, folder, index).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and index.count() == len(rows)
    assert (by[1]["record_type"], by[3]["record_type"], by[3]["refers_to"]) == ("response", "revisit", 1)
    assert by[None]["refers_to"] == 1 and by[2]["record_type"] == by[5]["record_type"] == "response"
    for i, _, html in rows:
        raw = (html or "").encode()
        assert by[i]["payload_bytes"] == len(raw) and by[i]["payload_digest"] == hashlib.sha256(raw).hexdigest()
    assert by[1]["payload"].decode() == big and by[4]["payload"] == b""
    for e in index.collect():  # random access by the index
        head, block = warc.read_record(folder, e)
        assert head["WARC-Record-ID"] == f"<{e['record_id']}>"
    names = [r["bundle"] for r in index.select("bundle").distinct().collect()]
    store, root = warc._open(f"{folder}/bundles")
    for n in names:
        with store.open_input_file(f"{root}/{n}") as f:
            data = f.read()
        frames = warc.read_seek_table(data)
        assert sum(c for c, _ in frames) + 8 + 8 * len(frames) + 9 == len(data)
    folder, index = warc.write_archives(pages.limit(0))
    assert warc.read_archives(spark, folder, index).count() == 0


# ---- 2 ------------------------------------------------------------------------------------------------------------------


def removed(rows, length=50):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = True
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(0, 400))) for _ in range(10)]
    rows = []
    for i in range(60):
        cuts = [(rng.choice(base), rng.randrange(0, 200), rng.randrange(0, 150)) for _ in range(rng.randrange(0, 6))]
        rows.append((i if rng.random() < 0.95 else None, "".join(b[a : a + n] for b, a, n in cuts) if rng.random() < 0.97 else None))
    rows += rows[:5] + [(200, "x" * 3000), (201, "x" * 49), (202, "x" * 60), (203, "\0" * 70), (204, "\0" * 69 + "a"), (205, "")]
    for batch in (suffix_dedup.BATCH, 150):
        assert sorted(map(tuple, suffix_dedup.remove_repeats(docs_of(spark, rows), batch=batch).collect()), key=str) == removed(rows)
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    out = suffix_dedup.remove_repeats(docs_of(spark, rows), with_text=True, carry=("extra", "__id")).collect()
    assert {r["carried_extra"] for r in out} == {"x"} and all(r["n_removed"] or r["kept_text"] == dict(rows).get(r["doc_id"], r["kept_text"]) for r in out if r["doc_id"] in range(200, 206))


def test_suffix_levels():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 3000).astype(np.uint8)
    levels, seen = suffix_dedup.SuffixLevels(text, 8), {}
    for batch in range(40):
        at = rng.integers(0, 2990, rng.integers(1, 60 if batch % 7 else 500))
        ids = np.sort(rng.integers(batch * 2, batch * 2 + 2, len(at)))
        owner = levels.scan(at, ids)
        rows = [text[x : x + 8].tobytes() for x in at.tolist()]
        for row, i in zip(rows, ids):
            seen[row] = min(seen.get(row, i), i)
        assert [seen[r] for r in rows] == owner.tolist()
        sizes = [len(k) for k, _ in levels.levels]
        assert all(a.bit_length() > b.bit_length() for a, b in itertools.pairwise(sizes))
        for level, _ in levels.levels:  # in the order of their suffixes
            assert [text[x : x + 8].tobytes() for x in level] == sorted(text[x : x + 8].tobytes() for x in level)
    assert sum(sizes) == len(seen) and levels.merged > 5 and levels.matched > 100


def test_query_meets_and_merges_levels(spark, monkeypatch):
    """A group of the query at sf0.1 has several batches: later ones find suffixes in levels of earlier ones."""
    sf, seen = "/root/testdata/sf0.1", []
    docs = common.read_table(spark, sf, "documents")
    table = chunks.write_chunks(docs)
    groups = chunks.groups_of(table)
    asked = chunks.ask(table, None, lambda c, _: suffix_dedup._Asked(c, groups, 50).anchor_rows(), chunks.ANSWER)
    shared = common.materialize(asked.groupBy("grp").applyInArrow(suffix_dedup._anchor_answers, chunks.ANSWER), "anchors")

    def runs(chunk, answers):
        x = suffix_dedup._Asked(chunk, groups, 50)
        x.shared(answers)
        return x.segment_rows()

    rows = chunks.ask(table, shared, runs, "chunk long, grp int, ids binary, sizes binary, data binary").where("grp = 0").toArrow()
    plain = suffix_dedup.SuffixLevels

    class Spy(plain):
        def __init__(self, *a):
            super().__init__(*a)
            seen.append(self)

    monkeypatch.setattr(suffix_dedup, "SuffixLevels", Spy)
    suffix_dedup._owner_answers(50, suffix_dedup.BATCH)(rows)
    assert seen[0].matched > 0 and (len(seen[0].levels) > 1 or seen[0].merged > 0)


@pytest.mark.parametrize("length", [24, 50, 79])
def test_index_takes_rival_windows(length, monkeypatch):
    """Of runs whose anchors have chance company the index gets few windows, and all that another run holds."""
    rng = random.Random(length)
    common = ["".join(rng.choice("abcdefgh") for _ in range(16 + i % 3 * 9)) for i in range(40)]
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passages = [text(120) for _ in range(4)]
    data = "".join(text(60) + rng.choice(common) + (rng.choice(passages) if i % 20 == 0 else "") for i in range(1500)).encode()
    first, size, h = suffix_dedup.window_runs(data, np.array([0]), np.array([len(data)]), length)
    ids = {}
    for a, n in zip(first.tolist(), size.tolist()):
        ids.setdefault(data[a : a + n + length - 1], len(ids))
    segs, sizes = list(ids), np.array([len(s) - length + 1 for s in ids])
    start = np.cumsum(sizes + length - 1) - (sizes + length - 1)
    bits = suffix_dedup.rival_windows(np.frombuffer(b"".join(segs), np.uint8), start, sizes, length)
    held = collections.defaultdict(set)
    for i, s in enumerate(segs):
        for j in range(int(sizes[i])):
            held[s[j : j + length]].add(i)
    for i, s in enumerate(segs):
        assert all(int(bits[i]) >> j & 1 for j in range(int(sizes[i])) if len(held[s[j : j + length]]) > 1)
        assert int(bits[i]) >> int(sizes[i]) == 0
    scanned, plain = [], suffix_dedup.SuffixLevels.scan
    monkeypatch.setattr(suffix_dedup.SuffixLevels, "scan", lambda self, at, who: scanned.append(len(at)) or plain(self, at, who))
    rows = pa.table({"chunk": [0], "grp": [0], "ids": [np.arange(len(segs)).tobytes()], "sizes": [sizes.astype(np.uint8).tobytes()], "data": [b"".join(segs)]})
    got = np.frombuffer(suffix_dedup._owner_answers(length, 500)(rows)["value"][0].as_py(), np.uint64)
    assert [[int(x) >> j & 1 for j in range(n)] for x, n in zip(got, sizes.tolist())] == [[int(min(held[s[j : j + length]]) == i) for j in range(len(s) - length + 1)] for i, s in enumerate(segs)]
    assert len(scanned) > 1 and sum(scanned) < 0.5 * sizes.sum()


# ---- 3 ------------------------------------------------------------------------------------------------------------------


def test_quality():
    rng = random.Random(1)
    clean = "\n".join(prose(rng, 5))
    assert quality.judge(clean)[8]
    nav = "\n".join("home | about | contact" for _ in range(30))
    n, chars, symbols, dup, repeat, base, lines, lost, kept, text = quality.judge(nav)
    assert (n, symbols, dup, base, kept) == (150, 60, 29, True, False)
    menu = "\n".join(f"{a} | {b} | page {i}" for i, (a, b) in enumerate(itertools.permutations("abcdefghijk", 2)))
    assert quality.judge(menu)[8:] == (False, "")
    mixed = clean + "\nAll rights reserved."
    assert quality.judge(mixed)[8:] == (True, clean)
    assert quality.judge(None)[:6] == (0, 0, 0, 0, 0, True) and quality.judge("\n \t\n")[0] == 0
    assert quality.judge("a b c")[0] == 2  # a no-break space parts no words
    words = "a b c d a b c x".split()
    assert quality.repeat_words(words) == 6 and quality.repeat_words(["z"] * 5) == 5 and quality.repeat_words([]) == 0


def test_quality_rows(spark):
    rows = [(1, None), (1, ""), (None, "a.\n" * 5000), (2, "x " * 200_000)]
    out = quality.clean_lines(docs_of(spark, rows)).collect()
    assert len(out) == 4 and not any(r["kept"] for r in out)
    assert quality.clean_lines(docs_of(spark, [])).count() == 0


# ---- 4 ------------------------------------------------------------------------------------------------------------------


def test_longest_match():
    rng = random.Random(1)
    for _ in range(1500):
        made = {tuple(rng.choice([0, 1, token_counts.END]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))}
        made = {tuple(x for i, x in enumerate(p) if x != token_counts.END or i == len(p) - 1) for p in made}
        word = bytes(rng.choice([0, 1]) for _ in range(rng.randrange(0, 8)))
        assert token_counts.LongestMatch(sorted(made)).count(word) == token_counts.greedy_count(word, made)


def test_token_counts(spark):
    vocabulary = token_counts.load_vocabulary()
    known = set(vocabulary)
    rows = [(1, "The quick ☃ antidisestablishmentarianism!"), (2, None), (3, ""), (1, " \n"), (None, "z" * 5000)]
    out = {(r["doc_id"], r["n_words"]): r["n_tokens"] for r in token_counts.token_counts(docs_of(spark, rows), vocabulary).collect()}
    for i, t in rows:
        words = WORD.findall((t or "").lower())
        assert out[i, len(words)] == sum(token_counts.greedy_count(w.encode(), known) for w in words)


# ---- 5 ------------------------------------------------------------------------------------------------------------------


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + rng.normal(size=8) * 0.09).tolist(), i % 2) for i in range(240)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 0), (304, [0.0] * 8, 0), (305, [float("nan")] + [1.0] * 7, 0), (306, [None] + [1.0] * 7, 0), (307, [], 0), (308, [1.0, 2.0], 0), (309, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, rep int").repartition(4)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 30)
    monkeypatch.setattr(embeddings, "CELL_ROWS", 20)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    fit = [(i, np.array(v), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = collections.defaultdict(set)
    for (i, a, p), (j, b, q) in itertools.combinations(fit, 2):
        if p == q and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
            links[i].add(j)
            links[j].add(i)
    assert sum(map(len, links.values())) > 300
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min(seen) if i is not None else None
        assert got[i] == (len(links[i]), low, i is None or low == i), i
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# ---- 6 ------------------------------------------------------------------------------------------------------------------


def test_lm_scoring(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(prose(rng, 40, 30))] + [(100, None), (101, ""), (None, "kan lor"), (5, "MIS mis \n mis")]
    target = {0, 3, 5, 8}
    for vocabulary in (65_000, 12):
        got = lm_scoring.score_documents(docs_of(spark, rows), spark.createDataFrame([(i,) for i in target] + [(None,)], "i long"), vocabulary, leave_out=False).collect()
        tokens = [(i, (t or "").lower().split()) for i, t in rows]
        n = collections.Counter(w for _, x in tokens for w in x)
        top = set(sorted(n, key=lambda w: (-n[w], w))[:vocabulary])
        ends = lambda x: ["</>", *(w if w in top else "<unk>" for w in x), "</>"]
        losses = []
        for own in (target, None):
            pairs, single = collections.Counter(), collections.Counter()
            for i, x in tokens:
                if own is None or i in own:
                    y = ends(x)
                    pairs.update(zip(y, y[1:]))
                    single.update(y[1:])
            size = sum(single.values())
            p = lambda w, s=single, z=size: (s[w] + 1) / (z + len(top) + 2)
            losses.append([-sum(math.log((pairs[v, w] + lm_scoring.MASS * p(w)) / (single[v] + lm_scoring.MASS)) for v, w in itertools.pairwise(ends(x))) / (len(x) + 1) for _, x in tokens])
        want = sorted(((i, len(x), a, b, b - a) for (i, x), a, b in zip(tokens, *losses)), key=str)
        for a, b in zip(sorted(map(tuple, got), key=str), want):
            assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=1e-9)
    assert lm_scoring.score_documents(docs_of(spark, []), spark.createDataFrame([], "i long"), leave_out=False).count() == 0


def test_lm_scoring_knows_every_word(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{(i * 720 + k) % 72_000}" for k in range(1440))) for i in range(100)] + [(200, f"w1 w71999 w{rng.randrange(72_000)}")]
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs_of(spark, rows), spark.createDataFrame([(3,), (50,)], "i long"), leave_out=False).collect()}
    ends = lambda t: ["</>", *t.split(), "</>"]
    n = len({w for _, t in rows for w in t.split()})
    assert n == 72_000
    for own, name in (({3, 50}, "target_loss"), (set(dict(rows)), "background_loss")):
        pairs = collections.Counter(p for i, t in rows if i in own for p in itertools.pairwise(ends(t)))
        single = collections.Counter(w for i, t in rows if i in own for w in ends(t)[1:])
        total = sum(single.values()) + n + 2
        for i, t in rows:
            want = -np.mean([math.log((pairs[v, w] + lm_scoring.MASS * (single[w] + 1) / total) / (single[v] + lm_scoring.MASS)) for v, w in itertools.pairwise(ends(t))])
            assert abs(got[i][name] - want) < 1e-9


def test_lm_leaves_a_target_document_out_of_its_own_model(spark):
    rng = random.Random(21)
    rows = list(enumerate(prose(rng, 25, 30))) + [(40, "ka ka ka"), (41, ""), (42, None), (43, "only here only here"), (None, "ka")]
    df, ids = docs_of(spark, rows), [2, 5, 40, 41, 42, 43]
    of = lambda x: spark.createDataFrame([(i,) for i in x], "i long")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(df, of(ids)).collect()}
    whole = {r["doc_id"]: r for r in lm_scoring.score_documents(df, of(ids), leave_out=False).collect()}
    for d in ids:  # as if it had not been a target document
        without = {r["doc_id"]: r for r in lm_scoring.score_documents(df, of([i for i in ids if i != d]), leave_out=False).collect()}
        assert abs(got[d]["target_loss"] - without[d]["target_loss"]) < 1e-9 and got[d]["background_loss"] == whole[d]["background_loss"]
    assert all(got[i]["target_loss"] == whole[i]["target_loss"] for i in got if i not in ids)
    assert got[43]["target_loss"] > whole[43]["target_loss"]


# ---- 7 ------------------------------------------------------------------------------------------------------------------


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.BoostedTrees().fit(x[:400], y[:400])
    assert ((m.score(x[400:]) > 0) == y[400:]).mean() > 0.93
    iso = boosting.Isotonic().fit(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(iso.apply(np.linspace(0, 5, 20))) >= 0).all()
    assert len(boosting.BoostedTrees().fit(np.zeros((0, 2)), np.zeros(0)).score(x[:3, :2])) == 3


def test_calibration_pools_ties():
    score = np.array([-3.0] * 100 + [2.0] * 5)
    y = np.array([1.0] + [0.0] * 99 + [1.0] * 5)
    iso = boosting.Isotonic().fit(score, y)
    assert abs(iso.apply(np.array([-3.0]))[0] - 0.01) < 1e-3
    rng = np.random.default_rng(2)
    score, y = rng.integers(0, 12, 300).astype(float), rng.integers(0, 2, 300).astype(float)
    both = rng.permutation(300)
    iso, again = boosting.Isotonic().fit(score, y), boosting.Isotonic().fit(score[both], y[both])
    assert np.allclose(iso.apply(score), again.apply(score))
    at = np.unique(score)
    mean = lambda a, b: y[(score >= a) & (score <= b)].mean()
    for v in at:  # the greatest of the least means around a point
        want = max(min(mean(a, b) for b in at if b >= v) for a in at if a <= v)
        block = [x for x, w in zip(iso.x, iso.y) if abs(w - want) < 0.02]
        assert block, (v, want)


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=200) > 4).astype(float)
    m = boosting.BoostedTrees(rounds=1, depth=1, bins=64).fit(x, y)
    p = (y.sum() + 1) / 202
    g, h = y - p, np.full(200, p * (1 - p))
    best = (-1.0, -1, 0.0)
    for j in range(3):
        for cut in np.unique(x[:, j]):
            left = x[:, j] < cut
            if min(left.sum(), (~left).sum()) >= m.min_leaf:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + m.ridge) for s in (left, ~left))
                if gain > best[0] + 1e-12:
                    best = (gain, j, cut)
    feature, cut, value = m.trees[0]
    left = x[:, best[1]] < best[2]
    assert feature[1] == best[1] and ((x[:, feature[1]] >= cut[1]) == ~left).all()
    assert np.allclose(value[2:], [g[s].sum() / (h[s].sum() + m.ridge) for s in (left, ~left)])
    assert np.allclose(m.score(x), m.base + m.rate * np.where(left, value[2], value[3]))


def test_toxicity_features():
    words, stems = {"blorgh": 2.0, "zap": 3.0}, {"blorg": 1.5}
    text = "You ARE a bl0rgh! zap, one two three four five six seven blorghs sooo bad #$ ?"
    got = dict(zip(toxicity.FEATURES, toxicity.features(text, words, stems)))
    low = [w.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())) for w in text.lower().split()]
    n = len(text.split())
    hits = [i for i, w in enumerate(low) if w in words]
    stem = [i for i, w in enumerate(low) if w[:5] in stems]
    near = sum(any(low[j] in toxicity.SECOND_PERSON for j in range(len(low)) if abs(i - j) <= toxicity.NEAR) for i in sorted({*hits, *stem}))
    want = {
        "word_hits": len(hits), "word_density": len(hits) / n, "word_weight": sum(words[low[i]] for i in hits), "word_top": 3.0, "stem_hits": len(stem), "stem_density": len(stem) / n, "stem_weight": 1.5 * len(stem), "stem_top": 1.5,
        "near_second": near, "near_rate": near / n, "second_rate": 1 / n, "capitals": sum(c.isupper() for c in text) / len(text), "capital_words": sum(w.isupper() for w in text.split()) / n, "exclaim": 1 / len(text), "question": 1 / len(text),
        "symbols": sum(c in "#*$%&@" for c in text) / len(text), "mixed_rate": 1 / n, "stretched_rate": 1 / n, "hidden_hits": 1, "hidden_rate": 1 / n, "log_words": math.log1p(n), "distinct_hits": len({low[i] for i in (*hits, *stem)}),
    }
    assert set(want) == set(got) and all(abs(got[k] - v) < 1e-12 for k, v in want.items()), {k: (got[k], v) for k, v in want.items() if abs(got[k] - v) > 1e-12}
    assert toxicity.features(None, words, stems) == toxicity.features(" \n", words, stems) == [0.0] * len(toxicity.FEATURES)


def test_toxicity_lexicon(spark):
    rng = random.Random(9)
    rows = [(t + rng.choice([" zap", " zap zaps", " nil", ""]), int(i % 3 == 0)) for i, t in enumerate(prose(rng, 120, 8))]
    rows = [(t + " blorghs" if y and rng.random() < 0.8 else t, y) for t, y in rows]
    words, stems = toxicity._lexicon(spark.createDataFrame(rows, "text string, toxic int"), 3000)
    n1 = sum(y for _, y in rows)
    bare = [({w.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())) for w in t.lower().split()} - {""}, y) for t, y in rows]
    for got, terms in ((words, bare), (stems, [({w[:5] for w in s if len(w) > 5}, y) for s, y in bare])):
        want = {}
        for w in set().union(*(s for s, _ in terms)):
            c1, c0 = sum(y for s, y in terms if w in s), sum(1 - y for s, y in terms if w in s)
            odds = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (len(rows) - n1 + 1))
            if c1 >= max(toxicity.LEXICON_TEXTS, toxicity.LEXICON_SHARE * n1) and odds >= toxicity.LEXICON_ODDS:
                want[w] = odds
        assert set(got) == set(want) and all(abs(got[w] - v) < 1e-9 for w, v in want.items())
    assert "blorghs" in words and "blorg" in stems


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    r = toxicity.op7_toxicity(spark, sf).join(common.read_table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    hit = ((r.predicted == 1) & (r.toxic == 1)).sum()
    assert hit / r.toxic.sum() > 0.85 and hit / (r.predicted == 1).sum() > 0.85


def test_toxicity_edges(spark):
    rng = random.Random(4)
    texts = prose(rng, 300)
    toxic = [i % 4 == 0 for i in range(300)]
    rows = [(i, t.replace(".", " you blorgh.") if y else t) for i, (t, y) in enumerate(zip(texts, toxic))] + [(900, None), (901, ""), (None, "blorgh"), (901, "")]
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    m = toxicity.fit_toxicity(docs_of(spark, rows), labels)
    assert "blorgh" in m["words"]
    got = toxicity.score_toxicity(docs_of(spark, rows), m).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["h"] for r in docs_of(spark, [(None, "a"), (4, "b")]).select("doc_id", toxicity.held_out().alias("h")).orderBy("doc_id").collect()] == [None, zlib.crc32(b"4") % 5 == 0]
    left = {r["doc_id"] for r in toxicity.drop_toxic(docs_of(spark, rows), m).collect()}
    assert left >= {i for i, y in enumerate(toxic) if not y} and not left & {i for i, y in enumerate(toxic) if y}
    none = toxicity.fit_toxicity(docs_of(spark, []), labels.limit(0))
    assert toxicity.score_toxicity(docs_of(spark, rows), none).count() == len(rows)


# ---- 8 ------------------------------------------------------------------------------------------------------------------


def plain_mixing(rows, labelled, parts, model, targets):
    """Posteriors and rates again, in plain Python: counts of the fitting rows, then projected gradients."""
    def facts(text):
        words = WORD.findall((text or "").lower())
        size, n = max(1, len(text or "")), max(1, len(words))
        number = lambda marks: sum(c in marks for c in text or "")
        stats = (len(words), len(text or "") / n, number("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, number(mixing.MARKS) / n, number("0123456789.?") / n)
        return [sum(v > x for x in ends) for v, ends in zip(stats, mixing.BINS)], set(words), len(words)

    domains = model["domains"]
    text = {i: t for i, t in rows if i is not None}
    fit = [(d, *facts(text[i])) for i, d in labelled if i in text and d and parts[i] < 14]
    size = [sum(d == x for d, *_ in fit) for x in domains]
    prior = [math.log((n + 1) / (sum(size) + len(size))) for n in size]
    count = collections.Counter((w, d) for d, _, words, _ in fit for w in words)
    total = collections.Counter(w for _, _, words, _ in fit for w in words)
    odds = {w: [math.log((count[w, d] + mixing.PRIOR_DOCUMENTS * n / len(fit)) / (m + mixing.PRIOR_DOCUMENTS) / (n / len(fit))) for d, m in zip(domains, size)] for w, n in total.items() if n >= mixing.LEAST_DOCUMENTS}
    a, b = model["weights"]
    p, tokens = [], []
    for _, t in rows:
        bins, words, n = facts(t)
        stat = [sum(math.log((1 + sum(x[i] == v for y, x, _, _ in fit if y == d)) / (m + 10)) for i, v in enumerate(bins)) for d, m in zip(domains, size)]
        word = [sum(odds[w][k] for w in words if w in odds) / math.sqrt(max(1, len(words))) for k in range(len(domains))]
        e = [math.exp(x + a * y + b * z) for x, y, z in zip(prior, stat, word)]
        p.append([x / sum(e) for x in e])
        tokens.append(n)
    p, t = np.array(p), np.array(tokens, float)
    rate, mass = np.ones(len(rows)), t @ p
    for _ in range(model["passes"]):
        rate = np.maximum(0.0, rate - p @ (((rate * t) @ p - targets) / mass))
    return p, tokens, rate


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, (t.upper() if i % 6 == 0 else t + " deep") if i % 3 == 0 else t) for i, t in enumerate(prose(rng, 240))] + [(500, None), (501, ""), (None, "abc")]
    known = [(i, "loud" if i % 3 == 0 else "calm") for i in range(160)] + [(None, "calm"), (200, None)]
    labelled = spark.createDataFrame(known, "doc_id long, domain string")
    out, model = mixing.mix(docs_of(spark, rows), labelled, {"loud": 0.6, "calm": 0.4}, budget=1.5)
    got = out.collect()
    assert len(got) == len(rows) and min(r["rate"] for r in got) >= 0
    parts = {r["doc_id"]: r["part"] for r in spark.range(300).selectExpr("id as doc_id", "cast(pmod(xxhash64(cast(id as string), 'part'), 20) as int) as part").collect()}
    p, tokens, rate = plain_mixing(rows, known, parts, model, model["targets"])
    by = {str(i): (list(x), n, r) for (i, _), x, n, r in zip(rows, p, tokens, rate)}
    for r in got:
        x, n, want = by[str(r["doc_id"])]
        assert r["n_tokens"] == n and abs(r["rate"] - want) < 1e-9 and np.allclose([r["posteriors"][d] for d in model["domains"]], x, atol=1e-9)
    reached = [sum(r["rate"] * r["n_tokens"] * r["posteriors"][d] for r in got) for d in model["domains"]]
    assert np.abs(np.array(reached) - model["targets"]).sum() <= 1.0001e-4 * model["targets"].sum() and model["gap"] <= 1e-4
    assert model["held_out"]["accuracy"] > 0.8 and set(model["held_out"]) == {"accuracy", "log_loss", "rows"}
    _, kept = mixing.fit_mix(docs_of(spark, rows), labelled, {"loud": 0.6, "calm": 0.4}, 1.5, least=1.0)
    drawn = mixing.draw_mix(docs_of(spark, rows), kept)
    assert drawn.columns == ["doc_id", "text", "extra", "__id"]
    assert {r["doc_id"] for r in drawn.select("doc_id").collect()} == {i for i, _ in rows} and drawn.count() > len(rows)
    rates = {str(r["doc_id"]): (r["rate"], r["tokens"]) for r in kept["rows"].collect()}
    for key, n in collections.Counter(str(r["doc_id"]) for r in drawn.collect()).items():  # copies against rates
        assert n == 1 if rates[key][1] == 0 else n in (math.floor(rates[key][0]), math.floor(rates[key][0]) + 1)
    alone, _ = mixing.mix(docs_of(spark, rows), labelled.limit(0))
    assert {round(r["rate"], 6) for r in alone.collect()} == {1.0}
    assert mixing.mix(docs_of(spark, []), labelled)[0].count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rates_out_of_reach_go_to_the_least_squares(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 80)
    t = rng.integers(1, 50, 80)
    rows = spark.createDataFrame([(int(n), [float(v) for v in x]) for n, x in zip(t, p)], "tokens long, p array<double>")
    targets = np.array([0.0, 0.7, 0.3]) * t.sum()
    mass = t @ p
    found, gap, passes = mixing.fit_rates(rows, targets, passes=60)
    found = found.collect()  # in an order of its own
    got, p, t = np.array([r["rate"] for r in found]), np.array([r["p"] for r in found]), np.array([r["tokens"] for r in found])
    value = lambda r: float((((r * t) @ p - targets) ** 2 / mass).sum())
    r, y, th = np.ones(80), np.ones(80), 1.0
    for _ in range(20_000):  # the optimum, by accelerated steps
        new = np.maximum(0, y - p @ (((y * t) @ p - targets) / mass))
        th, old = (1 + math.sqrt(1 + 4 * th * th)) / 2, th
        y, r = new + (old - 1) / th * (new - r), new
    assert (got >= 0).all() and 1 <= passes <= 60
    assert value(got) - value(r) < 0.02 * value(np.ones(80)), (value(got), value(r), value(np.ones(80)), passes)
    assert abs(gap - np.abs((got * t) @ p - targets).sum() / targets.sum()) < 1e-9


def test_pipeline_mix_meets_targets(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(13)
    low = [rng.random() < 0.4 for _ in range(1500)]
    rows = [(i, t.upper().replace(" ", " # ") if y else t, "en") for i, (t, y) in enumerate(zip(prose(rng, 1500), low))] + [(5000, None, "de"), (5001, " ", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    spark.createDataFrame([(i, int(not y), 0) for i, y in enumerate(low) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = C.mix_sources(spark, docs, str(tmp_path)).collect()
    tokens = collections.Counter()
    for r in got:
        tokens["en-q0" if r["doc_id"] < 1500 and low[r["doc_id"]] else "en-q1"] += len((r["text"] or "").split())
    came = sum(len((t or "").split()) for _, t, _ in rows)
    for d in ("en-q0", "en-q1"):  # what was drawn, as a share of what came in
        assert abs(tokens[d] / came - C.BUDGET * C.WEIGHTS[d] / (C.WEIGHTS["en-q0"] + C.WEIGHTS["en-q1"])) < 0.03
    assert {5000, 5001} <= {r["doc_id"] for r in got}


# ---- 9 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.load_model()


def test_coding_matches_model(spark, model):
    sp = pieces.processor(model)
    rows = [(i, t) for i, t in enumerate(["a  b\n\nc\td", " lead", "x ", "", "ﬁ é é ☃", " ", "\n", "a▁b", "   ", "deux  mots\n  et"])] + [(50, None), (None, "x y"), (51, "word " * 3000), (52, "q" * 9000)]
    out = pieces.code_pieces(docs_of(spark, rows), model).collect()
    text = dict(rows)
    for r in out:
        t = text[r["doc_id"]] or ""
        assert list(r["ids"]) == sp.encode(t) and r["n_pieces"] == len(r["ids"]) and r["round_trip"] == (sp.decode(r["ids"]) == t)
        assert len({tuple(s["ids"]) for s in r["samples"]}) == len(r["samples"]) >= 1
        for s in r["samples"]:
            assert "▁" in t or sp.decode(s["ids"]) == t
            assert 0 <= s["inclusion"] <= 1 and s["n_pieces"] == len(s["ids"])
        assert [s["perturbed"] for s in r["samples"]] == sorted((s["perturbed"] for s in r["samples"]), reverse=True)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in out], "doc_id long, ids array<int>"), model).collect()}
    assert all(back[r["doc_id"]] == text[r["doc_id"]] for r in out if r["round_trip"] and text[r["doc_id"]] is not None)
    again = pieces.code_pieces(docs_of(spark, rows).repartition(1), model).collect()
    key = lambda r: str((r["doc_id"], r["ids"]))
    assert sorted(out, key=key) == sorted(again, key=key)  # samples hang on row key and text alone
    assert pieces.code_pieces(docs_of(spark, []), model).count() == 0


def test_pieces_leave_no_lattices_in_workers(spark, model):
    """Workers outlive their tasks, so what op9 lays out in them would weigh on all later stages."""

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(lat.edges + len(lat.index) for _, lat, _ in pieces._STATE.values())] * batch.num_rows, pa.int64())], names=["held"])

    pieces.code_pieces(docs_of(spark, [(i, f"some words of text {i}") for i in range(40)]).repartition(8), model).collect()
    assert spark.range(0, 32, 1, 16).mapInArrow(held, "held long").agg({"held": "max"}).first()[0] == 0



def test_lattices_are_laid_out_without_sorting_edges(model, monkeypatch):
    """Edges are put in their places; only nodes are sorted, as short numbers. Units are looked up in one go."""
    sp = pieces.processor(model)
    lat = pieces.Lattices(sp, *pieces.piece_weights(sp))
    real, sorted_ones = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda a, **more: (sorted_ones.append((len(a), a.dtype)), real(a, **more))[1])
    monkeypatch.setattr(np, "lexsort", None)
    texts = ["some words, 12345 and \u2603\U0001f600x", "", "words of another text\nsome"]
    rows = lat.look_up(texts)
    assert sorted_ones == [(lat.nodes, np.dtype(np.uint16))] and lat.edges > lat.nodes
    for u in np.unique(np.concatenate(rows)):
        first = lat.first[u]
        size = (lat.first[u + 1] if u + 1 < lat.units else lat.nodes) - first
        for node in range(first, first + size):
            edges = np.arange(lat.start[node], lat.start[node] + lat.degree[node])
            reach = np.where(lat.to[edges] < 0, first + size, lat.to[edges]) - node
            assert (lat.source[edges] == node).all() and (np.diff(reach) < 0).all() and abs(np.exp(lat.logq[edges]).sum() - 1) < 1e-9
    again = lat.look_up(texts[::-1])
    assert len(sorted_ones) == 1 and [x.tolist() for x in again] == [x.tolist() for x in rows[::-1]]


def test_query_codes_whole_texts(spark, model, tmp_path, monkeypatch):
    sp, real, made = pieces.processor(model), pieces.code_pieces, []
    text = {1: "a  b\n\nc\td", 2: "", 3: None, 4: "a▁b", 5: "word " * 300}
    docs_of(spark, list(text.items())).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pieces, "code_pieces", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    got = {r["doc_id"]: r for r in pieces.op9_sentencepiece(spark, str(tmp_path)).collect()}
    rows = made[0].collect()
    assert len(rows) == len(got) == len(text)
    for r in rows:
        t, q = text[r["doc_id"]] or "", got[r["doc_id"]]
        assert list(r["ids"]) == sp.encode(t) and q["n_pieces"] == len(r["ids"]) and q["round_trip"] == (sp.decode(list(r["ids"])) == t)
        for i, s in enumerate(r["samples"], 1):
            assert q[f"sample{i}_n_pieces"] == len(s["ids"]) and q[f"sample{i}_ids_hash"] == xxhash.xxh64_hexdigest(np.array(s["ids"], "<i4").tobytes())


def test_samples_follow_the_lattice(model):
    sp = pieces.processor(model)
    weights, byte_weight = pieces.piece_weights(sp)
    lat = pieces.Lattices(sp, weights, byte_weight)

    def paths(full, i=0):
        if i == len(full):
            return [((), 0.0)]
        out = [((weights[p][0], *a), weights[p][1] + b) for j in range(i + 1, len(full) + 1) if (p := full[i:j]) in weights for a, b in paths(full, j)]
        if full[i] not in weights:
            out += [((-1 - ord(full[i]), *a), byte_weight * len(full[i].encode()) + b) for a, b in paths(full, i + 1)]
        return out

    for text in ("the cat", "ab☃ x"):
        every = dict(paths("▁" + text.replace(" ", "▁")))
        z = np.logaddexp.reduce(list(every.values()))
        p = {a: math.exp(b - z) for a, b in every.items()}
        n = 6000
        at = lat.look_up([text])[0]
        found = pieces.sample_paths(lat, [at] * n, [pieces.row_key(i, 7) for i in range(n)], 3)
        first, second = (collections.Counter(tuple(lat.id[r[k][0]].tolist()) for r in found) for k in (0, 1))
        for a in sorted(p, key=p.get)[-4:]:
            assert abs(first[a] / n - p[a]) < 0.03
            assert abs(second[a] / n - sum(q * p[a] / (1 - q) for b, q in p.items() if b != a)) < 0.03
        for r in found[:200]:
            assert all(abs(math.log(p[tuple(lat.id[x[0]].tolist())]) - x[1]) < 1e-9 for x in r)
        assert abs(np.mean([sum(math.exp(x[1]) / x[3] for x in r) for r in found]) - 1) < 0.02  # inclusion scores weigh right


# ---- 10 -----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    made = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, monkeypatch):
    rng = random.Random(8)
    texts = prose(rng, 60, 60)
    rows = list(enumerate(texts)) + [(100 + i, texts[i % 5].replace("kan", "KAN") + (" end" if i % 3 else "")) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t"), (303, "ÀB one"), (304, "Àb one"), (None, texts[0]), (None, "only here once")]
    fp = [plain_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    for group, chunk in ((8192, 65_536), (3, 16)):
        monkeypatch.setattr(simhash, "GROUP_ROWS", group)
        monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk)
        got = simhash.simhash_components(docs_of(spark, rows)).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), f"{f:016x}") for i, f in zip(ids, fp))
        low = {}
        for i, f in zip(ids, fp):
            if i is not None:
                seen, todo = {f}, [f]
                while todo:
                    x = todo.pop()
                    new = {g for j, g in zip(ids, fp) if j is not None and g not in seen and (x ^ g).bit_count() <= 3}
                    seen |= new
                    todo += new
                low[f"{f:016x}"] = min(j for j, g in zip(ids, fp) if j is not None and g in seen)
        assert all(r["component_id"] == low.get(r["fingerprint"]) for r in got)
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


def test_pivots_discard_pairs_and_lose_none():
    rng = np.random.default_rng(1)
    near = rng.integers(0, 2**63, 40).astype(np.uint64)
    fp = np.concatenate([near, near ^ (np.uint64(1) << rng.integers(0, 60, 40).astype(np.uint64)), rng.integers(0, 2**63, 400).astype(np.uint64)])[:, None]
    at = simhash.pivot_distances(fp, simhash._splitmix(simhash.PIVOTS).reshape(-1, 1))
    order, tally = np.argsort(at[:, 0], kind="stable"), {}
    root = simhash.link_block(np.zeros(len(fp), np.int64), fp[order], at[order], 3, tally)
    want = {(i, j) for i in range(len(fp)) for j in range(i) if np.bitwise_count(fp[order[i]] ^ fp[order[j]]).sum() <= 3}
    assert want and all(root[i] == root[j] for i, j in want)
    assert tally["discarded"] > 0.9 * tally["met"] and tally["met"] == tally["discarded"] + tally["verified"]


def test_block_tables_lose_no_pair():
    rng = np.random.default_rng(0)
    tables = simhash.block_tables(64, 3, 5)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    same = simhash._keys(a[:, None], tables) == simhash._keys(b[:, None], tables)
    assert same.any(axis=1).all()


def test_similar_components(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(400):  # pairs about the threshold: one run of words of the second is another
        n = rng.randrange(8, 160)
        x = [rng.choice(words) for _ in range(n)]
        cut = round(rng.uniform(0.0, 0.2) * n)
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join(x[: n - cut] + [rng.choice(words) for _ in range(cut)]))]
    hub = [rng.choice(words) for _ in range(120)]
    rows += [(1000 + k, " ".join(hub[: 120 - k] + [rng.choice(words) for _ in range(k)])) for k in range(40)]
    rows += [(2000, "again and " * 50), (2001, "again and " * 4), (2002, None), (2003, " "), (2004, "one two"), (2005, "one two three"), (None, rows[0][1]), (2006, "one TWO"), (2007, rows[8][1]), (2007, rows[20][1])]

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    low, pairs = {s: min(j for j, z in sets if z == s and j is not None) for _, s in sets}, []
    distinct = list(low)
    for a, b in itertools.combinations(distinct, 2):
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            pairs.append((a, b))
        pairs += [(a, b)] if low[a] == low[b] else []  # rows of one id
    near = [len(a & b) / len(a | b) for a, b in itertools.combinations(distinct, 2) if a & b]
    assert sum(0.75 <= x < 0.8 for x in near) > 20 and sum(0.8 <= x < 0.85 for x in near) > 20
    change = True
    while change:
        change = False
        for a, b in pairs:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                change = True
    want = sorted(((i, low[s]) for i, s in sets), key=str)
    for piece in (1024, 5):
        monkeypatch.setattr(simhash, "PIECE_SETS", piece)
        got = simhash.similar_components(docs_of(spark, rows)).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert simhash.similar_components(docs_of(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[v] == min(seen)
    assert set(got) == set(near)


def test_chunks_carry(spark):
    rows = [(i, f"text {i}" * 50) for i in range(30)] + [(None, None)]
    t = chunks.write_chunks(docs_of(spark, rows), chunk_bytes=2000, carry=("extra", "__id"))
    assert t.count() > 5
    n = chunks.ask(t, None, lambda c, _: c.rest().append_column("n", [[len(c.ids)] * len(c.ids)]), "carried_extra string, carried___id int, n long")
    assert n.count() == 31 and {r["carried_extra"] for r in n.collect()} == {"x"}


# ---- the pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(11)
    base = prose(rng, 260, 60)
    passage = " ".join(prose(rng, 1, 70))
    toxic = [i % 5 == 0 for i in range(240)]
    rows = [(i, t + (" you blorgh. you blorgh." if y else ""), "en", "s", 0) for i, (t, y) in enumerate(zip(base, toxic))]
    rows += [(400, base[1], "en", "s", 0), (401, base[2] + " end", "en", "s", 0), (402, base[250] + " " + passage, "en", "s", 0), (403, base[251] + " " + passage, "en", "s", 0)]
    rows += [(404, "", "de", "s", 0), (None, base[252], None, None, None)]
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), int(y)) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, kept = common.read_table(spark, sf, "documents"), {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        kept[k] = {r["doc_id"]: r for r in docs.collect()}
    clean = {i for i, y in enumerate(toxic) if not y}
    assert set(kept[0]) == clean | {400, 401, 402, 403, 404, None}
    assert set(kept[1]) == set(kept[0]) - {400, 401}
    first, second = kept[2][402]["text"], kept[2][403]["text"]
    assert passage in first and passage not in second and base[251][:-8] in second  # the ends of both bases are alike
    assert all(kept[2][i]["text"] == kept[1][i]["text"] for i in clean)
    assert set(kept[3]) == set(kept[2]) == set(kept[4])
    assert all(r["round_trip"] for r in kept[4].values())
    assert len(C.run(spark, sf).select("doc_id").distinct().collect()) == len(kept[4])
    assert json.dumps([n for n, _ in C.STAGES])


def test_chunks_of_a_task_go_round_a_few_buckets(spark):
    numbers = [n for part in (0, 3, 70_000) for n in itertools.islice(chunks.chunk_numbers(part, 51), 40)]
    assert len(set(numbers)) == len(numbers)
    got = [r["b"] for r in spark.createDataFrame([(n,) for n in numbers], "n long").selectExpr("n", "pmod(hash(n), 51) as b").collect()]
    by = dict(zip([r["n"] for r in spark.createDataFrame([(n,) for n in numbers], "n long").collect()], got))
    assert chunks.bucket_of(np.array(numbers), 51).tolist() == [by[n] for n in numbers]
    for part in (0, 3, 70_000):
        assert len({by[n] for n in numbers if n >> 32 == part}) == chunks.TASK_FILES


def test_chunk_table_leaves_no_name_and_keeps_every_id(spark):
    low = np.iinfo(np.int64).min
    rows = [(i, f"text {i}") for i in range(20)] + [(low, "least"), (None, None), (5, "again")]
    before = len(spark.catalog.listTables())
    t = chunks.write_chunks(docs_of(spark, rows), chunk_bytes=30)
    assert len(spark.catalog.listTables()) == before
    got = chunks.ask(t, None, lambda c, _: pa.table({"id": pa.array(c.keys(), pa.int64())}), "id long").collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert chunks.groups_of(t) >= 3
