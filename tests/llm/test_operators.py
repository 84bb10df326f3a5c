"""Each operator against a brute-force version, and on the awkward rows of fixtures.py."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heronry.llm import decontaminate, flat, lines, pieces, quality, queries, repeats, similar, toxicity, urls, warc

from . import fixtures


def fold(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(ws, n):
    n = min(n, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


# ---- SentencePiece


@pytest.fixture(scope="module")
def model():
    sentencepiece = pytest.importorskip("sentencepiece")
    raw = pieces.load(queries.pieces_path())
    return pieces.Model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)


def test_pieces_are_the_library_s(model):
    own, library = model
    rnd = np.random.default_rng(3)
    texts = [t for _, t, *_ in fixtures.rows()] + ["aaaa" * 50, " " * 40 + "x", "ab" * 2000, "▁▁a", "\n\n a"]
    texts += ["".join(rnd.choice(list("ab c▁\n.,éü日😀thein"), rnd.integers(0, 200))) for _ in range(500)]
    ids, offs = own.encode(pa.array(texts, pa.string()))
    expected = library.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == expected
    assert own.decode(ids, offs).to_pylist() == library.decode(expected)


def test_decoding_of_odd_ids(model):
    own, library = model
    rows = [[], [1, 2], [0], [3 + 0xE6], [3 + 0xE6, 3 + 0x97, 3 + 0xA5], [1, 264, 2]]
    ids = np.array(list(itertools.chain(*rows)), np.int32)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = own.decode(ids, offs).to_pylist()
    assert got[0] == "" and got[1] == "" and got[4] == library.decode([rows[4]])[0] and got[5] == library.decode([[264]])[0]
    with pytest.raises(IndexError):
        own.decode(np.array([10**6]), np.array([0, 1]))


def test_coded_rows(spark):
    df = fixtures.frame(spark)
    rows = pieces.coded(fixtures.clashing(df).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1)), queries.pieces_path()).collect()
    assert len(rows) == df.count()
    texts = Counter((r["doc_id"], None if r["text"] is None else r["text"].replace("▁", " ")) for r in df.collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in rows) == texts
    assert all((r["ids"] is None) == (r["decoded"] is None) for r in rows)
    assert pieces.coded(df.limit(0), queries.pieces_path()).count() == 0


def test_models_that_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(b"\x12\x02\x18\x01")


# ---- repeated passages


def brute_repeats(rows, k):
    where = defaultdict(set)
    split = {(i, t): re.findall(r"[^\t\n\x0b\x0c\r ]+", t) for i, t, *_ in rows if i is not None and t is not None}
    for (i, t), ws in split.items():
        for a in range(len(ws) - k + 1):
            where[tuple(ws[a : a + k])].add(i)
    out = set()
    for (i, t), ws in split.items():
        cover = sorted(a for a in range(len(ws) - k + 1) if len(where[tuple(ws[a : a + k])]) > 1)
        spans = []
        for a in cover:
            if spans and a <= spans[-1][1] + 1:
                spans[-1][1] = a + k - 1
            else:
                spans.append([a, a + k - 1])
        out |= {(i, a, b - a + 1) for a, b in spans}
    return out


@pytest.mark.parametrize("find", [repeats.super_kmers, repeats.suffixes])
@pytest.mark.parametrize(("window", "gram"), [(50, 8), (5, 2)])
def test_repeats(spark, find, window, gram, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 300)  # several buckets, and splitters that cut
    rows = fixtures.rows()
    got = {tuple(r) for r in find(fixtures.clashing(fixtures.frame(spark)), window, gram).collect()}
    assert got == brute_repeats(rows, window)
    assert got or window > 50


@pytest.mark.parametrize("find", [repeats.super_kmers, repeats.suffixes])
def test_repeats_of_few_words(spark, find, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 200)
    rnd = np.random.default_rng(5)
    rows = [(i, " ".join(rnd.choice(["a", "b", "c"], 60)), "en", "s", 0) for i in range(30)]
    got = {tuple(r) for r in find(fixtures.frame(spark, rows), 8, 3).collect()}
    assert got == brute_repeats(rows, 8)
    assert find(fixtures.frame(spark, []), 8, 3).count() == 0


def test_multikey():
    rnd = np.random.default_rng(1)
    m = rnd.integers(0, 3, (500, 6))
    order, common = repeats.multikey(m)
    assert m[order].tolist() == sorted(m.tolist())
    for i in range(1, 500):
        a, b = m[order[i - 1]], m[order[i]]
        assert common[i] == (np.flatnonzero(a != b)[0] if (a != b).any() else 6)


def test_classes_survive_collisions():
    word = np.array([1, 2, 3, 1, 2, 9])
    order, group = repeats.classes(np.zeros(2, np.uint64), word, np.array([0, 3]), 3)
    assert len(set(group.tolist())) == 2


# ---- benchmark decontamination


def brute_matches(rows, items, n, threshold):
    out = []
    for i, t, *_ in rows:
        if i is None or t is None:
            continue
        ws = fold(t)
        for item, text in {(a, b) for a, b in items if a is not None and b is not None}:
            iw = fold(text)
            if not iw:
                continue
            size = min(n, len(iw))
            want = shingles(iw, n)
            hits = [(p, tuple(ws[p : p + size])) for p in range(len(ws) - size + 1) if tuple(ws[p : p + size]) in want]
            best = max(((len({s for q, s in hits if p <= q <= p + len(iw) - size}), -p) for p, _ in hits), default=(0, 0))
            if best[0] and best[0] >= threshold * len(want) - 1e-9:
                out.append((i, item, best[0], len(want), round(best[0] / len(want), 6), -best[1]))
    return Counter(out)


@pytest.mark.parametrize("most", [1 << 21, 10])
def test_decontamination(spark, most):
    items = [(1, " ".join(fixtures.words(1, 60)[5:35])), (2, "ONE two, three"), (2, "ONE two, three"), (3, "x"), (4, ""), (5, None), (None, "one two"), (6, "same same same"), (7, " ".join(fixtures.words(99, 20))), (8, "seven")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    docs = fixtures.frame(spark)
    got = Counter(tuple(r) for r in decontaminate.matches(fixtures.clashing(docs), bench, most=most).collect())
    assert got == brute_matches(fixtures.rows(), items, decontaminate.N, decontaminate.THRESHOLD) and got
    hit = {t for i, t, *_ in fixtures.rows() if t is not None and brute_matches([(0, t)], items, 3, 0.7)}
    kept = decontaminate.clean(docs, bench, most=most)
    assert kept.schema == docs.schema
    assert Counter(r["text"] for r in kept.collect()) == Counter(t for _, t, *_ in fixtures.rows() if t not in hit)
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), bench).count() == 0


# ---- WARC


def test_warc(spark, tmp_path):
    html = [(1, "http://a.example/", "<p>" + "é" * 50), (2, None, ""), (None, "http://b.example/x\ny", "z"), (4, "u", None), (1, "http://a.example/", "<p>" + "é" * 50), (5, "v", "q" * 100_000)]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    rows = warc.through(pages, 64).collect()
    assert all(r["n_bytes"] <= 64 and r["n_bytes"] == len(r["chunk"]) for r in rows)
    last = [r for r in rows if r["is_last"]]
    assert len(last) == 5 and all(r["is_valid"] for r in last)
    by = defaultdict(list)
    for r in rows:
        by[r["record_id"]].append(r)
    import hashlib

    body = b"".join(r["chunk"] for r in sorted(by["urn:page:5"], key=lambda r: r["chunk_no"]))
    assert body == b"q" * 100_000
    for r in by["urn:page:5"]:
        assert r["digest"] == hashlib.sha256(body[: r["begin"] + r["n_bytes"]]).hexdigest()
    assert [r["n_bytes"] for r in by["urn:page:2"]] == [0] and by["urn:page:2"][0]["url"] is None
    assert by["urn:page:None"][0]["url"] == "http://b.example/x%0Ay" and len(by["urn:page:1"]) == 2 * 2
    whole = {r["record_id"]: bytes(r["block"]) for r in warc.joined(warc.read(spark, _files(warc.write(pages.where("page_id = 5"), f"file://{tmp_path}/w", compress=False)))).collect()}
    assert whole == {"urn:page:5": b"q" * 100_000}
    assert warc.through(pages.limit(0)).count() == 0


def _files(df):
    return [r["path"] for r in df.collect()]


def test_broken_warc():
    import io

    head = warc.header("urn:x", "u", 10, "0" * 64)
    rows = list(warc.chunks(io.BytesIO(head + b"abcde"), 4))
    assert [r[6] for r in rows] == [b"abcd", b"e", b""] or [r[6] for r in rows] == [b"abcd", b"e"]
    assert rows[-1][-2] and not rows[-1][-1]
    with pytest.raises(ValueError):
        list(warc.chunks(io.BytesIO(b"junk\n"), 4))


# ---- toxicity


def toxic_rows(n=400, seed=2):
    rnd = np.random.default_rng(seed)
    vocabulary = fixtures.words(11, 400)
    rows, labels = [], []
    for i in range(n):
        ws = list(rnd.choice(vocabulary, 40))
        bad = i % 5 == 0
        if bad:
            for at in rnd.integers(0, 39, 3):
                ws[at] = str(rnd.choice(["grumble", "snarlfoo", "snarlbar", "snarlqux"]))
        rows.append((i, " ".join(ws[:20]) + ".\n" + " ".join(ws[20:]), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = fixtures.frame(spark, rows + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "grumble grumble", "en", "s", 0)])
    known = spark.createDataFrame(labels[:300] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.toxic(fixtures.clashing(docs), known).collect()
    got = {r["doc_id"] for r in found}
    assert got == {i for i, _, t in labels if t}
    text = {i: t for i, t, *_ in rows}
    for r in found:
        said = " ".join(text[r["doc_id"]][s["begin"] : s["end"]] for s in r["spans"])
        assert re.fullmatch(r"((grumble|snarl(foo|bar|qux))\s?\.?\s?)+", said)
    left = toxicity.clean(docs, known)
    assert left.schema == docs.schema
    assert {r["doc_id"] for r in left.collect()} == ({i for i, _, t in labels if not t} | {900, 901})
    assert toxicity.toxic(docs, known.limit(0)).count() == 0 and toxicity.clean(docs, known.limit(0)).count() == docs.count()
    assert toxicity.toxic(docs.limit(0), known).count() == 0


def test_rare_toxic_labels_are_used(spark):
    rows, labels = toxic_rows(1200, 3)
    rows = [r for (r, (i, _, t)) in zip(rows, labels) if not t or i % 50 == 0]
    bad = {i for i, _, t in labels if t and i % 50 == 0}
    held = [(i, 1, int(i in bad)) for i, *_ in rows]
    # labels of documents that aren't there, toxic too
    known = spark.createDataFrame(held + [(10_000 + i, 1, i % 2) for i in range(3000)], "doc_id long, quality int, toxic int")
    docs = fixtures.frame(spark, rows)
    assert {r["doc_id"] for r in toxicity.toxic(docs, known, 100).collect()} == bad
    marks = spark.createDataFrame([(i, int(t)) for i, _, t in held], "doc_id long, toxic int")
    for fit, most, want in ((100, 10, (10, 90)), (100, 400, (24, 76)), (20, 400, (10, 10)), (5000, 3, (24, len(rows) - 24))):
        took = Counter(r["toxic"] for r in toxicity.sampled(marks, fit, most).collect())
        assert (took[1], took[0]) == want


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(0)
    lens = [1, 4, 3, 5]
    text = "\n".join(" ".join("w" for _ in range(n)) for n in lens).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, _, bounds = toxicity.flat.spans(data, offs)
    cols = toxicity.Lines(data, starts, bounds)
    odds, start, moves = np.exp(rnd.normal(size=sum(lens))), 0.4, np.exp(rnd.normal(size=(2, 2)))
    p = np.empty(sum(lens))
    p[cols.word] = cols.marginals(odds[cols.word], start, moves)[2]
    base = 0
    for n in lens:
        own = odds[base : base + n]
        total, hit = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            w = start ** tags[0] * np.prod(own ** np.array(tags)) * np.prod([moves[a, b] for a, b in zip(tags, tags[1:])])
            total += w
            hit += w * np.array(tags)
        assert np.allclose(hit / total, p[base : base + n])
        base += n


def test_long_lines_are_cut_without_loss():
    rnd = np.random.default_rng(5)
    text = "\n".join(" ".join("w" for _ in range(n)) for n in (1, 40, 7, 23, 8, 2)).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, _, bounds = toxicity.flat.spans(data, offs)
    odds, start, moves = np.exp(rnd.normal(size=len(starts)) * 3), 0.3, np.exp(rnd.normal(size=(2, 2)))
    found = []
    for cut in (1 << 62, 1, 3, 7, 8):
        cols = toxicity.Lines(data, starts, bounds, cut)
        p = np.empty(len(starts))
        p[cols.word] = cols.marginals(odds[cols.word], start, moves)[2]
        found.append(p)
        assert len(cols.active) <= min(cut, 40)
    assert all(np.allclose(p, found[0], atol=1e-9) for p in found[1:])


def test_the_fit_follows_the_exact_likelihood():
    rnd = np.random.default_rng(1)
    lens, n = [3, 1, 4], 4
    text = "\n".join(" ".join("w" for _ in range(k)) for k in lens).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, _, bounds = toxicity.flat.spans(data, offs)
    cols = toxicity.Lines(data, starts, bounds)
    word = [rnd.integers(0, n, len(starts)), rnd.integers(0, n, len(starts))]
    true = rnd.random(len(starts)) < 0.5

    def loss(w):
        w = np.where(np.arange(len(w)) == 0, 0, w)
        moves, out, at = w[-5:-1].reshape(2, 2), toxicity.SQUARES * (w * w).sum() / 2, 0
        for k in lens:
            own = sum(w[x[at : at + k]] for x in word) + w[-1]
            value = lambda tags: w[-6] * tags[0] + (own * np.array(tags)).sum() + sum(moves[a, b] for a, b in zip(tags, tags[1:]))  # noqa: B023, E731
            out += np.log(sum(np.exp(value(t)) for t in itertools.product((0, 1), repeat=k))) - value(true[at : at + k].astype(int).tolist())
            at += k
        return out

    w = rnd.normal(size=n + 6)
    w[0] = 0
    slope = toxicity.gradient(w, [(cols, [x[cols.word] for x in word], true[cols.word])], n)
    for i in range(1, len(w)):
        step = np.eye(len(w))[i] * 1e-5
        assert slope[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-5, abs=1e-5)


def brute_threshold(scored, truth):
    """The least of the scores, rounded, with the highest F1 of those that reach it."""
    levels = sorted({round(s, 3) for i, s in scored if i in truth}, reverse=True)
    best, least = 0.0, float("inf")
    for level in levels:
        told = [truth[i] for i, s in scored if i in truth and round(s, 3) >= level]
        f1 = 2 * sum(told) / (len(told) + sum(truth.values()))
        if f1 >= best:
            best, least = f1, level - 0.0005
    return least


def test_toxic_threshold_is_the_best(spark):
    rnd = np.random.default_rng(4)
    truth = {i: int(rnd.random() < 0.3) for i in range(300)}
    scored = [(i, float(np.round(rnd.normal() + 2 * t + 3, 2))) for i, t in truth.items() if rnd.random() < 0.8] + [(900, 9.0)]
    found = spark.createDataFrame(scored, "doc_id long, score double")
    held = spark.createDataFrame([(i, t) for i, t in truth.items()], "doc_id long, toxic int")
    assert toxicity.threshold(found, held) == pytest.approx(brute_threshold([x for x in scored if x[1] > 0], truth))


# ---- quality


def test_quality(spark):
    rows, labels = [], []
    for i in range(300):
        ws = fixtures.words(1000 + i, 60)
        bad = i % 6 == 0
        rows.append((i, " | ".join(ws) if bad and i % 12 else " ".join(w + "###" for w in ws) if bad else " ".join(ws).capitalize() + ".", "en", "s", 0))
        labels.append((i, int(not bad), 0))
    extra = [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (None, rows[1][1], "en", "s", 0)]
    docs = fixtures.frame(spark, rows + extra)
    known = spark.createDataFrame(labels[:200] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.kept(fixtures.clashing(docs), known).collect()}
    good = {i for i, q, _ in labels if q}
    assert len(good - kept) <= 3 and not {i for i, q, _ in labels if not q} & kept and None in kept
    assert quality.kept(docs, known.limit(0)).where("score is null").count() == 302
    assert quality.kept(docs.limit(0), known).count() == 0


def test_paths_of_a_forest():
    rnd = np.random.default_rng(0)
    good = rnd.normal(size=(300, 3))
    forest = quality.Forest(good, good.min(0), good.max(0) + 20, trees=30)
    score = forest.scores(np.vstack([good, good[:20] + [0, 0, 15]]))
    assert score[300:].min() > np.median(score[:300])
    again = quality.Forest(good, good.min(0), good.max(0) + 20, trees=30)
    assert (again.scores(good) == score[:300]).all()


def test_path_lengths_and_scores_of_a_forest_against_a_walk():
    rnd = np.random.default_rng(7)
    good = rnd.normal(size=(120, 4))
    rows = rnd.normal(size=(50, 4)) * 3
    forest = quality.Forest(good, np.minimum(good.min(0), rows.min(0)), np.maximum(good.max(0), rows.max(0)), trees=9, rows=64, seed=3)
    expected = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    random = np.random.default_rng(3)
    total = np.zeros(len(rows))
    for root in forest.roots:
        held = good[random.choice(len(good), 64, replace=False)]
        for r, row in enumerate(rows):
            node, depth, own = root, 0, held
            while forest.what[node] >= 0:
                k, value = forest.what[node], forest.value[node]
                own = own[own[:, k] >= value] if row[k] >= value else own[own[:, k] < value]
                node, depth = forest.left[node] + int(row[k] >= value), depth + 1
            total[r] += depth + expected(len(own))
        _skip(random, forest, root, held)
    assert np.allclose(forest.scores(rows), 2.0 ** (-total / 9 / expected(64)))


def _skip(random, forest, root, held):
    """Draws what growing the tree drew, so that the next tree's rows are known."""
    low = np.full(4, -np.inf)
    waiting = [(root, held, 0)]
    del low
    while waiting:
        at, own, depth = waiting.pop()
        if forest.what[at] < 0:
            continue
        random.choice(4)
        random.random()
        random.uniform(0, 1)
        k, value = forest.what[at], forest.value[at]
        waiting += [(forest.left[at], own[own[:, k] < value], depth + 1), (forest.left[at] + 1, own[own[:, k] >= value], depth + 1)]


def test_quality_threshold_tells_most_rightly(spark):
    rnd = np.random.default_rng(4)
    truth = {i: int(rnd.random() < 0.7) for i in range(300)}
    scored = [(i, float(np.round(0.5 - 0.1 * t + rnd.normal() / 10, 3))) for i, t in truth.items()] + [(None, 0.1), (900, 0.9)]
    most = quality.threshold(spark.createDataFrame(scored, "doc_id long, score double"), spark.createDataFrame(list(truth.items()), "doc_id long, quality int"))
    right = lambda level: sum((s <= level) == bool(truth[i]) for i, s in scored if i in truth)
    assert right(most) == max(right(s) for _, s in scored)
    good = spark.createDataFrame([(i, 1) for i in truth], "doc_id long, quality int")
    assert quality.threshold(spark.createDataFrame(scored, "doc_id long, score double"), good) == float("inf")


# ---- n-gram Jaccard join


def brute_sets(rows, n):
    """{set of n-grams: ids of the texts that have it}, a text of an id once."""
    sets = defaultdict(list)
    for i, t in {(r[0], r[1]) for r in rows}:
        if i is not None and t is not None and fold(t):
            sets[frozenset(shingles(fold(t), n))].append(i)
    return sets


def brute_pairs(rows, n, threshold):
    sets = brute_sets(rows, n)
    out = set()
    for x, y in itertools.combinations(sets, 2):
        a, b = min(sets[x]), min(sets[y])
        if a != b and len(x & y) >= threshold * len(x | y) - 1e-9:
            out.add((min(a, b), max(a, b), round(len(x & y) / len(x | y), 6)))
    return out


def brute_links(rows, n, threshold):
    sets = brute_sets(rows, n)
    near = {x: [y for y in sets if x != y and len(x & y) >= threshold * len(x | y) - 1e-9] for x in sets}
    out = []
    for x in sets:
        found, left = {x}, [x]
        while left:
            for y in near[left.pop()]:
                if y not in found:
                    found.add(y)
                    left.append(y)
        members = [i for y in found for i in sets[y]]
        if len(members) > 1:
            out += [(i, min(members), min(sets[x]), len(near[x])) for i in sets[x]]
    return out


def jaccard_rows(seed=4):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(150):
        if i % 3 and rows:
            ws = fold(rows[int(rnd.integers(0, len(rows)))][1])
            for _ in range(int(rnd.integers(0, 8))):
                ws[int(rnd.integers(0, len(ws)))] = fixtures.words(7000 + i, 1)[0]
        else:
            ws = fixtures.words(5000 + i, int(rnd.integers(3, 60)))
        rows.append((i, " ".join(ws), "en", "s", 0))
    return rows


@pytest.fixture
def small_tables(monkeypatch):
    monkeypatch.setattr(similar, "BUCKET", 500)
    monkeypatch.setattr(similar, "LEAST_FREQUENT", 3)
    monkeypatch.setattr(similar, "RARE", 20)


def test_jaccard_links(spark, small_tables):
    rows = jaccard_rows()
    for split, together in ((similar.SPLIT, similar.TOGETHER), (3, 300)):  # all at once, and frequent n-grams and groups in cells
        got = [tuple(r) for r in similar.links(fixtures.frame(spark, rows + rows[:9]), split=split, together=together).collect()]
        assert Counter(got) == Counter(brute_links(rows, similar.N, similar.THRESHOLD))
    got = [tuple(r) for r in similar.pairs(fixtures.frame(spark, rows), split=3, together=300).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, similar.N, similar.THRESHOLD)


def test_jaccard_links_across_groups(spark, small_tables, monkeypatch):
    monkeypatch.setattr(similar, "MET", 99)  # no groups are found before: all pairs are told
    rows = jaccard_rows(5)
    for split in (similar.SPLIT, 2):
        got = [tuple(r) for r in similar.links(fixtures.frame(spark, rows), split=split, together=200).collect()]
        assert Counter(got) == Counter(brute_links(rows, similar.N, similar.THRESHOLD))


def test_a_group_of_a_third_of_all_rows(spark, small_tables):
    rnd = np.random.default_rng(3)
    base, rows = fixtures.words(1, 80), []
    for i in range(600):
        ws = list(base) if i % 3 == 0 else fixtures.words(100 + i, 30)
        if i % 6 == 0:
            for k in rnd.integers(0, 80, 3):
                ws[int(k)] = f"w{i}"
        rows.append((i, " ".join(ws), "en", "s", 0))
    got = [tuple(r) for r in similar.links(fixtures.frame(spark, rows), split=16, together=2000).collect()]
    assert Counter(got) == Counter(brute_links(rows, similar.N, similar.THRESHOLD)) and len(got) == 200


def told_pairs(texts, buckets=3, kind=np.uint32, threshold=0.55):
    """{(a, b): (n-grams told as shared, l)} of texts numbered by place, each a group of its own."""
    numbers = np.arange(len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(numbers), pa.array(numbers)], ["text", "number", "group"])
    none = np.zeros(0, np.int64)
    posted = pa.Table.from_batches(similar._postings(1, threshold, none.view(np.uint64), none, buckets, 100, kind)(iter([batch])))
    times, ells = Counter(), {}
    for b in range(buckets):
        told = similar._paired(threshold, 4, kind)(posted.filter(pa.compute.equal(posted["bucket"], b)))
        columns = [np.concatenate([np.zeros(0, own), *(np.frombuffer(x.as_buffer(), own) for x in told[k])]) for k, own in similar._told(kind)]
        for x, y, n, ell in zip(*(c.tolist() for c in columns)):
            times[x, y] += n
            ells[x, y] = ell
    return {k: (n, ells[k]) for k, n in times.items()}


def test_pairs_are_told_for_the_prefixes_that_their_sizes_need():
    # sets of 220 must share 157 to be similar, so only their first 220 - 157 + l n-grams count, of which these two share none
    by_hash = sorted(fixtures.words(1, 6000), key=lambda w: int(next(similar.sets(*flat.buffers(pa.array([w])), 1))[1][0]))
    by_hash = list(dict.fromkeys(by_hash))[:1400]
    early, late = by_hash[:200], by_hash[-1200:]
    x, y = early[::2] + late[:120], early[1::2] + late[:120]
    assert len(x) == len(y) == 220 and len(set(x) & set(y)) == 120
    assert told_pairs([" ".join(x), " ".join(y)]) == {}


def test_no_similar_pair_is_lost_to_places():
    rnd = np.random.default_rng(8)
    vocabulary = list(dict.fromkeys(fixtures.words(2, 9000)))[:5000]
    texts = []
    for size in (1, 2, 3, 7, 20, 60, 300, 1500):
        for _ in range(4):
            base = rnd.permutation(vocabulary)
            for share in (0.56, 0.6, 0.8, 1.0, 1.25, 1.75):  # smaller and larger ones, and some with other words
                n = max(1, round(size * share))
                texts.append(" ".join([*base[: n - n // 12], *rnd.choice(base[n:], n // 12, replace=False)]))
    words = [set(fold(t)) for t in texts]
    near = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(words[i] & words[j]) >= 0.55 * len(words[i] | words[j]) - 1e-9}
    assert len(near) > 200
    for kind in (np.uint32, np.int64):
        told = told_pairs(texts, kind=kind)
        assert near <= {k for k, (n, ell) in told.items() if n >= ell}
    assert similar._kind(1 << 32) is np.uint32 and similar._kind((1 << 32) + 1) is np.int64


def test_overlaps_are_exact():
    rnd = np.random.default_rng(2)
    grams = [np.unique(rnd.integers(0, 400, int(rnd.integers(1, 90))).astype(np.uint64)) for _ in range(120)] + [np.arange(3, dtype=np.uint64)] * 40
    want = [[len(np.intersect1d(x, y)) for y in grams] for x in grams]
    for most in (1, 1000, 1 << 22):
        assert np.vstack([x for _, x in similar.overlaps(grams, most)]).tolist() == want


def test_jaccard_links_of_awkward_rows(spark):
    rows = fixtures.rows() + [(14, "y", "en", "s", 1), (20, "x", "en", "s", 1)]
    got = [tuple(r) for r in similar.links(fixtures.clashing(fixtures.frame(spark, rows))).collect()]
    assert Counter(got) == Counter(brute_links(rows, similar.N, similar.THRESHOLD))
    assert similar.links(fixtures.frame(spark, [])).count() == 0 and similar.pairs(fixtures.frame(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    rows = jaccard_rows(9)
    gone = {i for i, least, _, _ in brute_links(rows, similar.N, similar.THRESHOLD) if i != least}
    docs = fixtures.clashing(fixtures.frame(spark, rows + [rows[0], (None, rows[0][1], "en", "s", 0), (800, None, "en", "s", 0), (801, "", "en", "s", 0)]))
    out = similar.deduped(docs)
    assert out.dtypes == docs.dtypes
    left = out.collect()
    assert Counter(r["doc_id"] for r in left) == Counter([i for i, *_ in rows if i not in gone] + [None, 800, 801])
    assert all(r[c] == "clash" for r in left for c in docs.columns if c not in fixtures.SCHEMA)
    assert similar.deduped(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (200, 200)]
    got = {r["sid"]: r["root"] for r in similar.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 103: 100, 105: 100}


# ---- line dedup


def brute_chunks(text):
    from hashlib import md5

    ls = text.split("\n")
    h = [int.from_bytes(md5(x.encode()).digest()[:4], "big") for x in ls]
    out, own = [], []
    for i, line in enumerate(ls):
        own.append((i, line))
        if sum(lines.FACTOR**k * h[i - k] for k in range(lines.WINDOW) if i >= k) % lines.DIVISOR == 0 or i + 1 == len(ls):
            out.append(own)
            own = []
    return out


def test_line_dedup(spark):
    rnd = np.random.default_rng(8)
    pool = [" ".join(fixtures.words(k, 4)) for k in range(12)] + [""]
    block = [" ".join(fixtures.words(50 + k, 3)) for k in range(12)]
    rows = fixtures.rows()
    for i in range(30, 70):
        own = [str(x) for x in rnd.choice(pool, 6)]
        rows.append((i, "\n".join(own + block * (i % 2) + own[:2]), "en", "s", 0))
    seen, gone = {}, defaultdict(set)
    for i, t in sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        for chunk in brute_chunks(t):
            body = tuple(x for _, x in chunk)
            if len(body) > 1:
                if body in seen:
                    gone[i, t] |= {k for k, _ in chunk}
                seen.setdefault(body, i)
    want = Counter((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]), len(gone[i, t])) for i, t, *_ in rows)
    got = lines.cleaned(fixtures.clashing(fixtures.frame(spark, rows)))
    assert Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()) == want and sum(map(len, gone.values())) > 50
    out = lines.deduped(fixtures.frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = Counter((i, t, None if t is None else len(t)) for (i, t, n), c in want.items() for _ in range(c) if not (n and t == ""))
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == left
    assert lines.cleaned(fixtures.frame(spark, [])).count() == 0


def brute_passages(rows):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        ls = t.split("\n")
        gone = set()
        for k, pair in enumerate(zip(ls, ls[1:])):
            if pair in seen:
                gone |= {k, k + 1}
            seen.add(pair)
        out[i, t] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(gone))
    return out


def test_planted_passages_go_whole(spark):
    rows, planted = fixtures.rows(), []
    for n in range(2, 9):
        passage = [" ".join(fixtures.words(9000 + 10 * n + k, 10)) for k in range(n)]
        for copy in range(4):
            before, after = ([" ".join(fixtures.words(20_000 + 1000 * n + 100 * copy + k + at, 5)) for k in range(3 + copy)] for at in (0, 50))
            rows.append((1000 * n + copy, "\n".join(before + passage + after), "en", "s", 0))
            if copy:
                planted.append((rows[-1][0], "\n".join(before + after), n))
    want = brute_passages(rows)
    got = lines.cleaned(fixtures.clashing(fixtures.frame(spark, rows)), passages=True).collect()
    assert Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in got) == Counter((i, *want.get((i, t), (None, 0))) for i, t, *_ in rows)
    assert {(r["doc_id"], r["text"], r["lines_removed"]) for r in got} >= set(planted)
    stage = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, fixtures.frame(spark, rows), "").collect()}
    assert all(stage[i] == t for i, t, _ in planted)
    assert {x for t in stage.values() if t for x in t.split("\n")} | {""} == {x for _, t, *_ in rows if t for x in t.split("\n")} | {""}
    assert lines.cleaned(fixtures.frame(spark, []), passages=True).count() == 0


@pytest.mark.parametrize("passages", [False, True])
def test_bodies_of_one_hash_are_told_apart(spark, monkeypatch, passages):
    rows = [(i, "\n".join(" ".join(fixtures.words(k, 3)) for k in (i % 5, i % 7, i % 5, i % 3, 9, i % 4)), "en", "s", 0) for i in range(30)]
    docs = fixtures.frame(spark, rows)
    want = Counter(lines.cleaned(docs, passages=passages).collect())
    thin = lines._thin

    def weak(kind):
        run = thin(kind)

        def weaker(batches):
            for batch in run(batches):
                yield batch.set_column(4, "hash", pa.array(batch.column(4).to_numpy() & 1))

        return weaker

    monkeypatch.setattr(lines, "_thin", weak)
    assert Counter(lines.cleaned(docs, passages=passages).collect()) == want and sum(r["lines_removed"] for r in want) > 10


# ---- URL filters


def url_rows():
    good = [(i, f"https://www.site{i % 7}.example.org/en/{i}.html") for i in range(60)]
    bad = [(100 + i, f"http://{w}.casino-win.example.com/p/{i}") for i, w in enumerate("abcdefgh")]
    return good + bad + [(None, "https://www.site1.example.org/x"), (300, None), (301, ""), (302, "é" * 3000), (1, good[1][1])]


def brute_bits(counts, url):
    raw = bytes(b + 32 if 65 <= b < 91 else b for b in url.encode())
    total = 0.0
    for side, sign in ((0, -1), (1, 1)):
        for i in range(len(raw)):
            p = 1 / 256
            for k in range(min(urls.ORDER, i) + 1):
                before = raw[i - k : i]
                follow = {g[-1]: c[side] for g, c in counts.items() if len(g) == k + 1 and g[:-1] == before and c[side]}
                n = sum(follow.values())
                if n:
                    p = (follow.get(raw[i], 0) + len(follow) * p) / (n + len(follow))
            total += sign * np.log2(p)
    return total / max(len(raw), 1)


def test_urls(spark):
    rows = [r for r in url_rows() if r[0] != 302]
    pages = spark.createDataFrame(url_rows(), "page_id long, url string").withColumn("score", F.lit("clash")).withColumn("gram", F.lit(1)).repartition(2)
    kept = Counter(r["page_id"] for r in urls.kept(pages).collect())
    assert kept == Counter([i for i, u in url_rows() if u is not None and "casino" not in u])
    small = [r for r in rows if r[1] and (r[0] or 0) % 20 in (1, 0)]
    counts = defaultdict(lambda: [0, 0])
    for _, u in small:
        raw = u.lower().encode()
        for i in range(len(raw)):
            for k in range(min(urls.ORDER, i) + 1):
                counts[raw[i - k : i + 1]]["casino" in u] += 1
    frame = spark.createDataFrame(small, "page_id long, url string")
    for group in (1 << 30, 100):
        for r in urls.scored(frame, group=group).collect():
            assert abs(r["score"] - brute_bits(counts, r["url"])) < 1e-5
    assert urls.kept(pages.limit(0)).count() == 0
    assert urls.kept(pages.where("url like '%site%'")).count() == 62


def test_urls_that_are_no_seeds(spark):
    rows = [
        ("http://www.spam-farm.example.com/a", True), ("//m.ADULT-x.example.net/", True), ("https://a.example.org:80/x?y#z", False), ("https://downloads.example.org/x", None),
        ("http://free-thing.example.com/", None), ("https://a.example.org/casino/1", None), ("http://10.0.0.1/", None), ("/a/b", None), ("", None),
    ]
    got = spark.createDataFrame([(u,) for u, _ in rows], "url string").select("url", urls.seed(F.col("url")).alias("bad")).collect()
    assert {r["url"]: r["bad"] for r in got} == dict(rows)


def test_score_decides_on_urls_that_are_no_seeds(spark):
    good = [(i, f"https://www.site{i % 7}.example.org/en/{i}.html") for i in range(60)]
    bad = [(100 + i, f"http://{w}.casino-win.example.com/p/{i}") for i, w in enumerate("abcdefgh")]
    # hosts of no listed word, many enough to teach the accepted model if they were counted
    other = [(200 + i, f"http://{w}.casinowin-win.example.com/p/{i}") for i, w in enumerate("abcdefgh" * 5)] + [(300, "日本語" * 50), (301, "https://www.site1-b.example.org/en/7.html")]
    pages = spark.createDataFrame(good + bad + other, "page_id long, url string")
    assert {r["page_id"] for r in urls.kept(pages).collect()} == {i for i, _ in good} | {300, 301}
    sent, through = ({r["page_id"]: r["score"] for r in urls.scored(pages, group=group).collect()} for group in (1 << 30, 50))
    assert sent[300] == 0 and all(abs(sent[i] - through[i]) < 1e-5 for i in sent)
    own = pages.withColumn("mine", F.expr("case when page_id < 60 then false when page_id < 200 then true end"))
    assert {r["page_id"] for r in urls.kept(own, "mine").collect()} == {i for i, _ in good} | {300, 301}


def test_hot_passages_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 2000)
    shared_ = fixtures.words(1, 70)
    rows = [(i, " ".join(fixtures.words(100 + i, 11) + [f"a{i}"] + (shared_ if i % 3 == 0 else fixtures.words(5000 + i, 55)) + [f"b{i}"] + fixtures.words(900 + i, 9)), "en", "s", 0) for i in range(240)]
    rows += [(300 + i, " ".join(fixtures.words(7000 + i // 2, 60) + [f"c{i}"]), "en", "s", 0) for i in range(8)]
    docs = fixtures.frame(spark, rows)
    want = Counter((i, 12, 70) for i in range(0, 240, 3)) + Counter((300 + i, 0, 60) for i in range(8))
    for find in (repeats.super_kmers, repeats.suffixes):
        for hot in (1 << 20, 20, 1):
            assert Counter(tuple(r) for r in find(docs, hot=hot).collect()) == want


def record(block, digest, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nWARC-Block-Digest: " + digest + b"\r\n" + extra + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_digests_of_other_writers():
    import base64
    import hashlib
    import io

    block = b"some bytes " * 50
    sha1 = hashlib.sha1(block).digest()
    for digest in (b"sha1:" + base64.b32encode(sha1), b"SHA-1:" + sha1.hex().encode(), b"md5:" + base64.b32encode(hashlib.md5(block).digest()), b"unknown:abc", hashlib.sha256(block).hexdigest().encode()):
        rows = list(warc.chunks(io.BytesIO(record(block, digest)), 100))
        assert b"".join(r[6] for r in rows) == block and rows[-1][9] is True
    assert list(warc.chunks(io.BytesIO(record(block, b"sha1:" + base64.b32encode(sha1[::-1])))))[-1][9] is False


def test_broken_heads_are_invalid_rows():
    import io

    good = record(b"x", b"unknown:x")
    for bad in (good.replace(b"Length: 1", b"Length: one"), good.replace(b"Length: 1", b"Length: -1"), record(b"x", b"unknown:x", b"A: " + b"a" * (1 << 17) + b"\r\n")):
        for stream in (io.BytesIO(bad + good), warc._Lines(io.BytesIO(bad + good))):
            rows = list(warc.chunks(stream))
            assert [(r[5], r[8], r[9]) for r in rows] == [(0, True, False), (1, True, True)]
    assert list(warc.chunks(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.chunks(io.BytesIO(b"z" * (1 << 20))))
    with pytest.raises(ValueError):
        warc.located("/no/scheme")
