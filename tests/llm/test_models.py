"""Toxicity, quality and nearest neighbours against held-out labels, plain Python and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulestone.llm import ann, quality, toxicity
from rulestone.llm.queries import queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, host int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1) for i, t, s in rows], DOCS)


def plain_trigrams(texts):
    found = np.zeros(toxicity.SIZE**3, int)
    for text in texts:
        own = [toxicity.symbol(c) for c in f"  {text}  "]
        for a, b, c in zip(own, own[1:], own[2:], strict=False):
            found[(a * toxicity.SIZE + b) * toxicity.SIZE + c] += 1
    return found


def test_trigrams_of_all_documents(spark):
    texts = ["An éß ñ 1", "", None, "x" * 9000, "łódź", "москва 東京 😀 ſ", "\u0131d\u00b2"]
    counts = toxicity.gather_trigrams(table(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert (counts == plain_trigrams(t or "" for t in texts)).all()


def all_readings(word):
    """Every reading of a word with its channel cost."""
    found = [("", 0.0)]
    for c, n in toxicity._runs(word):
        found = [(r + m, s + cost) for r, s in found for m, cost in toxicity._choices(c, n)]
    return found


def path_score(read, cost, model):
    x = y = 0
    for c in read:
        z = toxicity.symbol(c)
        cost += model.log[x][y][z] if z or not c.isdigit() else -7.0
        x, y = y, z
    return cost + model.log[x][y][0]


def test_viterbi_finds_the_best_reading():
    model = toxicity.LanguageModel(toxicity.count_trigrams(["the moron sat on the loser and a clown of trash"] * 50))
    for word in ("m0r0n", "l0$3r", "cl0oown", "tr.a.sh", "the", "a1!|b", "mmm000", "ssst44", ""):
        best = max(path_score(r, s, model) for r, s in all_readings(word))
        assert max(path_score(r, s, model) for r, s in all_readings(word) if r == toxicity.decode(word, model)) == pytest.approx(best)
    assert [toxicity.decode(w, model) for w in ("m0r0n", "l-o-s-3-r", "clooown", "tr@sh")] == ["moron", "loser", "clown", "trash"]


def corpus(n=600, seed=5):
    pick = random.Random(seed)
    words = ["".join(pick.choice("aeinorstlmd") for _ in range(pick.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        text, toxic = [pick.choice(words) for _ in range(60)], i % 8 == 0
        if toxic:
            text[pick.randint(0, 59)] = pick.choice(["moron", "clown"])
            text[pick.randint(0, 59)] = pick.choice(["moron", "trash"])
        rows.append((i, " ".join(text), f"s{i % 3}"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_disguised_words_are_caught_and_others_left(spark):
    rows, labels = corpus()
    scorer = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = rows[1][1]
    for bad in ("m0r0n", "M O R O N", "mor0n!", "tr@sh", "c.l.o.w.n", "clooooown", "m-o-r-o-n"):
        assert scorer.score(f"{clean} {bad} {clean}") >= toxicity.THRESHOLD, bad
    for fine in ("a a a a", "1 2 3 4", "A1B2C3D4", "3.14", "", "n0te", "b2b"):
        assert scorer.score(f"{clean} {fine}") < toxicity.THRESHOLD, fine
    held = [(t, y) for (i, t, _), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scorer.score(t) >= toxicity.THRESHOLD) == bool(y) for t, y in held]) > 0.97


def plain_scorer(sample, counts):
    """The scorer by a plain walk over all labelled texts."""
    restorer = toxicity.Restorer(toxicity.LanguageModel(counts))
    kept, seen = [], set()
    for _, label, text in sorted(sample):
        marks = {(label, k, m) for k, m in enumerate(toxicity.marks_of(text).tolist())}
        if not marks & seen:
            kept.append(({f for token in restorer.tokens(text) for f in restorer.features(token)}, label))
        seen |= marks

    def weigh(sure):
        left = [(own, label) for own, label in kept if not own & sure]
        toxic = sum(label for _, label in left)
        share = (toxic + 0.5) / (len(left) + 1)
        counted = {}
        for own, label in left:
            for f in own:
                n, t = counted.get(f, (0, 0))
                counted[f] = n + 1, t + label
        found = {}
        for f, (n, t) in counted.items():
            if t < 2 or t <= max(0.5, share) * n:
                continue
            number = sum(m == n for m, _ in counted.values())
            reached = sum(m == n and u >= t for m, u in counted.values())
            false = min(1.0, number * toxicity.chance_of(n, t, share) / reached)
            if false < toxicity.FALSE:
                p, z = t / n, toxicity.SURE
                low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                found[f] = -np.log(1 - min(low * (1 - false), 0.999))
        return found

    sure = {f: w for f, w in weigh(set()).items() if w >= -np.log(1 - toxicity.SURELY)}
    return weigh(set(sure)) | sure


def test_weights_and_scores_against_a_plain_walk(spark):
    rows, labels = corpus(240)
    rows += [(5000 + i, rows[8 * i][1], "s") for i in range(12)] + [(8, rows[8][1], "s"), (8, rows[9][1] + " moron", "s")]
    labels += [(5000 + i, 1) for i in range(12)] + [(9999, 1), (None, 1)]
    docs = table(spark, rows)
    scorer = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = {}
    for i, y in labels:
        if i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            known.setdefault(i, set()).add(y)
    keyed = docs.select("doc_id", "text", *[F.xxhash64("text", F.lit(y)).alias(f"key{y}") for y in (0, 1)]).collect()
    sample = {(r[f"key{y}"], y, r.text) for r in keyed for y in known.get(r.doc_id, ())}
    want = plain_scorer(sample, toxicity.gather_trigrams(docs))
    assert scorer.weights.keys() == want.keys() and len(want) >= 3
    assert all(scorer.weights[f] == pytest.approx(w) for f, w in want.items())
    for r in toxicity.score(docs, scorer).collect():
        tokens = scorer.restorer.tokens(r.text)
        total = sum(max((want.get(f, 0.0) for f in scorer.restorer.features(t)), default=0.0) for t in tokens)
        assert r.toxicity == "x" or r.toxicity == pytest.approx(1 - (1 - scorer.base) * np.exp(-total))


def test_a_sample_bounds_texts_of_one_id(spark):
    rows = [(4, f"text number {i}", "s") for i in range(60)] + [(5, "another", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.train(table(spark, rows), labels, sample=20).weights == {}


def test_toxicity_stage_keeps_columns(spark):
    rows, labels = corpus(300)
    docs = table(spark, rows + [(None, None, None), (7001, "", "s")] + rows[:1])
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 7001 in ids and 1 in ids
    assert toxicity.drop_toxic(table(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_held_out_labels(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tox = queries()["op3_toxicity"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in tox)
    held = [(r, labels[r.doc_id].toxic) for r in tox if r.held_out and r.doc_id in labels]
    assert sum(r.predicted for r, y in held if y) >= 0.7 * sum(y for _, y in held)
    assert not sum(r.predicted for r, y in held if not y)
    good = queries()["op9_quality"](spark, SF).collect()
    assert len(good) == len(tox)
    right = [r.good == labels[r.doc_id].quality for r in good if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean(right) > 0.97


def plain_strength(groups, rate_of, overall):
    n, good, squares = (np.array([g[k] for g in groups], float) for k in range(3))
    rate = good / n
    k = len(groups)
    within = (squares - good * rate).sum() / max(n.sum() - k, 1)
    between = (n * (rate - overall) ** 2).sum() / max(k - 1, 1)
    size = (n.sum() - (n * n).sum() / n.sum()) / max(k - 1, 1)
    extra = (between - within) / max(size, 1)
    return quality.STRONGEST if extra <= 0 else min(quality.STRONGEST, max(quality.WEAKEST, within / extra))


def test_sites_are_shrunk_toward_hosts_and_hosts_toward_all(spark):
    pick = random.Random(6)
    rows = []
    for h in range(6):
        for p in range(4):
            rows += [(f"h{h}", f"p{p}", min(0.99, max(0.01, pick.gauss(0.2 + 0.1 * h + 0.02 * p, 0.2)))) for _ in range(pick.randint(1, 60))]
    found = quality.sites(spark.createDataFrame(rows, "host string, path string, chance double")).collect()
    overall = np.mean([r[2] for r in rows])

    def group(key):
        own = {}
        for r in rows:
            g = own.setdefault(key(r), [0, 0.0, 0.0])
            own[key(r)] = [g[0] + 1, g[1] + r[2], g[2] + r[2] ** 2]
        return own

    hosts, paths = group(lambda r: r[0]), group(lambda r: r[:2])
    by_host, by_path = plain_strength(list(hosts.values()), None, overall), plain_strength(list(paths.values()), None, overall)
    assert len(found) == len(paths)
    for r in found:
        n, good, _ = hosts[r._host]
        host_rate = (good + by_host * overall) / (n + by_host)
        n, good, _ = paths[r._host, r._path]
        assert r.host_rate == pytest.approx(host_rate) and r.path_rate == pytest.approx((good + by_path * host_rate) / (n + by_path))


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "plain words of a text. " * 9 if i % 2 else "###%%% $$$ " * 9, "s") for i in range(40)]
    rows += [(None, None, None), (900, "", "s"), (901, "plain words of a text. " * 20_000, "s"), (1, rows[1][1], "s")]
    docs = table(spark, rows)
    judged = quality.assess(docs, quality.train(docs, labels)).collect()
    assert len(judged) == len(rows) and all(0 < r.quality < 1 for r in judged)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 40} == set(range(1, 40, 2))
    assert quality.assess(table(spark, []), quality.train(table(spark, []), labels)).count() == 0


def brute(rows, k=20):
    found = {}
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q and len(w) == len(v))
            found[q] = [(i, -s) for s, i in scores[:k]]
    return found


def test_neighbours(spark, monkeypatch):
    assert ann.chi_square(ann.stopping_ratio(0.9, 8), 8) == pytest.approx(0.9)
    assert ann.stopping_ratio(0.95, 8) == pytest.approx(15.507, abs=0.01)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(24)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[40][1]) for i in range(60)] + [(5000, [1.0, 2.0]), (5001, [2.0, 2.0])]
    broken = [(6000, None), (6020, [0.0] * 24), (6040, [float("nan")] + [1.0] * 23), (6060, [None, 1.0]), (6080, []), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + broken + rows[:30]], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    found = {}
    for r in sorted(ann.search(df, block=500).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    want = brute(rows)
    assert found.keys() == want.keys()
    assert found[5000] == want[5000]
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.95
    given = dict(rows)
    assert all(s == float((np.array(given[q]) * np.array(given[i])).sum()) for q in found for i, s in found[q])
    assert ann.search(df.filter(F.lit(False))).count() == 0
    everything = ann.search(df, block=500, chance=1 - 1e-12)
    exact = {}
    for r in sorted(everything.collect(), key=lambda r: (r.query_id, r["rank"])):
        exact.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert exact == want


def test_cells_and_stopping_leave_most_candidates_out(spark, monkeypatch):
    """Where vectors have groups, queries are sent to few cells and few candidates are verified; a vector that a third of
    all rows hold is one point."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    centres *= 5 / np.sqrt((centres * centres).sum(1, keepdims=True))
    rows = [(i, (centres[i // 20 % 40] + 0.05 * rng.standard_normal(32)).tolist()) for i in range(4000)]
    rows += [(10_000 + i, rows[0][1]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "QUERY_BLOCK", 64)
    found = {}
    verified = {}
    for r in ann.search(df, block=256).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        verified[r.query_id] = r.verified
    want = brute(rows)
    assert found.keys() == want.keys()
    hits = sum(len({i for _, i, _ in found[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.95
    assert np.mean(list(verified.values())) < 4000 / 3
    assert sorted(found[10_020])[:3] == [(k + 1, i, s) for k, (i, s) in enumerate(want[10_020][:3])]


def test_cells_share_points_evenly():
    points = np.random.default_rng(4).standard_normal((5000, 4))
    cells = ann.cut_cells(points, 20)
    counts = np.bincount(cells.of(points), minlength=cells.number)
    assert cells.number == 20 and counts.min() > 100 and counts.max() < 400
    assert ann.cut_cells(np.ones((50, 4)), 8).number == 1 and set(ann.Cells().of(points)) == {0}


def test_spaced_letters_are_one_lattice():
    text = "you are a moron and he is an idiot or a clown who sat on the trash"
    scorer = toxicity.Scorer(toxicity.count_trigrams([text] * 200), {w: 5.0 for w in ("moron", "idiot", "clown", "trash")})
    for bad in (
        "i d i o t.", "i d i o t, and", "(i d i o t)", "m o r 0 n!", "t r @ $ h", "c  l  o  w  n", "m\no\nr\no\nn", "c - l - o - w - n",
        "you are a i d i o t", "i d i o t !", "i dd i oooo t", "M O R O N and", "m o r o n a n d i d i o t",
    ):
        assert scorer.score(bad) >= toxicity.THRESHOLD, bad
    for fine in ("y o u, a r e", "(1 2 3 4)", "a a a a.", "1. a b c", "! ! ! $ $ $", "$" * 50_000):
        assert scorer.score(fine) < toxicity.THRESHOLD, fine


def test_long_and_fully_disguised_words_are_decoded():
    text = "you are a moron and these are idiots or a clown who sat on the trash of the asses"
    scorer = toxicity.Scorer(toxicity.count_trigrams([text] * 200), {w: 5.0 for w in ("moron", "idiots", "clown", "trash", "asses")})
    for bad in ("cl" + "o" * 60 + "wn", "i.....d.....i.....o.....t.....s..........x".rstrip("x") + ".", "m" + "-" * 50 + "oron", "1d1075", "4553s", "45535", "@$$3$"):
        assert scorer.score(bad) >= toxicity.THRESHOLD, bad
    for fine in ("2019", "57100", "3.14", "12:30", "+49-170-1234567", "9f86d081884c7d659a2feaa0c55ad015", "x" * 100_000, "aB3d9" * 20_000):
        assert scorer.score(fine) < toxicity.THRESHOLD, fine


def test_rows_of_one_id_are_judged_each(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    good, poor = "plain words of a text. " * 9, "###%%% $$$ " * 9
    rows = [(i, good if i % 2 else poor, "s") for i in range(40)] + [(1, poor, "s"), (None, good, "s"), (None, poor, "s")]
    kept = quality.keep_good(table(spark, rows), labels).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, *range(1, 40, 2)] and {r.text for r in kept} == {good}
