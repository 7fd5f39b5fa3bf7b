"""Sharding, fingerprints, line dedup and chat against plain Python over small tables."""

import hashlib
import random
import re
import unicodedata
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from rulestone.llm import chat, fingerprint, linededup, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lines string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


def make(seed=1, n=60):
    pick = random.Random(seed)
    words = ["a", "B", "né", "ﬁx", "Straße", "x\ty", "", "the", "Of"]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(pick.choice(words) for _ in range(pick.randint(0, 3))) for _ in range(pick.randint(0, 7)))
        rows.append((i * 7 - 50, text, pick.choice(["en", None]), pick.choice(["s", "t", None]), len(text)))
    rows += [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "\n".join(["same"] * 9), "en", "s", 40)]
    return rows + [(r[0] + 10_000, *r[1:]) for r in rows[:15]]


def test_curve_is_a_path(spark):
    """Each index once, and neighbours on the curve are neighbours in space."""
    for n, bits in ((2, 3), (3, 2)):
        axes = [F.col(f"c{k}") for k in range(n)]
        grid = spark.range(1 << n * bits).select(
            *[F.shiftright("id", bits * k).bitwiseAND((1 << bits) - 1).cast("int").alias(f"c{k}") for k in range(n)]
        )
        found = {r["i"]: r[:n] for r in grid.select(*axes, sharding.curve_index(axes, bits).alias("i")).collect()}
        assert sorted(found) == list(range(1 << n * bits))
        for i in range(len(found) - 1):
            assert sum(abs(a - b) for a, b in zip(found[i], found[i + 1], strict=True)) == 1


@pytest.mark.parametrize("shards", [8, 3])
def test_shards(spark, shards):
    rows = make()
    rows += rows[:2]
    found = sharding.assign(table(spark, rows), shards).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found) == sorted(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    counts = [0] * shards
    for r in sorted(found, key=lambda r: (r.shard, r.slot)):
        assert r.slot == counts[r.shard]
        counts[r.shard] += 1
    assert max(counts) - min(counts) <= 1
    order = [r.cell for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.assign(table(spark, []), shards).count() == 0


def test_shards_can_be_skipped_by_ranges_of_every_dimension(spark):
    """A filter on one value of a dimension needs few shards: their ranges overlap little."""
    pick = random.Random(2)
    rows = [(i, "t", pick.choice("abcd"), f"src{pick.randrange(20):02}", pick.randrange(5000)) for i in range(4000)]
    found = {r.doc_id: r.shard for r in sharding.assign(table(spark, rows)).collect()}
    for of in (lambda r: r[2], lambda r: r[3], lambda r: r[4]):
        ranges = [(min(own), max(own)) for k in range(8) if (own := [of(r) for r in rows if found[r[0]] == k])]
        values = sorted(map(of, rows))
        needed = [sum(lo <= v <= hi for lo, hi in ranges) for v in values[:: len(values) // 40]]
        assert sum(needed) / len(needed) <= 5.2, needed
    assert sharding.cuts(table(spark, rows))["lang"] == (["b", "c", "d"], [4, 12, 20, 28])


def test_a_cell_of_alike_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_PARTS", 16)
    rows = [(None, "same", "en", "s", 4)] * 3000 + [(i, None, None, None, None) for i in range(5)]
    found = sharding.assign(table(spark, rows))
    counts = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1
    assert found.select("shard", "slot").distinct().count() == len(rows)


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = make(3, 40) + [(None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (7, "twice", "en", "s", 5), (7, "other", "en", "s", 5)]
    docs = table(spark, rows).withColumnRenamed("n", "shard")
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    found = spark.read.parquet(str(tmp_path / "shards"))
    counts = [r["count"] for r in found.groupBy("_shard").count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 1
    assert sorted(map(repr, found.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def canon(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", folded).strip(" ")


def digest(text):
    data = canon(text).encode()
    second = xxhash.xxh64_intdigest(data, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42))
    return xxhash.xxh64_hexdigest(data, 42), second


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 4)
    rows = sorted(make(), key=lambda r: r[0])
    found = sorted(fingerprint.fingerprints(table(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    for k, r in enumerate(found):
        text, following = rows[k][1] or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint[:16] == digest(text)[0] and int(r.fingerprint[16:], 16) == digest(text)[1]
        assert r.edited_fingerprint[:16] == digest(edited)[0]
        assert r.near_edited == float(canon(text) == canon(edited))
        assert r.near_next == float(canon(text) == canon(following))
    assert fingerprint.fingerprints(table(spark, [])).count() == 0
    alone = fingerprint.fingerprints(table(spark, [(None, "ab", None, None, None)])).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(None, 1.0)]


def test_colliding_digests_are_told_apart(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(["aa", "bb", "AA", "c", "bb ", "dd"])]
    found = fingerprint.fingerprints(table(spark, rows), lambda c: F.length(c).cast("string")).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {0: "2", 1: "2-2", 2: "2", 3: "1", 4: "2-2", 5: "2-3"}
    # edited: ab, ba, ac, c, bd, da
    assert {r.doc_id: r.edited_fingerprint for r in found} == {0: "2-0", 1: "2-0", 2: "2-0", 3: "1", 4: "3", 5: "2-0"}


def test_fingerprints_of_shared_ids_and_long_texts(spark, monkeypatch):
    """Ids that very many rows share, with one text and with many, none, outliers, and a very long text: each row follows
    another, in order of ids, and all of them make one round."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 8)
    rows = [(5, "same text") for _ in range(90)] + [(6, f"text {i}") for i in range(120)] + [(None, f"t {i}") for i in range(40)] + [(None, "idle")] * 30
    rows += [(i, f"plain {i}") for i in range(10, 60)] + [(1 << 62, "far"), (-(1 << 62), "x" * 300_000)]
    docs = table(spark, [(*r, None, None, None) for r in rows])
    met = fingerprint._neighbours(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in met) == sorted((i or 0, t) for i, t in rows)
    assert sorted(r.following for r in met) == sorted(t for _, t in rows)
    order = sorted({i for i, _ in rows if i is not None})
    after = dict(zip([None, *order], [*order, None], strict=True))
    for i in after:
        of = {t for j, t in rows if j == i}
        leaves = [r for r in met if r.doc_id == i and r.following not in of]
        assert len(leaves) == 1 and leaves[0].following in {t for j, t in rows if j == after[i]}
    assert all(r.canon == canon(r.text) and r.next_canon == canon(r.following) for r in met)
    assert fingerprint.fingerprints(docs).count() == len(rows)


def test_steps_up_to(spark):
    cuts = [-5, 0, 3, 9, 12, 40, 41]
    values = [-6, -5, 2, 3, 41, 99]
    found = spark.createDataFrame([(v,) for v in values], "v long").select(fingerprint._steps_up_to(cuts, F.col("v"), 3).alias("n")).collect()
    assert [r.n for r in found] == [sum(c <= v for c in cuts) for v in values]


def plain_dedup(rows):
    """rows of distinct ids, sorted: text, n_removed by id."""
    first, gone = {}, {}
    solid = {r[0]: [(i, line.strip(" \t\r\x0b\f")) for i, line in enumerate((r[1] or "").split("\n")) if line.strip(" \t\r\x0b\f")] for r in rows}
    for r in rows:
        lines = [line for _, line in solid[r[0]]]
        for p in range(len(lines) - 2):
            at = first.setdefault(tuple(lines[p : p + 3]), (r[0], p))
            if at != (r[0], p):
                begin = max(p, at[1] + 3) if at[0] == r[0] else p
                gone.setdefault(r[0], set()).update(solid[r[0]][q][0] for q in range(begin, p + 3))
    return {
        r[0]: ("\n".join(line for i, line in enumerate(r[1].split("\n")) if i not in gone[r[0]]) if r[0] in gone else r[1], len(gone.get(r[0], ())))
        for r in rows
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    pick = random.Random(seed)
    rows = make(seed)
    for i in range(40):
        text = "\n".join(pick.choice(["p", "q ", "", "\tr"]) for _ in range(pick.randint(0, 12)))
        rows.append((50_000 + i, text, "en", "s", len(text)))
    rows.sort(key=lambda r: r[0])
    found = linededup.drop_repeats(table(spark, rows))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "lines", "n", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in found.collect()} == plain_dedup(rows)


def test_line_dedup_of_repeated_and_idless_rows(spark):
    passage = "one\ntwo\nthree"
    rows = [(5, passage, None, None, None), (5, passage, None, None, None), (None, passage + "\nfour", None, None, None), (6, None, None, None, None)]
    found = linededup.drop_repeats(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "-") for r in found if r.doc_id != 5) == [(0, passage + "\nfour"), (6, "-")]
    assert [r.text for r in found if r.doc_id == 5] == ["", ""]
    assert linededup.drop_repeats(table(spark, [])).count() == 0


def test_line_dedup_passes_columns_of_any_name_on(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5, "x", 7), (2, "a\nb\nc\nd", 6, "y", 8)], "doc_id long, text string, _lost int, _LINES string, `_gone` int")
    found = linededup.drop_repeats(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, found.collect())) == [(1, "a\nb\nc", 5, "x", 7, 3, 0), (2, "d", 6, "y", 8, 4, 3)]
    clashing = docs.withColumnsRenamed({"_lost": "_first", "_LINES": "_by", "_gone": "_h1"})
    assert simhash.keep_one(clashing).columns == clashing.columns


def test_line_dedup_of_a_long_text_and_of_repeated_rows(spark):
    long = "\n".join(f"line {i % 9000}" for i in range(20_000))
    rows = [(1, long, None, None, None), *[(2, "line 5\nline 6\nline 7\nmine", None, None, None)] * 50]
    found = linededup.drop_repeats(table(spark, rows)).collect()
    assert {r.text for r in found if r.doc_id == 2} == {"mine"}
    assert [r.text for r in found if r.doc_id == 1] == [plain_dedup(rows[:1])[1][0]]


def test_chat(spark):
    talk = "conv_id long, turn long, role string, text string, n int"
    said = [("user", "hi"), ("assistant", "yes"), ("user", None), ("assistant", "")]
    rows = []
    for conv, turns in {1: said[:1], 2: said[:2], 3: said, 4: said, 5: [("user", "other")], 6: [("user", "hi"), ("assistant", "no")]}.items():
        rows += [(conv, k * 600, *turn, 1) for k, turn in enumerate(turns)]
    rows += [rows[0], (None, 0, "user", "lost", 1)]
    found = {r.conv_id: (r.n_turns, r.chat) for r in chat.render(spark.createDataFrame(rows, talk)).collect()}
    assert {k: v[0] for k, v in found.items()} == {3: 4, 5: 1, 6: 2}
    assert found[3][1] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.render(spark.createDataFrame([], talk)).count() == 0


def plain_chats(rows):
    """rows: conv_id, turn, role, text. The maximal conversations and their texts, by the hashes' order among ties."""
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, set()).add((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    talks = {c: [t[:1] + t[2:] for t in sorted(turns)] for c, turns in talks.items()}
    said = {c: [t[1:] for t in turns] for c, turns in talks.items()}
    stays = [c for c in said if not any(len(o) > len(said[c]) and o[: len(said[c])] == said[c] or (o == said[c] and d < c) for d, o in said.items())]
    return {c: "".join(f"<|{t[1]}|>\n{t[3]}<|end|>\n" for t in said[c]) for c in stays}


def test_chats_of_odd_turns_and_many_chunks(spark):
    """Null and negative turns, repeated rows, and a conversation of many chunks; numbers are unique within each."""
    pick = random.Random(7)
    rows = [(1, -5, "u", "a"), (1, None, "u", "b"), (2, None, "u", "b"), (3, -5, "u", "a"), (None, 1, "u", "x")]
    long = [(k * 7 - 3000, pick.choice("ua"), pick.choice(["x", None, ""])) for k in range(4000)]
    rows += [(10, *t) for t in long] + [(11, *t) for t in long[:3999]] + [(12, *t) for t in long[:1024]] + [(13, *t) for t in long[1:]]
    rows += [(20 + i, 0, "u", "x" * 200_000) for i in range(3)] + rows[:3] + rows[50:60]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, n int")
    assert {r.conv_id: r.chat for r in chat.render(docs).collect()} == plain_chats(rows)


def test_chats_whose_turns_share_a_number(spark):
    """Whatever order ties get, a conversation that ends in the middle of them is a prefix by it, and text follows it."""
    shared = [(1, 5, "u", t) for t in "abcdef"]
    talk = "conv_id long, turn long, role string, text string"
    order = [t[0] for t in re.findall(r"\n(.)<", chat.render(spark.createDataFrame(shared, talk)).first().chat)]
    assert sorted(order) == list("abcdef")
    rows = shared + [(2, 5, "u", t) for t in order[:4]] + [(3, 5, "u", t) for t in order[1:]] + shared
    assert {r.conv_id for r in chat.render(spark.createDataFrame(rows, talk)).collect()} == {1, 3}


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprint():
    pick = random.Random(3)
    for n in (0, 1, 3, 4, 5, 6, 50, 400):
        text = " ".join(pick.choice(["A", "bÉ", "c d", "\te\n", ""]) for _ in range(n))
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_sketches():
    """The first is the fingerprint; others are majorities over hashes mixed anew, by plain integers."""
    full = (1 << 64) - 1
    for text in ("", " \n", "one", "a b c d e", " ".join(f"w{i % 37}" for i in range(200))):
        words = text.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))] if words else []
        want = []
        for k in range(4):
            mixed = []
            for h in hashes:
                if k:
                    h = h + k * 0x9E3779B97F4A7C15 & full
                    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
                    h = (h ^ h >> 27) * 0x94D049BB133111EB & full
                    h ^= h >> 31
                mixed.append(h)
            want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed)))
        assert simhash.sketches(text, 5, 4) == want
        assert want[0] == simhash.fingerprint(text, 5)


def test_a_later_sketch_finds_what_the_first_misses(spark):
    """Pairs at a similarity of 0.8 or more that are over the budget in the first sketch and within it in another."""
    pick, found = random.Random(12), []
    while len(found) < 3:
        words = [f"w{pick.randrange(100_000)}" for _ in range(120)]
        copy = list(words)
        for at in pick.sample(range(120), 2):
            copy[at] = "other"
        both = " ".join(words), " ".join(copy)
        apart = [(a ^ b).bit_count() for a, b in zip(*(simhash.sketches(t, 5) for t in both), strict=True)]
        if apart[0] > simhash.BUDGET_AT_08 >= min(apart) and _jaccard(words, copy) >= 0.8:
            found.append(both)
    rows = [(i, t, None, None, None) for i, t in enumerate(t for pair in found for t in pair)]
    assert sorted(r.doc_id for r in simhash.keep_one(table(spark, rows)).collect()) == [0, 2, 4]


def plain_components(ids, prints, budget):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                label[root(i)] = root(j)
    least = {}
    for i, own in enumerate(ids):
        least[root(i)] = min(least.get(root(i), own), own)
    return {own: least[root(i)] for i, own in enumerate(ids)}


@pytest.mark.parametrize(("chunk", "few", "budget"), [(8192, 4096, 4), (16, 4096, 4), (8192, 2, 4), (64, 1, 8), (8192, 4096, 8)])
def test_trie_links_and_components(spark, chunk, few, budget):
    pick = random.Random(4)
    prints = [pick.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        near = pick.choice(prints[:8] + prints)
        for b in pick.sample(range(64), pick.randint(0, 6)):
            near ^= 1 << b
        prints.append(near)
    prints = list(dict.fromkeys(prints))
    ids = pick.sample(range(10_000), len(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame(list(zip(signed, ids, strict=True)), "fp long, node long")
    found = {r.node: r.component for r in simhash.components(simhash.links(distinct, budget, chunk, few)).collect()}
    want = plain_components(ids, prints, budget)
    assert {i: found.get(i, i) for i in ids} == want


def test_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(900))
    texts = [long, long + " more", None, "", "  \n", "quite another text of some words", long, "Quite Another text of some words"]
    rows = [(i + 3, t, None, None, None) for i, t in enumerate(texts)] + [(None, "nobody", None, None, None)]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert found == {3: 3, 4: 3, 5: 5, 6: 5, 7: 5, 8: 8, 9: 3, 10: 8, None: None}
    kept = simhash.keep_one(table(spark, rows + rows))
    assert kept.columns == table(spark, []).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 5, 8]
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def _jaccard(a, b):
    own = [set(zip(*(w[k:] for k in range(5)), strict=False)) for w in (a, b)]
    return len(own[0] & own[1]) / len(own[0] | own[1])


def test_candidates_are_verified(spark):
    """Within the bit budget by construction: a budget of 64 makes all texts candidates."""
    pick = random.Random(8)
    base = [[f"w{pick.randrange(10_000)}" for _ in range(80)] for _ in range(4)]
    texts = []
    for words in base:
        for n in (0, 1, 2, 6):
            copy = list(words)
            for at in pick.sample(range(80), n):
                copy[at] = f"v{pick.randrange(10_000)}"
            texts.append(copy)
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(texts[i], texts[j]) >= 0.8:
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    rows = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    docs = table(spark, rows)
    for chunk in (4, 512):
        own = simhash._texts(docs, 5)
        ids = {r.node: r.first.doc_id for r in own.collect()}
        found = simhash.components(simhash.verified_links(docs, own, 64, 5, chunk)).collect()
        sets = {}
        for r in found:
            sets.setdefault(r.component, set()).add(ids[r.node])
        assert sorted(map(sorted, sets.values())) == sorted(g for k in set(want) if len(g := [i for i, x in enumerate(want) if x == k]) > 1)
    assert sorted(r.doc_id for r in simhash.keep_one(docs, 64).collect()) == sorted(set(want))


def test_rows_of_one_id_are_told_apart(spark):
    """The copy of another document goes, the id's unique text stays, and neighbours of the two aren't merged."""
    pick = random.Random(9)
    a, b, c = (" ".join(f"w{pick.randrange(10_000)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, None, None, None), (2, a, None, None, None), (2, b, None, None, None), (3, b + " ", None, None, None), (2, c, None, None, None), (None, c, None, None, None)]
    kept = simhash.keep_one(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (2, b), (2, c)])


def test_lines_of_texts_that_share_an_id(spark):
    """A passage at the same place, and one line further, of different texts with one id or none."""
    head = "one\ntwo\nthree"
    for doc_id in (7, None):
        rows = [(doc_id, t, None, None, None) for t in (f"{head}\nmore", f"{head}\nother", f"zero\n{head}")]
        found = linededup.drop_repeats(table(spark, rows)).collect()
        assert sorted(r.n_removed for r in found) == [0, 3, 3]
        assert sum(head in r.text for r in found) == 1
