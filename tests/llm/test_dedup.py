"""Exact and near duplicates against brute force."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import exact_dedup, minhash, scale
from siltworks.llm.text import ascii_lower

SYLLABLES = "ba ke li mo nu ra se ti vo wa ex um or el in".split()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    words = lowered(text).encode().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else [tuple(words[i : i + size]) for i in range(len(words) - size + 1)])


def brute_classes(rows, size, num=80, den=100):
    """Least id of each id's class, by all pairs."""
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, size))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, sets


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))


def edited(rng, words, share):
    return [word(rng) if rng.random() < share else w for w in words]


def test_ascii_lower_only(spark, odd_docs):
    got = {r["doc_id"]: r["x"] for r in odd_docs.select("doc_id", ascii_lower(odd_docs.text).alias("x")).collect()}
    assert got[5] == lowered("ÉCOLE Ünïcode ÑANDÚ ςΣ İ")


def test_exact_dedup_of_odd_rows(spark, odd_docs, no_docs):
    out = exact_dedup.dedup_texts(odd_docs)
    assert out.columns[: len(odd_docs.columns) - 1] == [c for c in odd_docs.columns if c != "kept"]
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == odd_docs.count()
    assert rows[0, None]["keep_id"] == 1 and rows[0, None]["group_size"] == 2 and not rows[0, None]["kept"]
    assert {r["kept"] for (i, _), r in rows.items() if i == 4} == {False} and rows[50, rows[4, odd_docs.collect()[4]["text"]]["text"].upper()]["group_size"] == 3
    assert rows[None, "no id"]["kept"] and rows[None, "no id"]["keep_id"] is None
    assert all(r["text_sha256"] == hashlib.sha256(lowered(r["text"]).encode()).hexdigest() for r in rows.values())
    assert exact_dedup.dedup_texts(no_docs).count() == 0


def test_exact_dedup_of_one_large_group(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(3000)], "doc_id long, text string")
    out = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_report(docs).collect()}
    assert out == {i: (2999, 2000) if i % 3 else (i, 1) for i in range(3000)}


def test_exact_dedup_by_ranges_of_hashes(spark, odd_docs):
    """More rows than a filter may have bits for: each range has its own, and the result is the same."""
    docs = spark.createDataFrame([(i, f"text {i // 3 if i % 2 else i}") for i in range(2000)] + [(None, "text 4"), (5000, None)], "doc_id long, text string")
    digests = docs.withColumns({"text_sha256": exact_dedup.text_digest(docs.text), "kept": F.lit(7)})
    one, many = exact_dedup.exact_dedup(digests), exact_dedup.exact_dedup(digests, max_bits=8_000)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.select(*one.columns).collect()))


def test_long_texts_are_digested_whole(spark):
    long = "Wörter und Worte " * 300_000
    docs = spark.createDataFrame([(1, long), (2, long.upper().replace("Ö", "ö")), (3, long + "."), (4, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.dedup_report(docs).collect()} == {1: 2, 2: 2, 3: 3, 4: 4}


def test_filter_never_misses_a_repeat(spark):
    hashes = spark.range(5000).selectExpr("xxhash64(id % 4000) AS h")
    blocks = scale.repeat_filter(hashes, "h", 1 << 20)
    flagged = scale.may_repeat(hashes, "h", blocks, 1 << 20, "maybe").groupBy("h").agg({"maybe": "min", "*": "count"}).collect()
    assert all(r["min(maybe)"] for r in flagged if r["count(1)"] > 1)
    assert sum(r["min(maybe)"] for r in flagged if r["count(1)"] == 1) < 100


@pytest.mark.parametrize("size", [4, 5])
def test_near_dedup_by_brute_force(spark, size):
    rng = random.Random(size)
    rows, n = [], 0
    for _ in range(25):
        base = [word(rng) for _ in range(rng.randrange(3, 160))]
        for share in [0, 0.0] + [rng.choice((0.01, 0.02, 0.04, 0.06)) for _ in range(rng.randrange(0, 6))]:
            rows.append((n * 7 % 1009, " ".join(edited(rng, base, share))))
            n += 1
    common = " ".join(word(rng) for _ in range(20))
    rows += [(2000 + i, common + " " + " ".join(word(rng) for _ in range(rng.randrange(5, 80)))) for i in range(60)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "a b"), (3004, "A  b"), (3005, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, sets = brute_classes(rows, size)
    got = {r["doc_id"]: r for r in minhash.near_dedup(docs, shingle_words=size).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_copies_in_a_crowd(spark):
    """Far more near copies than a short list holds, many of them linked to a few others only."""
    rng = random.Random(11)
    rows = []
    for b in range(2):
        base = [word(rng) for _ in range(120)]
        rows += [(1000 * b + i, " ".join(edited(rng, base, 0.004 * (i % 15)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_classes(rows, 4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_dedup_report(docs).collect()}
    assert got == want and 20 < sum(i != c for i, c in want.items()) < 300


def test_own_values_do_not_hide_a_set_of_a_crowd(spark):
    """Half or more of the listed values of some documents are their own: the crowd's common text links them still."""
    rng, known = random.Random(5), minhash._WordHash()
    common = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join([*common, f"x{i}"])) for i in range(40)]
    shared = set(minhash.shingle_hashes(" ".join(common), 4, known).tolist())
    while len(rows) < 43:
        text = " ".join([*common, *(f"o{rng.randrange(10**9)}" for _ in range(95))])
        listed = minhash.shingle_hashes(text, 4, known)[: minhash.LISTED].tolist()
        if len(shared.intersection(listed)) <= minhash.LISTED // 2:
            rows.append((100 + len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_classes(rows, 4)
    assert set(want.values()) == {0}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_dedup_report(docs).collect()} == want


def classes_by_pairs_of_kinds(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in minhash.near_dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_crowd_of_supersets_is_one_class(spark):
    """One text of 400 shingles, and documents that are that text with up to 100 words of their own: all are linked."""
    rng = random.Random(21)
    common = [f"c{i}" for i in range(403)]
    rows = [(0, " ".join(common))]
    for i in range(1, 700):
        own = [f"o{i}x{j}" for j in range(100)]
        cut = rng.choice((0, 50, 100))
        rows.append((i, " ".join([*own[:cut], *common, *own[cut:]]) if cut in (0, 100) else " ".join([*common, *own[: rng.randrange(60, 100)]])))
    got = classes_by_pairs_of_kinds(spark, rows)
    assert set(got.values()) == {0}


def test_two_families_below_the_threshold_stay_apart(spark, monkeypatch):
    """One-word edits inside each family, two thirds of the shingles in common: pairs grow with documents, not with their square."""
    rng = random.Random(22)
    common, counted = [f"c{i}" for i in range(160)], []
    possible = minhash._Search.possible

    def count(self, pairs):
        counted.append(pairs.count())
        return possible(self, pairs)

    monkeypatch.setattr(minhash._Search, "possible", count)
    sizes = []
    for n in (150, 300):
        rows = []
        for i in range(2 * n):
            words = [*common, *(f"{'ab'[i % 2]}{j}" for j in range(38))]
            words[rng.randrange(len(words))] = f"e{i}"
            rows.append((i, " ".join(words)))
        counted.clear()
        got = classes_by_pairs_of_kinds(spark, rows)
        want, _ = brute_classes(rows, 4)
        assert got == want and 0 in want.values() and 1 in want.values()
        sizes.append(sum(counted))
    assert sizes[1] < 3 * sizes[0], sizes


def test_members_of_a_crowd_far_from_its_pivot_are_found(spark):
    """A chain of texts, each linked to the next only, inside a crowd that shares most of them."""
    rng = random.Random(23)
    base = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(40)]
    now, n = list(base), 100
    for step in range(12):
        at = step * 20
        now = [*now[:at], *(f"s{step}w{j}" for j in range(20)), *now[at + 20 :]]
        rows.append((n + step, " ".join(now)))
    rows += [(200 + i, " ".join(edited(rng, base, 0.05))) for i in range(60)]
    got = classes_by_pairs_of_kinds(spark, rows)
    want, _ = brute_classes(rows, 4)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_the_last_step_joins_all_that_is_linked(spark, seed):
    """Components cut at random: what the exact step finds joins every link between an open member and another component."""
    rng = random.Random(seed)
    rows = []
    for f in range(3):
        base = [f"f{f}w{i}" if rng.random() < 0.3 else f"c{i}" for i in range(120)]
        rows += [(100 * f + i, " ".join(edited(rng, base, rng.choice((0.0, 0.01, 0.02, 0.03, 0.05))) + [f"own{f}x{i}"] * rng.randrange(3))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    search = minhash._Search(docs, 4, 80, 100)
    of = {r["doc_id"]: r["v"] for r in search.sets.select("v", "place.doc_id").collect()}
    sets = {v: shingles(dict(rows)[i], 4) for i, v in of.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = {v: v for v in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(pairs):
        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)

    join(x for x in links if rng.random() < 0.03)
    start = {v: find(v) for v in sets}
    open_ = {v: rng.random() < 0.7 for v in sets}
    members = spark.createDataFrame([(v, len(sets[v]), start[v], open_[v]) for v in sets], "v long, n long, root long, open boolean")
    asked = [x for x in links if start[x[0]] != start[x[1]] and (open_[x[0]] or open_[x[1]])]
    found = [(r["a"], r["b"]) for r in search.confirmed(minhash._rest_pairs(search, members)).collect()]
    assert set(tuple(sorted(x)) for x in found) <= set(links) and asked
    join(found)
    assert all(find(a) == find(b) for a, b in asked)


def test_null_ids_link_by_their_text(spark):
    text = [f"t{i}" for i in range(200)]
    rows = [(None, " ".join(text)), (7, " ".join([*text[:-1], "other"])), (None, " ".join(f"u{i}" for i in range(50)))]
    out = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["component_id"]) for r in out) == ["7", "7", "None"]


def test_a_very_long_text_is_compared_whole(spark):
    text = [f"w{i}" for i in range(60_000)]
    other = [*text[:50_000], *(f"v{i}" for i in range(10_000))]
    rows = [(1, " ".join(text)), (2, " ".join([*text, "end"])), (3, " ".join(other)), (4, " ".join(other[:-1]))]
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 3}


def test_only_near_copies_go_where_ids_repeat_or_miss(spark):
    one, two, other, more = ([f"{k}{i}" for i in range(60)] for k in "abcd")
    rows = [(1, one), (7, [*one, "end"]), (7, other), (20, two), (None, [*two, "end"]), (None, more)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"].split()[0]) for r in minhash.drop_near_duplicates(docs).collect()}
    assert kept == {(1, "a0"), (7, "c0"), (20, "b0"), (None, "d0")}


def test_near_dedup_of_odd_rows(spark, odd_docs, no_docs):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.near_dedup(odd_docs).collect()}
    assert got[0, 0] == 0 and got[1, 0] == 1 and got[4, 9] == 4 and got[50, 9] == 4
    assert minhash.near_dedup(odd_docs).count() == odd_docs.count()
    assert minhash.near_dedup(no_docs).count() == 0
    kept = minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1


def test_shingle_hashes_tell_order_and_length():
    known = minhash._WordHash()
    one, two = minhash.shingle_hashes("a b c d", 4, known), minhash.shingle_hashes("b a c d", 4, known)
    assert len(one) == 1 and one[0] != two[0]
    assert minhash.shingle_hashes("a b", 4, known)[0] != minhash.shingle_hashes("b a", 4, known)[0]
    assert len(minhash.shingle_hashes("a a a a a a", 4, known)) == 1


def _newest(spark, name):
    """Files of the scratch table of this name that was written last, by folder of its range."""
    top = os.path.join(spark.conf.get("spark.checkpoint.dir"), "siltworks")
    path = max((os.path.join(top, d) for d in os.listdir(top) if d.startswith(name)), key=os.path.getmtime)
    return [os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")], path


def test_ranges_are_few_files_and_hold_no_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_FILES", 2)
    rows = [(i, f"text number {i % 700} " * 20, "e") for i in range(1000)] + [(5, "text number 5 " * 20, "e"), (None, "x", "f"), (None, "text number 6 " * 20, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(20)
    out = sorted(map(str, map(tuple, exact_dedup.drop_copies(docs, max_bits=4_000).collect())))
    files, path = _newest(spark, "hash-ranges")
    ranges = [d for d in os.listdir(path) if d.startswith("__range=")]
    assert len(ranges) == 5 and len(files) <= 2 * len(ranges)  # not one for each of 20 tasks
    assert "text" not in spark.read.parquet(path).columns
    best = {}
    for i, t, _ in rows:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert out == sorted(str(r) for r in rows if (-1 if r[0] is None else r[0]) == best[r[1]])


def test_texts_without_copies_do_not_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 9) for i in range(500)], "doc_id long, text string")
    out = exact_dedup.drop_copies(docs)
    assert out.count() == 500 and spark.read.parquet(_newest(spark, "dropped-copies")[1]).count() == 0
    # of the two branches only the one behind the filter, here empty, joins
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti") == 1


def test_margin_of_the_union_sketch():
    """The chance that the filter loses a pair at exactly 0.8, by the hypergeometric law, stays below the stated 3e-8."""
    least = 0.8 - minhash.MARGIN * math.sqrt(0.8 * 0.2 / minhash.SKETCH)
    most = math.ceil(least * minhash.SKETCH) - 1
    log_c = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    for union in (500, 1000, 5000, 50_000, 10**6):
        common, k = int(0.8 * union), minhash.SKETCH
        lost = sum(math.exp(log_c(common, i) + log_c(union - common, k - i) - log_c(union, k)) for i in range(max(0, k - union + common), most + 1))
        assert lost < 3e-8
    rng, lost = np.random.default_rng(2), 0
    for _ in range(20_000):  # and by drawing sketches
        lost += int(rng.hypergeometric(4000, 1000, 128)) <= most
    assert lost == 0


def test_form_letters_that_share_one_passage(spark, monkeypatch):
    """A shingle of every letter of a crowd is split among keys; classes equal brute force."""
    monkeypatch.setattr(minhash, "CROWD", 40)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([18, 19, 25]))])) for i in range(180)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(0, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_dedup_report(docs).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}
