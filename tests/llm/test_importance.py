"""Importance resampling against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter

from siltworks.llm import importance


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def _brute(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    def features(text):
        ws = _words(text)
        return [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    s, t = Counter(b for _, text in docs for b in features(text)), Counter(b for text in target for b in features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(S + buckets) / (float(s[b] + 1) * float(T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        fs = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in fs)
        out.append([i, len(fs), len(_words(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = rank + 1
    return out


def _key(rows):
    return sorted(map(str, map(tuple, rows)))


def _docs():
    kinds = ["alpha beta gamma delta", "The QUICK brown fox", "mots français à décrire", "don't x2 7up", "数 据 data"]
    rows = [(i, " ".join([kinds[i % 5], kinds[(i * 7) % 3]] * (1 + i % 9))) for i in range(120)]
    rows += [(200 + i, "copied words " * 30) for i in range(60)] + [(300, None), (301, ""), (302, " \n\t"), (303, "."), (None, "no id " * 20)]
    return rows + [(5, rows[5][1]), (304, "one long text " * 40_000)]


def test_importance_by_brute_force(spark):
    docs, target = _docs(), ["quick fox data", None, "", "quick brown 7up", "quick brown 7up"]
    df = spark.createDataFrame([(i, t, 1, 2, "y") for i, t in docs], "doc_id long, text string, rank int, digest int, copies string")
    tf = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert _key(importance.importance_report(df, tf).collect()) == _key(_brute(docs, target))
    got = importance.importance_report(df, tf, percent=40, least_words=3, longest=3, buckets=64, seed=7)
    assert _key(got.collect()) == _key(_brute(docs, target, 40, 3, 3, 64, 7))


def test_drawn_documents_are_whole(spark):
    docs, target = _docs(), ["quick fox data"]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int")
    tf = spark.createDataFrame([(0, target[0])], "item_id long, text string")
    want = sorted(str(r[0]) for r in _brute(docs, target, 30) if r[5] is not None)
    out = importance.resample(df, tf, 30)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_importance_of_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([], "text string")
    out = importance.importance_report(odd_docs, target).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert _key(out) == _key(_brute(docs, []))
    assert importance.importance_report(no_docs, odd_docs).count() == 0 and importance.resample(no_docs, odd_docs).count() == 0


def test_importance_equals_itself_over_other_partitions(spark):
    docs, target = _docs(), ["quick fox data"]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tf = spark.createDataFrame([(target[0],)], "text string")
    assert _key(importance.importance_report(df.repartition(9), tf).collect()) == _key(importance.importance_report(df.coalesce(1), tf).collect())
