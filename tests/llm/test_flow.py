"""Mixing, archives, tokens and the pipeline."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from siltworks.llm import bpe, mixing, warc
from siltworks.llm.text import words


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    total, weights, limits = 2400.0, {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 20, "b": 2000, "c": 1000, None: 180}
    want = dict.fromkeys(weights, 0.0)
    left, open_ = total, set(weights)
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level >= limits[s]}
        if not over:
            break
        left -= sum(limits[s] for s in over)
        open_ -= over
        want |= {s: limits[s] for s in over}
    want |= {s: weights[s] * level for s in open_}
    assert got == pytest.approx(want)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, f"s{0 if i % 3 else i % 7}", rng.randrange(1, 400)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    taken, target = {}, {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)


def test_long_texts_count_whole(spark):
    docs = spark.createDataFrame([(1, "w " * 1_500_000, "s"), (2, "a b c", "s"), (3, "d\x0be", "t")], "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in mixing.mix_report(docs).collect()}
    assert {i: r["size"] for i, r in out.items()} == {1: 1_500_000, 2: 3, 3: 2} and out[3]["target"] == 4.0 and out[3]["taken"] == 4


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mix_report(odd_docs)
    assert out.count() == odd_docs.count() and out.where("taken > 2 * size OR taken < 0 OR target IS NULL").count() == 0
    assert mixing.mix_report(no_docs).count() == 0
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    nothing = odd_docs.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix_report(nothing).agg(F.sum("taken"), F.max("target")).first() == (0, 0.0)


def test_archives_round_trip(spark, tmp_path):
    rows = [
        (5, "http://a/\r\nX: y", "same"), (2, "http://b", "same"), (9, "http://c", "same"), (3, None, None), (1, "http://d", ""),
        (7, "http://e", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (8, "http://f", "é\r\n\r\n€"), (2, "http://b", "same"),
    ]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, record_type string")
    resolved = warc.resolve_revisits(pages)
    warc.write_warc(warc.warc_records(resolved), str(tmp_path / "w"), records_per_file=2)
    read = {(r["page_id"], r["record_type"]): r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert bytes(read["8", "response"]["payload"]).decode() == "é\r\n\r\n€" and bytes(read["7", "response"]["payload"]).startswith(b"WARC/1.1")
    assert bytes(read["5", "revisit"]["payload"]) == b"" and read["5", "revisit"]["refers_to_record"] == read["2", "response"]["record_id"]
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.warc_report(pages).collect())
    assert got == sorted([(5, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (9, 4, "revisit", 2), (3, 0, "revisit", 1), (1, 0, "response", None), (7, 31, "response", None), (8, 9, "response", None)], key=lambda x: (x[0],))
    big = warc.resolve_revisits(pages, least_bytes=5)
    assert big.where("record_type = 'revisit'").count() == 0
    assert warc.warc_report(pages.where("false")).count() == 0
    for broken in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", b"x", b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_archive(broken))


def test_revisits_of_repeated_ids(spark):
    """Rows that share a page id but not a payload have records of their own."""
    rows = [(1, "A"), (2, "A"), (1, "BBBB"), (3, "BBBB"), (None, "A"), (None, "own"), (None, "own"), (4, None)]
    pages = spark.createDataFrame([(i, f"http://{k}", t) for k, (i, t) in enumerate(rows)], "page_id long, url string, html string")
    got = sorted(map(str, (tuple(r) for r in warc.warc_report(pages).collect())))
    want = []
    for i, t in rows:
        data = (t or "").encode()
        ids = [k for k, u in rows if (u or "") == (t or "") and k is not None]
        again = bool(ids) and i != min(ids)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append(str((i, len(data), digest, "revisit" if again else "response", min(ids) if again else None)))
    assert got == sorted(want)


def test_archive_headers(spark, tmp_path):
    texts = ["WARC/1.1\r\n" * 3, "WARC/WARC/1.1\r\nWARC/1.1\r", "x" * 3_000_000, "WARC/1.1\r\n" * 3]
    pages = spark.createDataFrame([(i, f"http://{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    records = warc.warc_records(warc.resolve_revisits(pages), date="2021-02-03T04:05:06Z")
    warc.write_warc(records, str(tmp_path / "a"))
    read = warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read if r["record_type"] == "response"} == {str(i): t for i, t in enumerate(texts[:3])}
    assert sorted(r["record_type"] for r in read) == ["response", "response", "response", "revisit", "warcinfo"]
    assert len({r["record_id"] for r in read}) == 5
    head = next(r["record"] for r in records.collect() if "\nWARC-Type: revisit" in r["record"])
    assert "WARC-Refers-To-Target-URI: http://0\r\nWARC-Refers-To-Date: 2021-02-03T04:05:06Z\r\n" in head
    wrong = spark.createDataFrame([(head.replace("sha1:", "sha1:X"),)], "record string")
    warc.write_warc(wrong, str(tmp_path / "b"))
    assert warc.read_warc(spark, str(tmp_path / "b")).collect()[0]["payload_digest"].startswith("X")


def test_a_wrong_digest_is_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    whole = warc.warc_records
    monkeypatch.setattr(warc, "warc_records", lambda df: whole(df.withColumn("payload_digest", F.lit("WRONG"))))
    with pytest.raises(Exception, match="no payload with the stated digest"):
        warc.warc_report(pages).collect()


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(bpe.tokenizer_file())


def test_tokens_equal_the_library(spark, ranks, sf_dir, odd_docs, no_docs):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "   \n\n x  'll don't 12３ 日本語 🙂‍↔️  　 a b"), (-4, "<|endoftext|> " + "ab" * 3000), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_bpe(docs, ranks, public_tokenizers.PATTERN, block_chars=5_000).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in rows}
    back = bpe.decode_bpe(bpe.encode_bpe(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back.collect()} == {i: t or "" for i, t in rows}
    report = {r["doc_id"]: r for r in bpe.bpe_report(docs).collect()}
    for i, t in rows[-30:]:
        ids = library.encode_ordinary(t or "")
        assert report[i]["n_tokens"] == len(ids) and report[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert report[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.bpe_report(odd_docs).count() == odd_docs.count()
    assert bpe.bpe_report(no_docs).count() == 0


def test_few_buckets_and_a_very_long_text(spark, ranks, no_docs):
    """More partitions than buckets are allowed, and words that a task forgets on its way."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(200)))) for i in range(300)]
    rows.append((300, "abc déf, " * 60_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    key, before = "spark.sql.sources.bucketing.maxBuckets", spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    try:
        spark.conf.set(key, "4")
        got = {r["doc_id"]: r["ids"] for r in bpe.encode_bpe(docs, ranks, public_tokenizers.PATTERN, block_chars=20_000).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {i: library.encode_ordinary(t) for i, t in rows}


def test_inclusion_rates_follow_their_odds(spark):
    """Over many like sources a document is drawn as often as its expected copies say; all come near their targets."""
    rng, kinds = random.Random(3), (20, 60, 200, 500)
    line = [rng.choice(kinds) for _ in range(600)]
    rows = [(1000 * s + i, f"s{s:03d}", z) for s in range(30) for i, z in enumerate(line)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix_sources(docs, share=0.9).collect()
    size, mean = sum(line), sum(line) // len(line)
    merit = {z: mean * mixing.MERITS // (mean + z) for z in kinds}
    average = sum(merit[z] * z for z in line) / size
    for turn in range(3):
        mine = [r for r in out if int(r["source"][1:]) % 3 == turn]
        ratio = mine[0]["target"] / size
        want = {z: ratio * (1 + min(mixing.SPREAD, 2 / ratio - 1) * (merit[z] - average) / mixing.MERITS) for z in kinds}
        assert sum(want[z] * z for z in line) == pytest.approx(mine[0]["target"]) and len(set(want.values())) == 4
        for z in kinds:
            got = [r["copies"] for r in mine if r["size"] == z]
            assert abs(sum(got) / len(got) - want[z]) < 0.05 and set(got) <= {int(want[z]), int(want[z]) + 1}
        taken = dict.fromkeys((r["source"] for r in mine), 0)
        for r in mine:
            taken[r["source"]] += r["taken"]
        assert all(abs(r["target"] - taken[r["source"]]) < 30 for r in mine)


def test_a_very_long_document_does_not_keep_its_source_from_the_target(spark):
    rng = random.Random(7)
    missed = []
    for seed in range(6):
        rows = [(i, "s", rng.randrange(50, 1000)) for i in range(400)] + [(400 + i, "s", 100_000) for i in range(3)] + [(900, "t", 10**6), (901, None, 0)]
        out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"), seed=seed, share=0.4).collect()
        mine = [r for r in out if r["source"] == "s"]
        missed.append(mine[0]["target"] - sum(r["taken"] for r in mine))
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert max(missed) < 50 and min(missed) > -50


def test_stages_in_order(spark, sf_dir, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "minhash_dedup", "mix_sources", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, last = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, last, sf_dir)
        if k < 4:
            assert out.columns == columns
        last = spark.createDataFrame(out.toPandas(), out.schema)
    want = sorted((r["doc_id"], r["ids_sha256"]) for r in last.collect())
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and len(got) > docs.count() / 2
    texts = [r["text"] for r in corpus_pipeline.distinct_texts(spark, docs, sf_dir).collect()]
    assert len({t.lower() for t in texts}) == len(texts)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs.withColumn("n_chars", F.lit(0).cast("long")), sf_dir).count() == 0


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_stages_on_odd_rows(spark, sf_dir, odd_docs):
    """Nulls, empties, ties, repeated rows and columns that clash with the operators': what each stage makes of them."""
    clash = odd_docs.withColumns({"copies": F.lit(9), "taken": F.lit(9), "keep_id": F.lit("x"), "__row": F.lit(1), "clean_text": F.lit("y"), "text_sha256": F.lit("z")})
    good = "This is a proper line of text with its own words and a mark at the end."
    more = spark.createDataFrame([(60, good), (61, good), (61, good), (None, good), (62, good.upper()), (63, good[:-1] + " too."), (64, None)], "doc_id long, text string")
    docs = clash.unionByName(more, allowMissingColumns=True)
    clean = corpus_pipeline.clean(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert rows_of(clean, "doc_id") == sorted([(60,), (61,), (61,), (None,), (62,), (63,)], key=str)
    assert {(r["copies"], r["text_sha256"]) for r in corpus_pipeline.distinct_texts(spark, clash, sf_dir).collect()} == {(9, "z")}
    distinct = corpus_pipeline.distinct_texts(spark, docs, sf_dir)
    assert distinct.columns == docs.columns
    assert rows_of(distinct.where("doc_id >= 60 OR doc_id IS NULL"), "doc_id") == sorted([(62,), (63,), (64,), (None,)], key=str)
    near = corpus_pipeline.distinct_enough(spark, docs, sf_dir)
    assert near.columns == docs.columns
    assert rows_of(near.where("doc_id >= 60"), "doc_id") == [(60,), (64,)] and near.where("doc_id < 3").count() == 3
    mixed = corpus_pipeline.mix(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and {r["copies"] for r in mixed.where("doc_id < 60").collect()} <= {9}
    times = dict(mixed.groupBy("doc_id", "text").count().rdd.map(lambda r: ((r[0], r[1]), r[2])).collect())
    assert all(n <= 2 * docs.where(F.col("doc_id").eqNullSafe(i) & F.col("text").eqNullSafe(t)).count() for (i, t), n in times.items())
    ids = corpus_pipeline.tokens(spark, docs, sf_dir)
    assert ids.count() == docs.count() and {r["n_tokens"] for r in ids.where("doc_id = 64").collect()} == {0}


def test_stages_keep_long_texts_whole(spark, sf_dir):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) + "."
    text = "\n".join(line() for _ in range(20_000))
    docs = spark.createDataFrame([(i, f"{text}\n{i}.", "s", "en", 0) for i in range(3)] + [(3, line(), "s", "en", 0)], "doc_id long, text string, source string, lang string, n_chars long")
    clean = corpus_pipeline.clean(spark, docs, sf_dir)
    assert {r["doc_id"]: len(r["text"]) for r in clean.collect()} == {r["doc_id"]: len(r["text"]) for r in docs.collect()}
    assert corpus_pipeline.distinct_texts(spark, clean, sf_dir).count() == 4
    kept = corpus_pipeline.distinct_enough(spark, clean, sf_dir)
    assert rows_of(kept, "doc_id") == [(0,), (3,)]
    assert {r["decoded_sha256"] for r in corpus_pipeline.tokens(spark, kept, sf_dir).collect()} == {hashlib.sha256(r["text"].encode()).hexdigest() for r in kept.collect()}


def test_texts_of_the_mix_do_not_shuffle(spark):
    """Documents come out as often as the report says; those behind the filter are told apart without a join."""
    rows = [(i, "word " * (1 + i * 7 % 40), ["a", "b", None][i % 3], i) for i in range(600)] + [(5, "word " * 36, None, 9), (5, "word " * 36, None, 9), (None, "x y", "a", 1), (None, None, "b", 2), (700, "", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    key = lambda r: (str(r["doc_id"]), r["source"] or "", r["size"])
    want = {}
    for r in mixing.mix_sources(docs.withColumn("size", F.size(words(F.col("text"))))).collect():
        want[key(r)] = want.get(key(r), 0) + r["copies"]
    mixed = mixing.mixed_documents(docs)
    got = {}
    for r in mixed.withColumn("size", F.size(words(F.col("text")))).collect():
        got[key(r)] = got.get(key(r), 0) + 1
    assert got == {k: n for k, n in want.items() if n} and mixed.columns == docs.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixing.mixed_documents(docs)
        plan = mixed._jdf.queryExecution().optimizedPlan().toString()
        again = {}
        for r in mixed.withColumn("size", F.size(words(F.col("text")))).collect():
            again[key(r)] = again.get(key(r), 0) + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert again == got and "Union" in plan
    # picks are joined below the union, on the one side that the filter lets through
    below = plan.split("Union", 1)[1]
    assert below.count("__pick") > 0 and plan.split("Union", 1)[0].count("__i") == 0
