"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from variorum.llm import bpe, common, exact, html, langid, licenses, packing, repetition, simhash, urlfilter, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, r string, t string, i int, d1 string, salt int, f1 int, len string, `__text` string, bin_id string"
LONG = " ".join(f"word{i} the of" for i in range(40_000))
ROWS = [
    (1, "The cat sat on the mat and then the dog came by to look at it.", "en"),
    (1, "The cat sat on the mat and then the dog came by to look at it.", "en"),
    (2, "The cat sat on the mat and then the dog came by to look at it.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \n\t ", "fr"),
    (None, "Le chat est sur la table et le chien dort dans le jardin.", "fr"),
    (None, None, None),
    (6, LONG, "en"),
    (7, "😀" * 50 + "é" * 3 + "\x00z", "fr"),
    (8, "Le chien dort.", "fr"),
    (8, "The dog sleeps.", "en"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "s", 0, "x", "x", "x", 1, "x", 1, 1, "x", "x", "x") for r in rows], SCHEMA)


STAGES = {
    "quality": lambda d: repetition.quality_filter(d),
    "language": lambda d: langid.language_filter(d, langid.train(d)),
    "exact": lambda d: exact.exact_dedup(d),
    "near": lambda d: simhash.near_dedup(d),
}
RESULTS = {
    "encode": lambda d: bpe.encode(d, long_bytes=1000, part=4000),
    "decode": lambda d: bpe.decode(bpe.encode(d)),
    "pack": lambda d: packing.pack(d),
    "licenses": lambda d: licenses.scan(d),
    "identify": lambda d: langid.identify(d, langid.train(d)),
    "exact_groups": lambda d: exact.exact_groups(d),
    "near_groups": lambda d: simhash.near_groups(d),
    "repetition": lambda d: repetition.repetition(d),
}


@pytest.mark.parametrize("name", [*STAGES, *RESULTS])
def test_empty_table(spark, name):
    assert ({**STAGES, **RESULTS}[name])(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_keep_rows_as_they_are(spark, name):
    d = frame(spark)
    out = STAGES[name](d)
    assert out.columns == d.columns
    before, after = Counter(d.collect()), Counter(out.collect())
    assert not after - before


def test_verdicts(spark):
    d = frame(spark)
    kept = lambda n: [(r.doc_id, r.text) for r in STAGES[n](d).collect()]
    quality = kept("quality")
    assert not any(t is None or not t.strip() for _, t in quality) and sum(i == 1 for i, _ in quality) == 2
    assert {i for i, _ in kept("language")} == {1, 2, 6, 7, 8, None}
    e = kept("exact")
    assert sorted(i for i, t in e if t and t.startswith("The cat")) == [1] and sum(t is None for _, t in e) == 2
    n = kept("near")
    assert sum(t is None for _, t in n) == 2 and 2 not in {i for i, _ in n} and sum(i == 8 for i, _ in n) == 2


def test_results_of_edge_rows(spark):
    d = frame(spark)
    tokens = {(r.doc_id, None if r.tokens is None else len(r.tokens)) for r in RESULTS["encode"](d).collect()}
    assert (3, None) in tokens and (4, 0) in tokens
    back = Counter((r.doc_id, r.decoded) for r in RESULTS["decode"](d).collect())
    assert back == Counter((r[0], r[1]) for r in ROWS)
    bins = RESULTS["pack"](d).collect()
    assert all((r.bin_id is None) == (r.length == 0) for r in bins)
    c = bpe.codec(bpe.VOCABULARY)
    assert sum(r.length for r in bins) == sum(len(c.encode(r[1] or "")) for r in ROWS)
    assert {(r.doc_id, r.reason) for r in RESULTS["repetition"](d).collect()} >= {(3, "empty"), (4, "empty"), (5, "empty"), (1, None)}
    assert {(r.doc_id, r.lang_pred) for r in RESULTS["identify"](d).collect()} >= {(3, None), (4, None), (5, None), (1, "en")}
    groups = {r.doc_id: r.doc_ids for r in RESULTS["near_groups"](d).where("doc_id is not null").collect()}
    assert groups[1] == [1, 2] and groups[3] == [3]


def written_names(spark, d, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('names')}/t"
    d.write.parquet(path)
    return spark.read.parquet(path).columns


def test_names_that_clash(spark, tmp_path_factory):
    names = lambda d: written_names(spark, d, tmp_path_factory)
    day = F.lit("2024-02-01").cast("date")
    entries = spark.createDataFrame([("l", "a.b", "2024-01-01", "add")], "list string, pattern string, day string, action string")
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>x")], "page_id bigint, url string, html string")
    odd = pages.withColumns({"day": day, "lists": F.lit(1), "BLOCKED": F.lit(2), "pattern": F.lit(3), "since": F.lit(4), "u": F.lit(5), "d": F.lit(6), "best": F.lit(7)})
    got = urlfilter.filter_urls(odd, entries)
    assert names(got) == ["page_id", "url", "html", "day", "u", "d", "best", "blocked", "lists", "pattern", "since"]
    assert [(r.blocked, r.lists, r.u, r.best) for r in got.collect()] == [(True, "l", 5, 7)]
    assert names(html.extract(pages.withColumn("Text", F.lit("old")))) == ["page_id", "url", "text"]
    docs = frame(spark).withColumn("decoded", F.lit(1))
    tokens = bpe.encode(docs).withColumn("decoded", F.lit(1))
    assert names(bpe.decode(tokens)) == ["doc_id", "tokens", "decoded"]
    assert names(bpe.decode(tokens, out="tokens")) == ["doc_id", "decoded", "tokens"]
    keyed = {
        "tokens": lambda d, k: bpe.encode(d, key=k),
        "notice": lambda d, k: licenses.scan(d, key=k),
        "Piece": lambda d, k: packing.pack(d, key=k),
        "n_copies": lambda d, k: exact.exact_groups(d, key=k),
        "list_part": lambda d, k: simhash.near_groups(d, key=k),
        "reason": lambda d, k: repetition.repetition(d, keep=(k,)),
        "score": lambda d, k: langid.identify(d, langid.train(d, key=k), keep=(k,)),
    }
    for key, f in keyed.items():
        out = names(f(frame(spark, ROWS[:4]).select(F.col("doc_id").alias(key), "text", "lang"), key))
        assert key in out and key.lower() + "_" in out


def test_exact_without_broadcast(spark, monkeypatch):
    want = Counter(exact.exact_groups(frame(spark)).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert Counter(exact.exact_groups(frame(spark)).collect()) == want
    assert Counter(r.text for r in exact.exact_dedup(frame(spark)).collect())[ROWS[0][1]] == 1


def test_training_is_bounded_whatever_the_ids(spark):
    d = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "concat('word ', if(id % 3 = 0, 'same', string(id))) as text", "'en' as lang")
    seen = []

    def keep(df, tag):
        out = common.written(df, tag)
        if tag == "training":
            seen.append((out.count(), out.distinct().count()))
        return out

    old, langid.written = langid.written, keep
    try:
        langid.train(d, max_train=100)
    finally:
        langid.written = old
    assert 50 < seen[0][0] <= 100 and seen[0][0] == seen[0][1]


def test_no_folder_on_a_cluster():
    class Spark:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Spark)


def test_pages_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>x", "k"), (1, "http://a.b/c", "<p>x", "k"), (2, None, None, "k"), (None, "nonsense", "", "k"), (3, "HTTP://u:p@A.B.:80/c/d?q#f", "<" * 3000 + "<div " * 3000, "k")], "page_id bigint, url string, html string, text2 string")
    out = html.extract(pages).collect()
    assert Counter((r.page_id, r.text) for r in out if r.page_id != 3) == Counter({(1, "x"): 2, (2, None): 1, (None, ""): 1})
    assert html.extract(pages.limit(0)).count() == 0
    back = warc.pages_of(warc.read(warc.write(pages))).collect()
    assert Counter((r.page_id, r.url, r.html) for r in back) == Counter((r.page_id, r.url, r.html) for r in pages.collect())
    assert warc.read(spark.createDataFrame([], "path string")).count() == 0
    day = F.lit("2024-02-01").cast("date")
    asked = pages.withColumn("day", F.when(F.coalesce("page_id", F.lit(9)) != 2, day)).withColumns({"u": F.lit(1), "r": F.lit(2), "lists0": F.lit(3)})
    entries = spark.createDataFrame([("l", "a.b/c", "2024-01-01", "add"), ("l", None, "2024-01-01", "add"), ("l", "b", None, "add"), ("m", "b", "2024-02-01", "add"), ("m", "b", "2024-02-01", "remove")], "list string, pattern string, day string, action string")
    got = Counter((r.page_id, r.blocked, r.lists) for r in urlfilter.filter_urls(asked, entries).collect())
    assert got == Counter({(1, True, "l"): 2, (2, False, None): 1, (None, False, None): 1, (3, True, "l"): 1})
    assert urlfilter.filter_urls(asked, entries.limit(0)).where("blocked").count() == 0
    assert urlfilter.filter_urls(asked.limit(0), entries).count() == 0


def test_pipeline_stages_on_edges(spark):
    docs = frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert out.count() > 0
    empty = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0
