import json

import pytest
from pyspark.sql import functions as F

from variorum.__main__ import main
from variorum.kernels.registry import Registry
from variorum.operators import apparatus as A
from variorum.sinks import documents as D
from variorum.sinks import review
from variorum.sources import overrides, tei
from variorum.streaming.batches import build

REG = Registry({"A": "Codex A", "Ac": "A corrected", "B": "Codex B"}, {"Otto": "Otto"})
BLOCK = "struct<layer:string,text:string,source:string,generative:boolean,confidence:double,inline_refs:array<string>>"
BLOCKS = [("text", "Alpha1 beta 2 λόγος\n# x", "ocr", True, 0.965, ["r1"]), ("apparatus", "head\n1 Alpha A in marg. : Omega <B> B\n2 Beta Ac : Delta Otto ut vid. (p. 3)", None, None, 1.0, None), ("translation", "so <it> goes", None, None, 1.0, None), ("page_number", "5", None, None, 1.0, None), ("unknown", "??\x01", None, None, 0.125, None)]


def pages(spark, text=None):
    blocks = [("text", text, None, None, 1.0, None)] if text else BLOCKS
    return spark.createDataFrame([("d", 0, "5", blocks), ("d", 1, None, [])], f"doc_id string, page_index int, printed_page string, blocks array<{BLOCK}>")


def test_outputs_agree_and_hold_all_invariants(spark):
    d = D.documents(pages(spark), REG).cache()
    r = d.first()
    assert "Alpha⟦5:1⟧ beta⟦5:2⟧ λόγος" in r.md
    assert "\\# x" in r.md and "confidence=0.96 " in r.md and "generative-blocks: 1" in r.md
    assert [tuple(x) for x in D.violations(d).collect()] == []
    a, b = (D.contents(d, c).where("layer <> 'notes'") for c in ("md", "tei"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert tei.bad_references(d).count() == 0
    e = tei.entries(d).orderBy("n").collect()
    assert e[0].sides[0].witnesses == ["A"] and e[0].attached_to == "#a-p0-e1"
    assert '<witDetail wit="#wit-A">in marg.</witDetail>' in r.tei and 'cert="low"' in r.tei and 'corresp="#wit-A"' in r.tei and "??�" in r.tei


def test_marker_brackets_stop_the_build(spark):
    with pytest.raises(Exception, match="marker bracket"):
        D.documents(pages(spark, "a ⟦5:1⟧"), REG).collect()


def test_review_files(spark):
    e = A.entries(pages(spark), REG)
    q = review.queue(e)
    assert {r.entry_key: r.status for r in q.collect()}["p0-e0"] == "refused"
    assert "<article" in review.html(q).first().html
    record = F.struct(F.col("source_sha"), F.col("excerpt").alias("source_excerpt"), F.lit("parse").alias("action"), F.lit("new").alias("lemma"), F.array(F.lit("A")).alias("lemma_wits"), *(F.lit(None).alias(c) for c in ("lemma_editors", "lemma_qualifiers", "readings", "comments", "note")))
    files = overrides.export(q.where("entry_key = 'p0-e1'").select("doc_id", "entry_key", record.alias("record")))
    assert json.loads(files.first().content)["format"] == overrides.FORMAT
    done = A.apply_overrides(e, overrides.load(spark, files)).where("entry_key = 'p0-e1'").first()
    assert done.parsed.lemma == "new" and done.parsed.lemma_attribution.witnesses == ["A"] and done.override_action == "parse"
    for bad in ('{"entries":{}}', '{"format":"%s","entries":{"p0-e0":{"action":"x"}}}' % overrides.FORMAT):
        with pytest.raises(Exception):
            overrides.load(spark, spark.createDataFrame([("d", bad)], "doc_id string, content string")).collect()


def test_commands_and_micro_batches(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/pages")
    assert main(["build", f"{tmp_path}/pages", f"{tmp_path}/out", "--sigla", "A,Ac,B"]) == 0
    assert main(["validate", f"{tmp_path}/out", f"{tmp_path}/bad"]) == 0
    assert main(["inspect", f"{tmp_path}/pages", f"{tmp_path}/seen", "--pages", "1"]) == 0
    assert main(["inspect", f"{tmp_path}/pages", f"{tmp_path}/x", "--pages", "2-1"]) == 2
    assert main(["probe", f"{tmp_path}/pages", f"{tmp_path}/hints"]) == 0
    assert [(r.pages, r.text_lang) for r in spark.read.parquet(f"{tmp_path}/hints").collect()] == [("1", "la")]
    assert main(["probe", f"{tmp_path}/out", f"{tmp_path}/z"]) == 3
    assert main(["build", f"{tmp_path}/none", f"{tmp_path}/y"]) == 2
    build(spark, f"{tmp_path}/pages", pages(spark).schema, f"{tmp_path}/stream", f"{tmp_path}/check", REG).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/stream").count() == A.entries(pages(spark), REG).count() == 3
