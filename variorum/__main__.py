"""``python -m variorum build|inspect|probe|review|roundtrip|validate IN OUT``: exit 0 if all went well, 1 on findings, 2 on
a wrong input, 3 on a fault of our own. IN is a parquet folder: of pages (doc_id, page_index, printed_page, blocks), for
roundtrip and validate of what build wrote."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from variorum.operators import apparatus, evidence
from variorum.sinks import documents, review
from variorum.sources import conspectus


def main(args: list[str] | None = None) -> int:
    try:
        return run(args)
    except Exception as e:
        print(f"internal fault: {type(e).__name__}: {e}", file=sys.stderr)
        return 3


def run(args: list[str] | None) -> int:
    p = argparse.ArgumentParser(prog="variorum")
    p.add_argument("command", choices=["build", "inspect", "probe", "review", "roundtrip", "validate"])
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--pages", help="such as 1,5-7")
    p.add_argument("--sigla", default="", help="A,B,C: witnesses that no conspectus declares")
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    from variorum.kernels.registry import Registry

    names = {t: n for n, short in conspectus.EDITORS.items() for t in (n, short) if t}
    reg = Registry({s: s for s in o.sigla.split(",") if s}, names)
    try:
        d = spark.read.parquet(o.source)
        if o.pages:
            d = d.where(F.col("page_index").isin(evidence.page_spec(o.pages)))
    except (AnalysisException, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    found = None
    if o.command == "build":
        out = documents.documents(d, reg)
    elif o.command == "inspect":
        out = apparatus.report(apparatus.coverage(apparatus.entries(d, reg)))
    elif o.command == "probe":
        out = evidence.probe(d.select("doc_id", "page_index", F.explode("blocks").alias("b")).select("doc_id", "page_index", "b.layer", "b.text"))
    elif o.command == "review":
        out = review.queue(apparatus.entries(d, reg))
    elif o.command == "validate":
        out = found = documents.violations(d)
    else:
        out = found = evidence.multiset_difference(documents.contents(d, "md"), documents.contents(d, "tei"))
    out.write.mode("errorifexists").parquet(o.out)
    return int(found is not None and not spark.read.schema(found.schema).parquet(o.out).isEmpty())


if __name__ == "__main__":
    sys.exit(main())
