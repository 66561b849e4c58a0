"""Command line: index, retrieve, prompt, inspect, delete, credit-report-parse, fewshot-select."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.identity import global_chunk_id
from tracewell.functions.text import expand_query
from tracewell.functions.vectors import HASH_DIMENSION, hash_counts
from tracewell.operators import evidence, master
from tracewell.operators.prompts import evidence_block, within_budget
from tracewell.session import build_session
from tracewell.sources import documents, files, workbooks
from tracewell.sources.index import ChunkIndex

ENCODER = {"model_id": "hash-counts", "model_sha256": "-", "dimension": HASH_DIMENSION}


def _scope(parser: argparse.ArgumentParser, document: bool = True) -> None:
    for name in ("--tenant-id", "--case-id") + (("--document-id",) if document else ()):
        parser.add_argument(name, required=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewell")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index", help="master documents to a chunk index")
    p.add_argument("--master", required=True)
    p.add_argument("--index", required=True)
    _scope(p)
    p.add_argument("--representation-level", type=int, choices=(0, 1, 2), default=0)
    p.add_argument("--write-strategy", choices=("REPLACE", "UPSERT"), default="REPLACE")
    for name in ("retrieve", "prompt"):
        p = sub.add_parser(name, help="query one case of an index")
        p.add_argument("--index", required=True)
        _scope(p, document=False)
        p.add_argument("--query", required=True)
        p.add_argument("--query-id", default="Q1")
        p.add_argument("--top-k", type=int, default=5)
    p = sub.add_parser("inspect", help="records per document scope")
    p.add_argument("--index", required=True)
    p = sub.add_parser("delete", help="remove one document")
    p.add_argument("--index", required=True)
    _scope(p)
    p = sub.add_parser("credit-report-parse", help="facts of a workbook")
    p.add_argument("--workbook", required=True)
    p.add_argument("--template", help="mapping file; without it the seven-sheet layout is read")
    _scope(p)
    p = sub.add_parser("fewshot-select", help="approved style examples")
    p.add_argument("--registry", required=True)
    p.add_argument("--review-item", required=True, choices=list("ABCDE"))
    p.add_argument("--loan-type", required=True)
    p.add_argument("--industry-code", required=True)
    p.add_argument("--situation-tag", action="append", default=[])
    p.add_argument("--max-examples", type=int, default=3)
    for action in sub.choices.values():
        action.add_argument("--output", help="folder for JSON output; without it all rows are printed as JSON lines")
    return top


def index_documents(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    chunks = master.build_chunks(documents.read_master(spark, a.master), a.representation_level, max_chars=1800, overlap=180)
    rows = chunks.withColumns({
        "tenant_id": F.lit(a.tenant_id), "case_id": F.lit(a.case_id), "document_id": F.lit(a.document_id),
        "global_chunk_id": global_chunk_id(a.tenant_id, a.case_id, a.document_id, F.col("chunk_id"), a.representation_level),
        "vector": hash_counts("embedding_text")}).drop("doc_id", "sort_key", "plain")
    index = ChunkIndex(spark, a.index)
    meta = {**ENCODER, "representation_level": a.representation_level}
    (index.upsert if a.write_strategy == "UPSERT" else index.create)(rows, meta)
    return index.stats()


def retrieve(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    index = ChunkIndex(spark, a.index)
    asked = spark.createDataFrame([(a.query_id, a.query)], "query_id string, raw string")
    asked = asked.withColumn("text", expand_query(F.col("raw"))).withColumn("vector", hash_counts("text"))
    hits = index.search(asked, {"tenant_id": a.tenant_id, "case_id": a.case_id}, k=a.top_k)
    held = index.read({"tenant_id": a.tenant_id, "case_id": a.case_id}).withColumnRenamed("chunk_no", "id")
    return held.join(F.broadcast(hits), "id").drop("vector", "bucket")  # at most top_k hits


def prompt(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    block = evidence_block(
        query_id=F.col("query_id"), level=F.col("representation_level"), rank=F.col("rank"), global_id=F.col("global_chunk_id"),
        local_id=F.col("chunk_id"), document_id=F.col("document_id"), filename=F.lit("None"),
        pages=F.concat(F.lit("["), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("]")), content=F.col("document"))
    rows = retrieve(spark, a).withColumn("block", block).withColumn("cost", F.length("block"))
    return within_budget(rows, ["query_id"], [("rank", True)], "cost", 24000, keep_first=True).select("query_id", "rank", "block")


def parse_report(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    cells = files.read_cells(files.read_files(spark, a.workbook))
    scope = (F.lit(a.tenant_id), F.lit(a.case_id), F.lit(a.document_id))
    name = F.lit(a.workbook.rsplit("/", 1)[-1])
    if a.template:
        return workbooks.mapped_facts(cells, workbooks.read_template(spark, a.template), scope, name)
    gaps = workbooks.missing_sheets(cells).limit(1).collect()
    if gaps:
        raise SystemExit(f"missing credit-report sheets: {gaps[0]['missing']}")
    return workbooks.semantic_facts(cells, scope, name)


def select_examples(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    case = spark.createDataFrame([("case", a.review_item, a.loan_type, a.industry_code, a.situation_tag)],
                                 "case string, review_item string, loan_type string, industry_code string, tags array<string>")
    return evidence.select_examples(case, documents.read_examples(spark, a.registry), case="case", n=a.max_examples)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session()
    if a.command == "delete":
        removed = ChunkIndex(spark, a.index).delete(tenant_id=a.tenant_id, case_id=a.case_id, document_id=a.document_id)
        out = spark.createDataFrame([(a.document_id, removed)], "document_id string, removed long")
    else:
        run = {"index": index_documents, "retrieve": retrieve, "prompt": prompt, "credit-report-parse": parse_report,
               "fewshot-select": select_examples, "inspect": lambda s, x: ChunkIndex(s, x.index).stats()}
        out = run[a.command](spark, a)
    if a.output:
        documents.write_json(out, a.output)
    else:
        for row in out.toJSON().toLocalIterator():
            print(row)


if __name__ == "__main__":
    main()
