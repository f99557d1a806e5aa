"""Command line: python -m mizuhiki.cli --input a.csv,b.json --chain-db chains.json --output out.json"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .plans.resolve import Result, run_pipeline, trace
from .sources.export import csv_text, documents, export_table, json_text, report_sheets, write_csv, write_json, write_xlsx
from .sources.readers import load_chain_names, load_records


def issue_report(result: Result, words: Sequence[str] = ("ルミネ", "コクーン")) -> dict[str, DataFrame]:
    """Samples to look through: chain and mall exclusions, stores that name a facility after all, and top matches."""
    text = F.concat("name", F.lit(" "), "address")
    return {
        "chain_excluded": result.chain_excluded.orderBy("record_index").select("raw_name", "chain_decision", "chain_score").limit(10),
        "mall_excluded": result.mall_excluded.orderBy("record_index").select("raw_name", "raw_address", "exclude_reason").limit(15),
        "suspicious_stores": result.stores.filter(text.rlike("|".join(words))).orderBy("cluster").select("name", "address").limit(10),
        "top_matches": result.duplicate_matches.orderBy("left_idx", "right_idx").limit(10),
    }


def dump(records: DataFrame) -> tuple[int, dict | None]:
    """Row count and first record of what the loaders made."""
    first = records.orderBy("record_index").first()
    return records.count(), first.asDict(recursive=True) if first else None


def _write(result: Result, path: str, include_excluded: bool) -> None:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        write_xlsx(report_sheets(result), path)
    elif kind in ("csv", "json"):
        with open(path, "w", encoding="utf-8") as f:
            f.write(csv_text(export_table(result, include_excluded)) if kind == "csv" else json_text(result))
    else:  # a folder that executors write
        for name, df in documents(result).items():
            write_json(df, f"{path}/{name}")
        write_csv(export_table(result, include_excluded), f"{path}/export")


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="mizuhiki")
    p.add_argument("--input", required=True, action="append", help="CSV or JSON files; repeat, or separate by commas")
    p.add_argument("--output", required=True, help=".json, .csv or .xlsx by the driver; else a folder that executors write")
    p.add_argument("--chain-db", "--chainDb", help="chain master, CSV or JSON")
    p.add_argument("--encoding", default="utf-8", help="charset of CSV files, or auto")
    p.add_argument("--on-error", "--onError", choices=("raise", "skip"), default="raise")
    p.add_argument("--pairing", choices=("auto", "all", "blocked"), default="auto")
    p.add_argument("--trace", help="a folder for what decided about each record")
    for flag, camel in (("strip-prefecture", "stripPrefecture"), ("remove-business-words", "removeBusinessWords"), ("exclude-commercial-facilities", "excludeCommercialFacilities"), ("include-excluded", "includeExcluded"), ("report", "report")):
        p.add_argument(f"--{flag}", *([f"--{camel}"] if camel != flag else []), action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("mizuhiki").getOrCreate()
    paths = [x.strip() for y in a.input for x in y.split(",") if x.strip()]
    options = config.Options(strip_prefecture=a.strip_prefecture, remove_business_words=a.remove_business_words, exclude_commercial_facilities=a.exclude_commercial_facilities, chain_names=load_chain_names(spark, a.chain_db) if a.chain_db else (), pairing=a.pairing)
    result = run_pipeline(load_records(spark, paths, a.encoding, a.on_error), options)
    _write(result, a.output, a.include_excluded)
    if a.trace:
        write_json(trace(result.classified), a.trace)
    result.summary.show(truncate=False)
    if a.report:
        for name, df in issue_report(result).items():
            print(name)
            df.show(truncate=False)


if __name__ == "__main__":
    main()
