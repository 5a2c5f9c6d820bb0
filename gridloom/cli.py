"""Command line: ``python -m gridloom.cli GRID -r RES [options] INPUT OUTPUT``."""

from __future__ import annotations

import argparse
import logging

from gridloom.operators.prepare import SORTS
from gridloom.types import RESOLUTIONS

VERSION = "0.2"


def positive(text: str) -> int:
    if int(text) < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return int(text)


def threshold(text: str) -> float | str:
    return text if text == "auto" else float(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom")
    top.add_argument("--version", action="version", version=f"gridloom {VERSION}")
    grids = top.add_subparsers(dest="grid", required=True)
    for name, own in RESOLUTIONS.items():
        if name == "a5":  # its cells have no positions here
            continue
        p = grids.add_parser(name, help=f"index features to {name} cells")
        p.add_argument("source", help="a file, folder or URI that Spark reads, or a database URL")
        p.add_argument("target")
        p.add_argument("-r", "--resolution", type=int, required=True, choices=range(own.low, own.high + 1), metavar=f"{own.low}..{own.high}")
        p.add_argument("-pr", "--parent_res", type=int, choices=range(own.low, own.high + 1), metavar=f"{own.low}..{own.high}")
        p.add_argument("-id", "--id_field")
        p.add_argument("-k", "--keep_attributes", action="store_true")
        p.add_argument("-ch", "--chunksize", type=positive, default=50, help="rows of a partition after spatial sorting")
        p.add_argument("-s", "--spatial_sorting", choices=SORTS, default="none")
        p.add_argument("-crs", "--cut_crs", help="CRS in which polygons are cut, by default the input's")
        p.add_argument("-c", "--cut_threshold", type=threshold, default=0, help="cut polygons with larger boxes, in square units of the cut CRS; auto: about 5,000 cells; 0: do not cut")
        p.add_argument("-t", "--threads", type=positive, help="partitions of the fill")
        p.add_argument("-cp", "--compression", default="snappy")
        p.add_argument("-lyr", "--layer")
        p.add_argument("-g", "--geom_col", default="geom")
        p.add_argument("-pc", "--partition_column", help="a number column of a database table, by whose ranges it is read in parallel")
        p.add_argument("-np", "--partitions", type=positive, default=32, help="how many such ranges")
        p.add_argument("--geo", choices=("none", "point", "polygon"), default="none")
        p.add_argument("--tempdir", help="Spark's folder for spilled data")
        p.add_argument("--input_crs", help="CRS of an input that names none, as EPSG:n or +proj=...")
        p.add_argument("-co", "--compact", action="store_true")
        p.add_argument("-o", "--overwrite", action="store_true")
        p.add_argument("-v", "--verbosity", choices=("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), default="INFO", type=str.upper)
    return top


def main(argv: list[str] | None = None) -> None:
    a = vars(parser().parse_args(argv))
    logging.basicConfig(level=a.pop("verbosity"), format="%(levelname)s %(message)s")
    from pyspark.sql import SparkSession

    from gridloom.index import index_to_parquet

    builder = SparkSession.builder.appName("gridloom")
    if temporary := a.pop("tempdir"):
        builder = builder.config("spark.local.dir", temporary)
    spark = builder.getOrCreate()
    if a["spatial_sorting"] == "none":
        a["chunksize"] = None  # without a sort, partitions are those of the source
    column, n = a.pop("partition_column"), a.pop("partitions")
    a["partitions"] = (column, n) if column else None
    index_to_parquet(spark, a.pop("source"), a.pop("target"), a.pop("grid"), a.pop("resolution"), crs=a.pop("input_crs"), **a)


if __name__ == "__main__":
    main()
