"""Command line: python -m terrace TOOL input.parquet [output] [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from terrace.functions.codes import CodeFormat, parse_min_width
from terrace.functions.hierarchy import target
from terrace.sources import io

#: Reports of one layer, and layers made from one.
REPORTS = ("code-detect", "name-detect", "schema-detect", "schema-map", "topo-detect", "validate")
LAYERS = ("code-create", "name-clean", "schema-fill", "topo-clean", "dissolve", "edge-extend", "package-points", "package-lines")
PAIRS = ("schema-join", "change", "edge-match")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrace", description="Tools for layers of administrative units")
    p.add_argument("tool", choices=(*REPORTS, *LAYERS, *PAIRS))
    p.add_argument("input")
    p.add_argument("other", nargs="?", help="the second layer, for tools that take two")
    p.add_argument("--output")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--name-field")
    p.add_argument("--code-field")
    p.add_argument("--root-code", default="")
    p.add_argument("--delimiter", default=".")
    p.add_argument("--min-width", default="3", type=parse_min_width)
    p.add_argument("--source-codes", default="replace", choices=("replace", "embed", "copy"))
    p.add_argument("--group-by", nargs="+", default=[])
    p.add_argument("--columns", nargs="+", default=[])
    p.add_argument("--link-by", nargs="+", default=[])
    p.add_argument("--maximum-gap-width")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a tool and gives the path it wrote."""
    a = parser().parse_args(arguments)
    from terrace.functions.kernel import union_of, with_box
    from terrace.operators import assign, change, code_create, code_detect, dissolve, edge, name_detect, package, schema_detect, schema_fill, schema_map, topology, validate

    if (a.tool in PAIRS) != (a.other is not None):
        raise SystemExit(f"{a.tool} takes {'two layers' if a.tool in PAIRS else 'one layer'}")
    spark = spark or SparkSession.builder.appName(f"terrace {a.tool}").getOrCreate()
    fields, layer = target(a.name_field, a.code_field), io.read_layer(spark, a.input)
    ending = ".csv" if a.tool in REPORTS or a.tool == "change" else ".parquet"
    output = a.output or io.default_output(a.input, f"_{a.tool.replace('-', '_')}", ending)
    width = float(a.maximum_gap_width) if a.maximum_gap_width and a.maximum_gap_width not in ("thin", "all") else a.maximum_gap_width
    reports = {"code-detect": code_detect.code_detect, "name-detect": name_detect.name_detect, "schema-detect": schema_detect.schema_detect, "schema-map": schema_map.schema_map, "validate": validate.validate}
    if a.tool == "topo-detect":
        io.write_report(topology.topo_detect(layer).drop("geom"), output, a.overwrite)
    elif a.tool in reports:
        io.write_report(reports[a.tool](layer, fields), output, a.overwrite)
    elif a.tool == "change":
        one, two = with_box(layer), with_box(io.read_layer(spark, a.other))
        units, links = change.classify(one, two, assign.coverage_ratios(one, two), tuple(a.link_by))
        io.write_report(change.changelog(one, two, units, links, a.link_by[0] if a.link_by else "fid"), output, a.overwrite)
    else:
        made = {
            "code-create": lambda: code_create.code_create(layer, CodeFormat(a.root_code, a.delimiter, a.min_width), fields, a.source_codes),
            "name-clean": lambda: name_detect.name_clean(layer, fields),
            "schema-fill": lambda: schema_fill.schema_fill(layer, fields),
            "topo-clean": lambda: topology.topo_clean(layer, width),
            "dissolve": lambda: dissolve.dissolve(layer, a.group_by, fields=fields, union=union_of),
            "edge-extend": lambda: edge.edge_extend(layer),
            "package-points": lambda: package.package_points(layer, fields),
            "package-lines": lambda: package.package_lines(layer, fields),
            "edge-match": lambda: edge.edge_match(layer, io.read_layer(spark, a.other)),
            "schema-join": lambda: assign.schema_join(with_box(layer), with_box(io.read_layer(spark, a.other)), a.columns)[0].drop("xmin", "xmax", "ymin", "ymax"),
        }[a.tool]()
        io.write_layer(made, output, a.overwrite)
    return output


if __name__ == "__main__":
    print(main())
