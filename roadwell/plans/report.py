"""The files of an analysis: summaries, the main table, differences, what the figures plot, and two LaTeX tables."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadwell.plans import analysis
from roadwell.sources.tables import DESIGN, read_dumps, read_json, read_trials

#: The columns of the files, in their order (fixed formats).
SUMMARY = (
    "label alg k q B strategy p wall wall_min wall_max trials comp wait xfer lb comm_frac wait_frac xfer_frac msgs steps edge_cut n m verified "
    "seq_wall seq_min seq_max speedup speedup_lo speedup_hi efficiency"
).split()
MAIN = (
    "label alg strategy p k q B wall wall_min wall_max speedup efficiency lb comm_frac wait_frac xfer_frac steps msgs edge_cut verified"
).split()
DIFFERENCES = (
    "graph k origins nearest_school_differs spearman_dist_vs_hops median_m_per_hop iqr_m_per_hop_lo iqr_m_per_hop_hi mean_road_km mean_hops"
).split()


def write_rows(path: str, names: list[str], rows: Iterable) -> None:
    """A CSV file of few rows, an empty field for a missing value."""
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(names)
        out.writerows([["" if v is None else v for v in row] for row in rows])


def tex_table(path: str, header: list[str], rows: list[list], align: str) -> None:
    lines = [rf"\begin{{tabular}}{{{align}}}", r"\toprule", " & ".join(header) + r" \\", r"\midrule"]
    lines += [" & ".join(map(str, row)) + r" \\" for row in rows] + [r"\bottomrule", r"\end{tabular}", ""]
    with open(path, "w") as f:
        f.write("\n".join(lines))


def read_design(spark: SparkSession, path: str) -> dict:
    row = read_json(spark, path, DESIGN).first()
    return {"config": row["config"], "synthetic": row["synthetic"], "max_p": row["max_p"], "graphs": {g: d.asDict() for g, d in row["graphs"].items()}}


def main_rows(main: DataFrame, most: int) -> list[list]:
    """The lines of the main LaTeX table: times at p = 1, 2 and most, and the figures at most, which has to be there."""
    held: dict[tuple, dict] = {}
    for r in main.where("strategy <> 'seq'").collect():
        held.setdefault((r["label"], r["alg"], r["strategy"]), {})[r["p"]] = r
    shown = lambda v, form: "nan" if v is None else form.format(v)
    out = []
    for key in sorted(held):
        own = held[key]
        top = own[most]
        times = [f"{own[p]['wall']:.3f}" if p in own else "-" for p in (1, 2, most)]
        figures = [shown(top["speedup"], "{:.2f}"), shown(top["efficiency"], "{:.2f}"), shown(top["lb"], "{:.2f}")]
        comm = "nan" if top["comm_frac"] is None else f"{100 * top['comm_frac']:.0f}"
        out.append([*key, *times, *figures, comm + r"\%"])
    return out


def write_report(spark: SparkSession, folder: str) -> tuple[int, int, bool]:
    """Writes all files of a results folder; how many cells there are, how many were not verified, and whether they are synthetic."""
    design = read_design(spark, os.path.join(folder, "design.json"))
    most, graphs = design["max_p"], design["graphs"]
    cells = analysis.summary(read_trials(spark, os.path.join(folder, "raw.csv"))).persist()
    keys = ["label", "alg", "k", "q", "B", "strategy", "p"]
    write_rows(os.path.join(folder, "summary.csv"), SUMMARY, cells.select(*SUMMARY).orderBy(*keys).collect())
    main = analysis.default_cells(cells, graphs).persist()
    write_rows(os.path.join(folder, "table_main.csv"), MAIN, analysis.in_table_order(main).select(*MAIN).collect())
    figures, tables = os.path.join(folder, "figures"), os.path.join(folder, "tables")
    for path in (figures, tables):
        os.makedirs(path, exist_ok=True)
    chosen = "medium" if "medium" in graphs else next(iter(graphs))
    defaults = {x: graphs[chosen][x] for x in ("k", "q", "B")}
    plots = {
        "speedup": analysis.speedup_rows(main), "sweeps": analysis.sweep_rows(cells.where(F.col("label") == chosen), most, defaults),
        "breakdown": analysis.breakdown(main, most),
    }
    dumps = os.path.join(folder, "dumps")
    if os.path.isdir(dumps) and os.listdir(dumps):
        rows = read_dumps(spark, dumps)
        found = analysis.differences(rows).orderBy("graph", "k").select(*DIFFERENCES).collect()
        plots["diff_by_k"] = spark.createDataFrame([(r["graph"], r["k"], 100 * r["nearest_school_differs"]) for r in found], "graph string, k int, differs_percent double")
        plots["diff_scatter"] = analysis.scatter(rows)
    else:
        found = []
    write_rows(os.path.join(folder, "diff_dijkstra_vs_bfs.csv"), DIFFERENCES, found)
    for name, rows in plots.items():
        # a figure's rows are few: cells, or the fixed sample of the scatter plot
        write_rows(os.path.join(figures, f"{name}.csv"), rows.columns, rows.orderBy(*rows.columns).collect())
    header = ["Graph", "Alg.", "Strategy", "$T_1$", "$T_2$", f"$T_{{{most}}}$", f"$S_{{{most}}}$", f"$E_{{{most}}}$", "LB", "Comm."]
    tex_table(os.path.join(tables, "main.tex"), header, main_rows(main, most), "lllrrrrrrr")
    if found:
        lines = [
            [r["graph"], r["k"], r["origins"], f"{100 * r['nearest_school_differs']:.1f}", "nan" if r["spearman_dist_vs_hops"] is None else f"{r['spearman_dist_vs_hops']:.3f}",
             "nan" if r["median_m_per_hop"] is None else f"{r['median_m_per_hop']:.0f}"]
            for r in found
        ]
        tex_table(os.path.join(tables, "diff.tex"), ["Graph", "$k$", "Origins", r"Differ (\%)", "Spearman", "m/hop (median)"], lines, "lrrrrr")
    count = analysis.unverified(cells).first()
    return count["cells"], count["unverified"], bool(design["synthetic"])

