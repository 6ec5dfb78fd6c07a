"""Sinks: tables by file name, graph files, LaTeX tables, zip archives and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NODES = 100_000


def write_table(df: DataFrame, path: str) -> None:
    """Write by the path's extension: .parquet, .csv, .json or .txt (one text column)."""
    kind = path.rpartition(".")[2]
    out = df.write.mode("overwrite")
    if kind == "parquet":
        out.parquet(path)
    elif kind == "csv":
        # CSV has no nested types: lists are joined.
        flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        out.json(path)
    elif kind == "txt":
        out.text(path)
    else:
        raise ValueError(f"unknown table format: {path}")


def reuse_or_build(spark, path: str, build, fresh: bool = False) -> DataFrame:
    """The table at a path, built and written first if it isn't there or ``fresh`` is asked for."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if fresh or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        write_table(build(), path)
    return spark.read.parquet(path)


def _bounded(df: DataFrame, most: int) -> list[dict]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a single file")
    return [r.asDict() for r in rows]


def graph_file(nodes: DataFrame, edges: DataFrame, path: str, key: str = "node", most: int = MAX_NODES) -> None:
    """A GraphML or GEXF file (by extension) of a graph of bounded size, with all attributes; GEXF takes x and y as positions."""
    ns, es = _bounded(nodes, most), _bounded(edges, most * 10)
    text = _gexf(ns, es, key) if path.endswith(".gexf") else _graphml(ns, es, key)
    Path(path).write_text(text, encoding="utf-8")


def _kind(value: object, names: tuple[str, str, str, str]) -> str:
    return names[0] if isinstance(value, bool) else names[1] if isinstance(value, int) else names[2] if isinstance(value, float) else names[3]


def _attributes(rows: list[dict], left_out: set[str], names: tuple[str, str, str, str]) -> dict[str, str]:
    kinds: dict[str, str] = {}
    for row in rows:
        for k, v in row.items():
            if k not in left_out and v is not None:
                kinds.setdefault(k, _kind(v, names))
    return kinds


def _value(v: object) -> str:
    return escape(str(v).lower() if isinstance(v, bool) else str(v))


def _graphml(nodes: list[dict], edges: list[dict], key: str) -> str:
    names = ("boolean", "long", "double", "string")
    kinds = {"node": _attributes(nodes, {key}, names), "edge": _attributes(edges, {"source", "target"}, names)}
    ids = {(side, name): f"d{i}" for i, (side, name) in enumerate((s, n) for s in kinds for n in sorted(kinds[s]))}
    out = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    out += [f'<key id="{i}" for="{s}" attr.name={quoteattr(n)} attr.type="{kinds[s][n]}"/>' for (s, n), i in ids.items()]
    out.append('<graph edgedefault="undirected">')

    def data(side: str, row: dict) -> str:
        return "".join(f'<data key="{ids[side, n]}">{_value(row[n])}</data>' for n in sorted(kinds[side]) if row.get(n) is not None)

    out += [f"<node id={quoteattr(str(r[key]))}>{data('node', r)}</node>" for r in sorted(nodes, key=lambda r: str(r[key]))]
    out += [f"<edge source={quoteattr(str(r['source']))} target={quoteattr(str(r['target']))}>{data('edge', r)}</edge>" for r in sorted(edges, key=lambda r: (str(r["source"]), str(r["target"])))]
    return "\n".join([*out, "</graph>", "</graphml>"]) + "\n"


def _gexf(nodes: list[dict], edges: list[dict], key: str) -> str:
    names = ("boolean", "long", "double", "string")
    out = ['<?xml version="1.0" encoding="utf-8"?>', '<gexf xmlns="http://gexf.net/1.3" xmlns:viz="http://gexf.net/1.3/viz" version="1.3">', '<graph defaultedgetype="undirected">']
    place: dict[str, dict[str, int]] = {}
    for side, rows, skip in (("node", nodes, {key, "label", "x", "y"}), ("edge", edges, {"source", "target", "weight"})):
        kinds = _attributes(rows, skip, names)
        place[side] = {n: i for i, n in enumerate(sorted(kinds))}
        out.append(f'<attributes class="{side}">' + "".join(f'<attribute id="{i}" title={quoteattr(n)} type="{kinds[n]}"/>' for n, i in place[side].items()) + "</attributes>")

    def values(side: str, row: dict) -> str:
        return "<attvalues>" + "".join(f'<attvalue for="{i}" value={quoteattr(_value(row[n]))}/>' for n, i in place[side].items() if row.get(n) is not None) + "</attvalues>"

    out.append("<nodes>")
    for r in sorted(nodes, key=lambda r: str(r[key])):
        at = f'<viz:position x="{r["x"]}" y="{r["y"]}" z="0.0"/>' if r.get("x") is not None and r.get("y") is not None else ""
        out.append(f"<node id={quoteattr(str(r[key]))} label={quoteattr(str(r.get('label') or r[key]))}>{values('node', r)}{at}</node>")
    out.append("</nodes><edges>")
    for i, r in enumerate(sorted(edges, key=lambda r: (str(r["source"]), str(r["target"])))):
        weight = f' weight="{r["weight"]}"' if r.get("weight") is not None else ""
        out.append(f'<edge id="{i}" source={quoteattr(str(r["source"]))} target={quoteattr(str(r["target"]))}{weight}>{values("edge", r)}</edge>')
    return "\n".join([*out, "</edges></graph>", "</gexf>"]) + "\n"


_TEX = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"} | {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})


def latex_table(df: DataFrame, caption: str, label: str, most: int = 200) -> str:
    """A small table as LaTeX: integers with thousands separators, doubles with three decimals."""
    rows = _bounded(df, most)

    def cell(v: object) -> str:
        if v is None:
            return "--"
        if isinstance(v, int) and not isinstance(v, bool):
            return f"{v:,}"
        return f"{v:.3f}" if isinstance(v, float) else str(v).translate(_TEX)

    kinds = dict(df.dtypes)
    align = "".join("l" if kinds[c] == "string" else "r" for c in df.columns)
    body = [" & ".join(cell(r[c]) for c in df.columns) + r" \\" for r in rows]
    head = " & ".join(c.translate(_TEX) for c in df.columns) + r" \\"
    return "\n".join(
        [r"\begin{table}", r"\centering", rf"\begin{{tabular}}{{{align}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\end{table}"]
    ) + "\n"


def zip_files(paths: Iterable[str], archive: str) -> None:
    """Files into one archive, by their names."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(paths):
            out.write(p, os.path.basename(p))


def file_digest(path: str) -> str:
    """SHA-256 of a file, read in blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def manifest(inputs: dict[str, str], tables: dict[str, DataFrame], path: str | None = None) -> dict:
    """Digests and sizes of input files, row counts and columns of tables; written as sorted JSON if a path is given."""
    found = {
        "inputs": {k: {"sha256": file_digest(p), "bytes": os.path.getsize(p)} for k, p in sorted(inputs.items())},
        "outputs": {k: {"rows": t.count(), "columns": t.columns} for k, t in sorted(tables.items())},
    }
    if path:
        Path(path).write_text(json.dumps(found, indent=1, sort_keys=True) + "\n")
    return found


def range_checks(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: for each measure whether every value that isn't null lies within its bounds."""
    inside = lambda c, a, b: F.coalesce(F.bool_and(F.col(c).between(a, b) | F.col(c).isNull()), F.lit(True)).alias(c)
    return df.agg(*[inside(c, a - 1e-12, b + 1e-12) for c, (a, b) in bounds.items()])
