"""Reports as text, JSON or SARIF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..operators.catalogue import BY_ID, FORMATS, GUIDE, RULES

LEVEL = {"info": "note", "warning": "warning", "error": "error"}


def output_format(name: str) -> str:
    """An unknown name means text."""
    return name.lower() if name.lower() in ("json", "sarif") else "text"


def dataset(files: DataFrame) -> dict:
    """The files of a scan, and the schema that the others are held against: that of the first file that has one."""
    rows = [r.asDict(recursive=True) for r in files.select("path", "format", "size_bytes", "num_rows", "schema", "metadata").orderBy("file_idx").collect()]
    for r in rows:
        r["size_bytes"] = int(r["size_bytes"])
    return {"files": rows, "schema": next((r["schema"] for r in rows if r["schema"]), None)}


def render(diagnostics: DataFrame, form: str = "text", files: DataFrame | None = None) -> str:
    """files, a scan, adds the dataset to JSON and the number of files to text."""
    rows = [r.asDict() for r in diagnostics.collect()]
    form = output_format(form)
    if form == "json":
        return json.dumps(({"dataset": dataset(files)} if files is not None else {}) | {"diagnostics": rows}, indent=2)
    if form == "sarif":
        rules = [{"id": r, "name": BY_ID[r][1] if r in BY_ID else r} | ({"shortDescription": {"text": GUIDE[r][0]}, "help": {"text": GUIDE[r][1]}} if r in GUIDE else {}) for r in sorted({x["rule_id"] for x in rows})]
        results = [{"ruleId": x["rule_id"], "level": LEVEL[x["severity"]], "message": {"text": x["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": x["path"] or "dataset"}}}]} for x in rows]
        return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "lakelens", "rules": rules}}, "results": results}]}, indent=2)
    count = {s: sum(x["severity"] == s for x in rows) for s in ("error", "warning", "info")}
    seen = f"{files.count()} files, " if files is not None else ""
    lines = [f"{seen}{len(rows)} diagnostics: " + ", ".join(f"{n} {s}" for s, n in count.items())]
    for x in rows:
        lines.append(f"{x['path'] or '<dataset>'}{':' + x['location'] if x['location'] else ''}: {x['severity']} {x['rule_id']} {x['message']}")
        if x.get("help"):
            lines.append(f"  help: {x['help']}")
    return "\n".join(lines) + "\n"


def render_diff(report: dict, form: str = "text") -> str:
    form = output_format(form)
    if form == "sarif":
        raise ValueError("a comparison has no SARIF form")
    if form == "json":
        return json.dumps(report, indent=2)
    s = report["statistics"]
    lines = [f"{side}: {r['file_count']} files, {r['num_rows'] if r['num_rows'] is not None else 'unknown'} rows, {r['size_bytes']} bytes ({r['formats']})" for side, r in (("old", report["old"]), ("new", report["new"]))]
    lines += [f"schema {c['change']}: {c['name']} {c['old_type'] or ''} -> {c['new_type'] or ''}" for c in report["schema"]["changes"]]
    lines += [f"column changed: {c}" for c in report["columns"]]
    lines += [f"metadata {c['change']}: {c['key']}" for c in report["metadata"]]
    lines.append(f"row groups: {s['row_groups']['old_count']} -> {s['row_groups']['new_count']}; compression: {s['compression'][0]} -> {s['compression'][1]}")
    percent = "" if s["scan_cost_percent"] is None else f" ({s['scan_cost_percent']:+.1f}%)"
    lines.append(f"scan cost: {s['scan_cost'][0]} -> {s['scan_cost'][1]} bytes{percent}")
    return "\n".join(lines) + "\n"


def rules() -> list[dict]:
    return [dict(zip(("id", "name", "category", "default_severity"), r)) | {"summary": GUIDE[r[0]][0]} for r in RULES]


def formats() -> list[dict]:
    return [{"name": n, "status": s, "focus": f.split(", ")} for n, s, f in FORMATS]
