"""Real files, one property each, and which rules they set off."""

import gzip
import io
import json
import struct
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakelens import api, cli
from lakelens.operators import documents, samples
from lakelens.operators.catalogue import RULES, Config, load_rules
from lakelens.sources import decode
from lakelens.sources.scan import InputError, expand, format_of

from containers import lance_fragment, lance_manifest, message, vortex

SMALL = pa.table({"id": pa.array([1, 2, 3], pa.int64())})


def ids(df):
    return Counter(r.rule_id for r in df.collect())


def test_test_tables(spark):
    assert ids(api.lint(spark, "/root/testdata/sf0.01")) == {"AL001": 14, "AL003": 13, "AL004": 5, "AL007": 1}


def test_codec_and_selection(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    pq.write_table(SMALL, path, compression="none")
    assert {"AL001", "AL004", "AL008"} <= set(ids(api.lint(spark, path)))
    assert set(ids(api.lint(spark, path, only=["AL008"]))) == {"AL008"}
    assert not ids(api.lint(spark, path, only=["AL008"], disabled=["AL008"]))


def test_lz4_raw_is_no_finding(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    pq.write_table(SMALL, path, compression="lz4")
    assert not ids(api.lint(spark, path, only=["AL011"]))


def test_timestamps_and_int96(spark, tmp_path):
    t = pa.table({"z": pa.array([0], pa.timestamp("us", "UTC")), "n": pa.array([0], pa.timestamp("us"))})
    pq.write_table(t, str(tmp_path / "a.parquet"))
    got = api.lint(spark, str(tmp_path), only=["AL005"]).collect()
    assert [r.location for r in got] == ["field=z"]
    pq.write_table(t, str(tmp_path / "b.parquet"), use_deprecated_int96_timestamps=True)
    assert ids(api.lint(spark, str(tmp_path / "b.parquet"), only=["AL009"])) == {"AL009": 2}


def test_ipc(spark, tmp_path):
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, SMALL.schema) as w:
        w.write_table(SMALL)
    whole = sink.getvalue()
    for name, data, want in (("ok", whole, {}), ("noeos", whole[:-8], {}), ("tail", whole + b"trailing", {"AL016": 1}), ("huge", b"\xff\xff\xff\xff\xff\xff\xff\x7f", {"AL016": 2})):
        p = tmp_path / f"{name}.arrows"
        p.write_bytes(data)
        assert ids(api.lint(spark, str(p), only=["AL016", "AL017"])) == want, name
    legacy = tmp_path / "l.ipc"
    legacy.write_bytes(whole[4:])
    assert "AL017" in ids(api.lint(spark, str(legacy)))


def test_ipc_frames(spark, tmp_path):
    """Streams that a writer would not leave, by what is wrong with a frame."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, SMALL.schema) as w:
        w.write_table(SMALL)
        w.write_table(SMALL)
    whole = sink.getvalue()
    head = 8 + struct.unpack_from("<i", whole, 4)[0]  # the schema's message
    frames = {
        "good": (whole, 0), "schema again": (whole[:head] + whole, 1), "no schema": (whole[head:], 1), "body cut": (whole[:-40], 1), "nothing": (b"", 1),
        "length cut": (whole[:head] + b"\xff\xff\xff\xff\x10", 1), "negative length": (whole[:head] + b"\xff\xff\xff\xff" + struct.pack("<i", -8), 1), "metadata cut": (whole[: head - 4], 1),
        "not a message": (b"\xff\xff\xff\xff" + struct.pack("<i", 16) + b"\x7f" * 16, 1),
    }
    for name, (data, least) in frames.items():
        p = tmp_path / f"{name.replace(' ', '_')}.arrows"
        p.write_bytes(data)
        got = ids(api.lint(spark, str(p), only=["AL016"]))
        assert (got["AL016"] >= 1) == bool(least), (name, got)


def test_geo(spark, tmp_path):
    def lint(doc, kind=pa.binary()):
        p = str(tmp_path / "g.parquet")
        value = pa.array([b"x" if kind == pa.binary() else 1], kind)
        pq.write_table(pa.table({"site0": value}).replace_schema_metadata({"geo": doc}), p)
        return ids(api.lint(spark, p, only=["AL018", "AL019", "AL020", "AL021"]))

    doc = json.dumps(samples.places(1, LINES[:1]))
    assert lint(doc) == {}
    assert lint("{") == {"AL018": 1}
    assert lint(doc, pa.int64()) == {"AL019": 1}


def test_iceberg_files(spark, tmp_path):
    good = tmp_path / "v1.gz.metadata.json"
    good.write_bytes(gzip.compress(json.dumps(samples.ledger(9, LINES)).encode()))
    assert not [r for r in ids(api.lint(spark, str(good))) if r.startswith("AL1")]
    bad = tmp_path / "v2.metadata.json"
    bad.write_text("[]")
    with pytest.raises(InputError):
        api.lint(spark, str(bad))


LINES = [{"n": n, "p": p, "s": s, "q": q} for n, p, s, q in ((1, 40, 2, 31), (2, 7, 5, 12), (2, 93, 8, 26), (7, 30, 12, 3))]


def test_documents_are_valid_unless_a_rule_changes_them():
    for k in range(60):
        cfg = Config()
        assert not list(documents.iceberg(samples.ledger(k, LINES), cfg))
        assert not list(documents.geo(None, samples.places(k, LINES), {f"site{i}": "Binary" for i in range(4)}, {}))
        doc, sizes = samples.lance("", k, LINES)
        assert not list(documents.lance(doc, cfg, sizes.get)) and not list(documents.vortex(samples.vortex("", k, LINES)))
        assert decode.ipc_stream(samples.arrow_stream("", k, LINES))["errors"] == []
    for rule in samples.EXPECTED:  # each rule is set off by some key, and by none of its documents alone
        assert {bool(samples.fired(rule, k, LINES)) for k in range(1, 60)} >= {True}, rule


def test_iceberg_references():
    """Ids count only where their array has them, whatever else the document holds."""
    doc = samples.ledger(1, LINES)

    def fired(rule, **changes):
        return Counter(f[3] for f in documents.iceberg(doc | {k.replace("_", "-"): v for k, v in changes.items()}, Config()) if f[0] == rule)

    assert fired("AL103", schemas=[], schema=doc["schemas"][1]) == {"field=current-schema-id": 1}
    assert fired("AL103", partition_specs=[]) == {"field=default-spec-id": 1} and fired("AL103", refs={}) == {"field=refs": 1}
    assert fired("AL103", default_sort_order_id=0) == {} and fired("AL103", sort_orders=[]) == {"field=default-sort-order-id": 1}
    assert fired("AL103", refs=None) == {} and fired("AL103", current_snapshot_id=-1, refs={"main": {}}) == {"field=refs.main": 1}
    snaps = [s | {"schema-id": x} for s, x in zip(doc["snapshots"], (None, "4", 3, 99))]
    assert fired("AL105", snapshots=snaps) == {"field=snapshots[3]": 1}
    assert fired("AL105", schemas=[], schema=doc["schemas"][1])["field=snapshots[0]"] == 1
    assert fired("AL105", current_snapshot_id=None) == {} and fired("AL105", current_snapshot_id=5001) == {"field=snapshot-log": 1}


def lance_dataset(root, manifests):
    for folder in ("_versions", "data", "_deletions", "_transactions"):
        (root / folder).mkdir(parents=True, exist_ok=True)
    for old in (root / "_versions").iterdir():
        old.unlink()
    for name, data in manifests.items():
        (root / "_versions" / name).write_bytes(data)


def test_lance_dataset(spark, tmp_path):
    root = tmp_path / "readings.lance"
    own = lambda **k: lance_fragment(0, "a1.lance", 11, **k)
    two = [own(), lance_fragment(1, "b2.lance", 0)]
    lance_dataset(root, {"4.manifest": lance_manifest(two, before=b"pad"), "3.manifest": b"older, never read"})
    (root / "data" / "a1.lance").write_bytes(b"x" * 11)
    (root / "data" / "b2.lance").write_bytes(b"any size")
    assert ids(api.lint(spark, str(tmp_path))) == {}
    (root / "data" / "a1.lance").write_bytes(b"x" * 12)
    assert ids(api.lint(spark, str(root))) == {"AL206": 1}
    (root / "data" / "a1.lance").write_bytes(b"x" * 11)
    (root / "data" / "b2.lance").unlink()
    assert ids(api.lint(spark, str(root))) == {"AL206": 1}
    newest = (1 << 64) - 1 - 4
    gone = message((1, 1), (2, 3), (3, 8), (4, 30))
    flags = [(9, 1), (10, 1)]
    cases = {
        "names of the second scheme": ({f"{newest:020}.manifest": lance_manifest([own()]), f"{newest + 1:020}.manifest": b"older"}, {}),
        "two schemes": ({f"{newest:020}.manifest": lance_manifest([own()]), "2.manifest": b"older"}, {"AL201": 1}),
        "another version inside": ({"5.manifest": lance_manifest([own()])}, {"AL201": 1}),
        "no number": ({"4.manifest": lance_manifest([own()]), "latest.manifest": b""}, {"AL201": 1}),
        "detached": ({"4.manifest": lance_manifest([own()]), "d17.manifest": b"not looked at"}, {}),
        "nothing": ({}, {"AL201": 1}), "garbage": ({"4.manifest": b"?" * 40}, {"AL201": 1}), "cut": ({"4.manifest": lance_manifest([own()])[:-6]}, {"AL201": 1}),
        "deletion file missing": ({"4.manifest": lance_manifest([own(deletion=gone)], more=flags)}, {"AL206": 1}),
        "deletion without flags": ({"4.manifest": lance_manifest([own(deletion=message((1, 1), (2, 3), (3, 9), (4, 30)))])}, {"AL205": 1}),
        "base unknown": ({"4.manifest": lance_manifest([own(base=6)])}, {"AL206": 1}),
        "base known": ({"4.manifest": lance_manifest([own(base=6)], more=[(9, 16), (10, 16), (18, message((1, 6), (3, 1), (4, "/far")))])}, {}),
        "transaction missing": ({"4.manifest": lance_manifest([own()], more=[(12, "4-ab.txn")])}, {"AL206": 1}),
        "transaction": ({"4.manifest": lance_manifest([own()], more=[(12, "4-cd.txn")])}, {}),
        "negative field": ({"4.manifest": lance_manifest([own(fields=(0, (1 << 32) - 1))])}, {"AL201": 0}),
    }
    (root / "_deletions" / "0-3-9.bin").write_bytes(b"x")
    (root / "_transactions" / "4-cd.txn").write_bytes(b"x")
    for name, (manifests, want) in cases.items():
        lance_dataset(root, manifests)
        got = ids(api.lint(spark, str(root)))
        if name == "negative field":
            assert set(got) == {"AL203"}, (name, got)
        else:
            assert got == want, (name, got)


def test_vortex_files(spark, tmp_path):
    cases = {
        "good": (vortex(), {}), "head": (vortex(head=b"VTXG"), {"AL301": 1}), "tail": (vortex(tail=b"vtxf"), {"AL301": 1}), "version": (vortex(version=3), {"AL301": 1}), "short": (b"VTXFVTXF", {"AL301": 1}),
        "postscript too long": (b"VTXF" + bytes(20) + struct.pack("<HH", 1, 60_000) + b"VTXF", {"AL301": 1}), "postscript garbage": (vortex(post=b"\xff" * 40), {"AL301": 1}),
        "no layout": (vortex(drop=["layout"]), {"AL302": 1}), "over the magic": (vortex(dtype_at=2), {"AL302": 1}), "beyond": (vortex(dtype_at=10**9), {"AL302": 1}),
        "keys": (vortex(entries=((b"k", 4), (b"k", 4), (b"", 4), (b"x" * 65, 4))), {"AL303": 3}), "many": (vortex(entries=tuple((b"k%d" % i, 4) for i in range(17))), {"AL303": 1}),
        "order": (vortex(spans=((16, 8, 3), (8, 8, 3))), {"AL304": 1}), "alignment": (vortex(spans=((9, 2, 3),)), {"AL304": 1}), "footer garbage": (vortex(footer=b"\xff" * 30), {"AL304": 1}),
        "arrays": (vortex(arrays=(b"vortex.alp", b"vortex.alp", b"")), {"AL305": 2}), "schemes": (vortex(schemes=(1, 7)), {"AL306": 1}), "locked": (vortex(locked=True), {"AL306": 1}), "packed": (vortex(scheme=2), {"AL306": 1}),
        "nothing optional": (vortex(drop=["dtype", "statistics"]), {"AL307": 2}),
    }
    for name, (data, _) in cases.items():
        (tmp_path / f"{name.replace(' ', '_')}.vortex").write_bytes(data)
    got: dict = {}
    for r in api.lint(spark, str(tmp_path)).collect():
        got.setdefault(r.path.split("/")[-1][:-7].replace("_", " "), Counter())[r.rule_id] += 1
    assert got == {name: want for name, (_, want) in cases.items() if want}


def test_http(spark, tmp_path):
    import functools
    import http.server
    import threading

    pq.write_table(SMALL, str(tmp_path / "a.parquet"), compression="none")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = lambda *a: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}/a.parquet"
        assert ids(api.lint(spark, f"{url}?token=1", only=["AL008", "AL001"])) == {"AL001": 1, "AL008": 1}
        with pytest.raises(InputError):
            api.lint(spark, url.replace("/a.", "/missing."))
        server.shutdown()


def test_duckdb_and_unknown(spark, tmp_path):
    (tmp_path / "x.duckdb").write_bytes(b"x")
    assert ids(api.lint(spark, str(tmp_path))) == {"AL100": 1}
    (tmp_path / "y.txt").write_bytes(b"x")
    with pytest.raises(InputError):
        api.lint(spark, str(tmp_path / "y.txt"))


def test_formats_and_order(tmp_path):
    assert [format_of(x) for x in ("a.PARQUET?x=1", "a.metadata.json.gz", "d.lance/", "a.vx", "a.db", "a.csv")] == ["parquet", "iceberg", "lance", "vortex", "duckdb", "unknown"]
    for p in ("a/b.parquet", "a-b/x.parquet"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"")
    assert [p.split("/")[-2] for p in expand([str(tmp_path)], Config())] == ["a", "a-b"]


def test_declared_rules(spark, tmp_path):
    pq.write_table(SMALL.replace_schema_metadata({"owner": "x"}), str(tmp_path / "a.parquet"))
    pq.write_table(SMALL, str(tmp_path / "b.parquet"))
    (tmp_path / "r.yaml").write_text("- rule: ORG1\n  severity: error\n  applies_to: [parquet]\n  check: {metadata_key: owner}\n")
    (tmp_path / "c.yaml").write_text("rules:\n  only: [ORG1]\n  declarative_rule_files: [r.yaml]\n")
    got = api.lint(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")], Config.load(str(tmp_path / "c.yaml"))).collect()
    assert [(r.rule_id, r.path[-9:], r.category) for r in got] == [("ORG1", "b.parquet", "metadata")]
    assert len(load_rules("rule: X")) == 1


def test_reports(spark, tmp_path, capsys):
    pq.write_table(SMALL, str(tmp_path / "a.parquet"), compression="none")
    sarif = json.loads(api.render(api.lint(spark, str(tmp_path)), "sarif"))
    assert {r["level"] for r in sarif["runs"][0]["results"]} == {"warning", "note"}
    assert cli.main(["lint", str(tmp_path), "--fail-on", "warning", "--output", "json"], spark) == 1
    assert json.loads(capsys.readouterr().out)["diagnostics"]
    assert cli.main(["rules"], spark) == 0 and len(RULES) == 43


def test_diff(spark, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    meta = lambda t, v: t.replace_schema_metadata({"model": v})
    pq.write_table(meta(SMALL, "one"), a, compression="none")
    pq.write_table(meta(pa.table({"id": pa.array([1, 2, 3, 4], pa.int64()), "new": pa.array(["x"] * 4)}), "two"), b, compression="zstd", row_group_size=2)
    got = api.diff(spark, [a], [b])
    assert got["has_changes"] and got["columns"] == ["id"] and [c["change"] for c in got["schema"]["changes"]] == ["added"]
    assert got["metadata"][0]["key"] == "model" and got["statistics"]["row_groups"] == {"old_count": 1, "new_count": 2, "changed": True}
    assert not api.diff(spark, [a], [a])["has_changes"]
    assert "scan cost" in api.render_diff(got)
    with pytest.raises(ValueError):
        api.render_diff(got, "sarif")


def test_invalid_counts(spark):
    """Footers that no writer makes, as views."""
    from decimal import Decimal

    from lakelens.operators import columnar

    row = dict(file_idx=0, file="f", ordinal=0, col_idx=0, path="c", physical_type="INT64", compression="ZSTD", encodings=["PLAIN"], has_statistics=True, null_count=Decimal(5), distinct_count=Decimal(9), num_values=3, compressed_size=-1, uncompressed_size=-1)
    kinds = "file_idx int, file string, ordinal int, col_idx int, path string, physical_type string, compression string, encodings array<string>, has_statistics boolean, null_count decimal(20,0), distinct_count decimal(20,0), num_values long, compressed_size long, uncompressed_size long"
    assert ids(columnar.chunk_rules({"chunks": spark.createDataFrame([row], kinds)}, Config())) == {"AL012": 2, "AL015": 2}
    files = spark.createDataFrame([(0, "f", "parquet", 5)], "file_idx int, path string, format string, num_rows long")
    groups = spark.createDataFrame([(0, "f", "parquet", i, (1 << 63) - 1, 1) for i in range(2)], "file_idx int, path string, format string, ordinal int, num_rows long, total_byte_size long")
    got = columnar.row_counts({"files": files, "row_groups": groups}, Config()).collect()
    assert [r.message for r in got] == ["row counts of the groups overflow"]


def test_stream(spark, tmp_path):
    from lakelens.streaming.arrivals import lint_stream

    data, paths = tmp_path / "a.parquet", tmp_path / "paths"
    pq.write_table(SMALL, str(data))
    paths.mkdir()
    (paths / "p.json").write_text(json.dumps({"path": str(data)}))
    q = lint_stream(spark.readStream.schema("path string").json(str(paths)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert set(ids(spark.read.parquet(str(tmp_path / "out")))) == {"AL001", "AL004"}


def test_stores_through_spark(spark, tmp_path):
    """What a URI that Spark's file systems read names is found, read and judged like local files."""
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    pq.write_table(SMALL, str(deep / "x.parquet"), compression="none")
    (tmp_path / "a" / "v1.metadata.json").write_text(json.dumps(samples.ledger(3, LINES) | {"format-version": 9}))
    (tmp_path / "a" / "t.vortex").write_bytes(vortex(version=2))
    (tmp_path / "a" / "notes.txt").write_text("x")
    local, far = (ids(api.lint(spark, p)) for p in (str(tmp_path), f"file://{tmp_path}"))
    assert local == far and {"AL008", "AL101", "AL301"} <= set(far)
    with pytest.raises(InputError):
        api.lint(spark, f"file://{tmp_path}/a/notes.txt")
    both = api.lint(spark, [f"file://{deep}/x.parquet", str(tmp_path / "a" / "t.vortex")], only=["AL008", "AL301"])
    assert ids(both) == {"AL008": 1, "AL301": 1}


def test_report_has_dataset_and_help(spark, tmp_path, capsys):
    from lakelens.functions import report

    pq.write_table(SMALL, str(tmp_path / "a.parquet"), compression="none")
    with api.linted(spark, str(tmp_path)) as (files, found):
        doc = json.loads(report.render(found, "json", files))
        text = report.render(found, "text", files)
    assert [f["num_rows"] for f in doc["dataset"]["files"]] == [3] and doc["dataset"]["schema"]["fields"][0]["name"] == "id"
    assert text.startswith("1 files, ") and "\n  help: " in text and all(d["help"] for d in doc["diagnostics"])
    assert not files.storageLevel.useMemory and not found.storageLevel.useMemory
    assert all(r["summary"] for r in report.rules()) and cli.main(["rules"], spark) == 0 and "summary" not in capsys.readouterr().err


def test_al303_samples_of_many_lines_are_dealt_to_files():
    """An order of more than 16 lines has several files, so that none breaks the bound on entries; repeats count as in one file."""
    from lakelens.operators import samples

    assert samples.ENTRIES == 16
    for count in (16, 17, 40, 70):
        for keys in (1, 3, 7):
            lines = sorted(({"n": 1 + i * 5 % keys, "p": i, "s": 1 + i * 7 % 9, "q": 3} for i in range(count)), key=lambda x: (x["n"], x["p"]))
            empty = sum(x["s"] % 5 == 0 for x in lines)
            kept = [x["n"] for x in lines if x["s"] % 5]
            assert samples.fired("AL303", 1, lines) == empty + len(kept) - len(set(kept)), (count, keys)
    assert any("more than 16" in f[2] for f in samples.documents.vortex(samples.vortex("AL303", 1, lines)))
