"""Rules, format packs and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

#: (id, name, category, severity) of the built-in rules (fixed values).
RULES = [tuple(x.split()) for x in """
AL001 tiny-row-groups performance warning
AL002 missing-parquet-statistics metadata warning
AL003 inconsistent-schemas schema error
AL004 missing-schema-metadata metadata info
AL005 non-portable-timestamps interoperability warning
AL006 mixed-dictionary-encodings encoding warning
AL007 small-files performance info
AL008 uncompressed-parquet-columns performance warning
AL009 deprecated-parquet-physical-types interoperability warning
AL010 deprecated-parquet-encodings interoperability warning
AL011 deprecated-parquet-compression interoperability warning
AL012 invalid-parquet-statistics correctness error
AL013 inconsistent-parquet-row-counts correctness error
AL014 missing-parquet-null-counts metadata warning
AL015 invalid-parquet-size-metadata correctness error
AL016 invalid-arrow-ipc-stream correctness error
AL017 legacy-arrow-ipc-framing interoperability warning
AL018 invalid-geoparquet-metadata geoparquet error
AL019 invalid-geoparquet-columns geoparquet error
AL020 invalid-geoparquet-spatial-metadata geoparquet error
AL021 missing-geoparquet-pruning-metadata performance info
AL100 recognized-extension-format extension info
AL101 unsupported-iceberg-format-version iceberg error
AL102 invalid-iceberg-required-metadata iceberg error
AL103 invalid-iceberg-references iceberg error
AL104 duplicate-iceberg-identifiers iceberg error
AL105 invalid-iceberg-snapshots iceberg error
AL106 invalid-iceberg-field-ids iceberg error
AL107 iceberg-metadata-maintenance maintenance info
AL201 invalid-lance-manifest lance error
AL202 invalid-lance-fragment-identifiers lance error
AL203 invalid-lance-data-files lance error
AL204 invalid-lance-deletion-files lance error
AL205 incompatible-lance-features interoperability error
AL206 missing-lance-references correctness error
AL207 lance-maintenance-opportunity maintenance info
AL301 invalid-vortex-container vortex error
AL302 invalid-vortex-postscript-segments vortex error
AL303 invalid-vortex-user-metadata vortex error
AL304 invalid-vortex-footer-segments vortex error
AL305 invalid-vortex-registries vortex error
AL306 incompatible-vortex-compression interoperability error
AL307 missing-vortex-optimization-metadata performance info
""".strip().splitlines()]
BY_ID = {r[0]: r for r in RULES}
#: What each rule looks for, and what to do about a finding.
GUIDE = {line[:5]: tuple(line[6:].split(" | ")) for line in """
AL001 Row groups should be large enough to scan well. | Let the writer make larger row groups, or lower min_row_group_rows.
AL002 Parquet column chunks should have statistics. | Turn the writer's statistics on, so that readers can skip chunks.
AL003 Files of one dataset should have one schema. | Give all files the same fields, types, order and nullability.
AL004 Schemas should say where they come from. | Add key-value metadata such as producer, owner or version.
AL005 Timestamps should mean the same to all readers. | Prefer microseconds without a zone, or try the zone in every reader.
AL006 A column should be encoded alike in all row groups. | See whether the dictionary overflowed; raise its size or turn it off for the column.
AL007 A dataset shouldn't be cut into many small files. | Compact the files to some hundred megabytes each.
AL008 Column chunks should be compressed. | Write with ZSTD or Snappy.
AL009 INT96 is deprecated. | Write timestamps as INT64 with a logical type.
AL010 Some encodings are deprecated. | Write with encodings of the current specification.
AL011 The first LZ4 codec can't be read everywhere. | Write LZ4_RAW, ZSTD or Snappy.
AL012 Statistics must fit the number of values. | Rewrite the file; its statistics mislead readers.
AL013 Row groups must have as many rows as the file. | Rewrite the file; its footer contradicts itself.
AL014 Statistics should count nulls. | Use a writer that counts nulls, so that readers can skip chunks.
AL015 Counts and sizes can't be negative. | Rewrite the file from its source.
AL016 A stored stream must be framed as Arrow has it. | Write the stream anew and close its writer.
AL017 Frames without continuation markers are an old form. | Write the stream with a current version.
AL018 GeoParquet metadata must follow its specification. | Write version 1 metadata with a primary column and columns.
AL019 Geometry columns must be declared as they are stored. | Declare each column's encoding and geometry types.
AL020 Spatial metadata must be well formed. | Correct crs, epoch, orientation, edges, bbox or covering.
AL021 Geometry columns should help readers to skip. | Add a bbox or a covering.
AL100 The format is known but not inspected. | Export to Parquet to have it inspected.
AL101 Table metadata must have a known version. | Write format-version 1, 2 or 3.
AL102 Table metadata must have what its version requires. | Commit with a client that writes the required fields.
AL103 Ids must refer to entries that exist. | Restore the last valid metadata file and commit again.
AL104 Ids must be unique. | Restore the last valid metadata file and commit again.
AL105 Snapshots and their log must agree. | Repair or expire the snapshot with the table's own tools.
AL106 Field ids must be positive, unique and known. | Evolve schemas and partitions with the table's own tools.
AL107 Old snapshots and metadata should go. | Expire snapshots and limit the metadata log.
AL201 The newest manifest must be readable. | Restore the dataset's last valid version.
AL202 Fragment ids must be unique and within the maximum. | Restore the dataset's last valid version.
AL203 Data files must have safe paths and distinct fields. | Write the fragment anew.
AL204 Deletion files must fit their fragment. | Compact the fragment.
AL205 Features must be flagged and understood. | Write with a version that all readers understand.
AL206 Files that a manifest names must exist. | Restore the files, or an older version.
AL207 Versions, small fragments and deletions should be cleaned up. | Clean up old versions and compact fragments.
AL301 A container must have its magic, version and postscript. | Write the file anew.
AL302 The postscript's segments must lie within the file. | Write the file anew.
AL303 User metadata must have short distinct keys. | Use distinct keys of 1 to 64 bytes.
AL304 The footer's segments must be ordered and aligned. | Write the file anew.
AL305 Registries must have distinct names. | Write the file anew.
AL306 Compression schemes must be known. | Write with schemes that readers know.
AL307 Files should have a dtype and statistics. | Write both, so that readers can plan without the data.
""".strip().splitlines()}
RANK = {"info": 1, "warning": 2, "error": 3}
#: (name, status, focus) of the formats that are known.
FORMATS = [("parquet", "built-in", "row groups, statistics, compression, encodings, logical types, GeoParquet"), ("arrow_ipc", "built-in", "framing, schema metadata, timestamps"), ("iceberg", "built-in-metadata", "identifiers, snapshots, references, maintenance"), ("vortex", "built-in-metadata", "container, segments, registries, compression"), ("lance", "built-in-metadata", "manifests, fragments, features, references"), ("duckdb", "planned", "recognition only")]


@dataclass
class Config:
    """Thresholds and selection; 0 turns a maintenance limit off."""

    recursive: bool = True
    follow_links: bool = False
    min_row_group_rows: int = 100_000
    small_file_bytes: int = 67_108_864
    iceberg_max_snapshots: int = 100
    iceberg_max_metadata_log_entries: int = 100
    lance_max_versions: int = 100
    lance_target_fragment_rows: int = 1_048_576
    lance_small_fragment_count: int = 8
    lance_deletion_compaction_threshold: float = 0.1
    fail_on: str = "error"
    only: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    declarative_rule_files: list[str] = field(default_factory=list)
    declared: list[dict] = field(default_factory=list)

    def enabled(self, rule: str) -> bool:
        return (not self.only or rule in self.only) and rule not in self.disabled

    @classmethod
    def load(cls, path: str) -> Config:
        """From YAML with the sections scan and rules; rule files are relative to it."""
        import yaml

        raw = yaml.safe_load(Path(path).read_text()) or {}
        own = {f.name for f in fields(cls)}
        out = cls(**{k: v for section in ("scan", "rules") for k, v in (raw.get(section) or {}).items() if k in own})
        for name in out.declarative_rule_files:
            out.declared += load_rules((Path(path).parent / name).read_text())
        return out


def load_rules(text: str) -> list[dict]:
    """YAML rules: a list where the text starts with a dash, else one."""
    import yaml

    got = yaml.safe_load(text)
    return got if text.lstrip().startswith("-") else [got]
