"""Readers of run logs, run reports, file trees and output documents."""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.integrity import cached_digest_join
from assayer.operators.units import violations
from assayer.storage import Parts

# Record kinds of a log besides runs, statuses of runs, the form of digests, and the report schema.
STATUSES = ("evaluated", "rejected", "planned", "error")
DIGEST = r"^sha256:[0-9a-f]{64}$"
RECORD_KINDS = ("design_revision", "assessment", "named_reference", "contract_amendment", "attestation", "state_transition")
REPORT = """run_id string, case_id string, status string, verdicts array<struct<requirement_id:string,status:string,rule:string,unit:string,margin:string>>,
 admissions array<struct<evidence_id:string,source:string,state:string,reasons:array<string>>>, findings array<struct<code:string,subject:string,message:string>>,
 artifacts array<struct<artifact_id:string,kind:string,sha256:string>>, steps array<struct<step_id:string,state:string,planned_invocation_sha256:string>>"""
#: Names that a path of a variant can spell.
PLAIN_NAME = r"""^[^'"?\\\[\]]+$"""
#: Bytes of a file that are held at once.
CHUNK = 1 << 22
#: Arrow's names of the schemes whose files can be streamed.
SCHEMES = {"hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
RECORDED_AT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, raw, record_sha256, body`` of JSON-lines logs; blank lines count as lines but give no row.

    Lines are numbered per file: rows are numbered inside each block that Spark reads, and blocks before are
    counted, so a long log is nobody's single task.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seen"), F.col("value").alias("raw"))
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "block", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("seen"))
    numbered = rows.withColumn("inside", inside).join(starts, ["file", "block"])
    line = (F.col("before") + F.col("inside")).alias("line")
    return numbered.filter(F.trim("raw") != "").select("file", line, "raw", F.sha2("raw", 256).alias("record_sha256"), F.try_parse_json("raw").alias("body"))


def _text(path: str) -> Column:
    return F.expr(f"try_variant_get(body, '{path}', 'string')")


def with_kind(log: DataFrame) -> DataFrame:
    """The log with ``kind``: run, one of the record kinds, untracked (no attempt, no kind), unknown, or unreadable."""
    kind = _text("$.record_kind")
    has_attempt = F.expr("variant_get(body, '$.attempt') is not null")
    return log.withColumn("kind", F.when(F.col("body").isNull(), "unreadable").when(kind.isin(*RECORD_KINDS), kind).when(kind.isNotNull(), "unknown").when(has_attempt, "run").otherwise("untracked"))


def split_record_kinds(log: DataFrame) -> dict[str, DataFrame]:
    """A table for each kind; unknown and unreadable rows come under their names, for the caller to refuse."""
    tagged = with_kind(log)
    get = lambda p, t: F.expr(f"try_variant_get(body, '{p}', '{t}')")
    runs = tagged.filter("kind = 'run'").select(
        "file", "line", "record_sha256", _text("$.case_id").alias("case_id"), _text("$.status").alias("status"), _text("$.recorded_at").alias("recorded_at"),
        get("$.attempt.attempt_id", "long").alias("attempt_id"), get("$.attempt.generation", "long").alias("generation"), _text("$.attempt.parent_attempt_id").alias("parent_attempt_id"),
        _text("$.attempt.parent_record_sha256").alias("parent_record_sha256"), F.expr("variant_get(body, '$.attempt.candidate_state')").alias("candidate_state"),
    )
    out = {"run": runs}
    for k in RECORD_KINDS:
        out[k] = tagged.filter(F.col("kind") == k).select("file", "line", "record_sha256", F.expr("variant_get(body, '$.record')").alias("record"))
    for k in ("untracked", "unknown", "unreadable"):
        out[k] = tagged.filter(F.col("kind") == k).select("file", "line", "raw")
    return out


def _type(path: str) -> Column:
    """The type of a member of a row, as ``STRING`` or ``ARRAY<...>``; null if absent or a JSON null."""
    kind = F.expr(f"schema_of_variant(try_variant_get(body, '{path}', 'variant'))")
    return F.when(kind != "VOID", kind)


def _is(path: str, kind: str) -> Column:
    return F.coalesce(_type(path).startswith(kind), F.lit(False))


def row_problems(versions: list[str]) -> dict[str, Column]:
    """The rules that a row of :func:`with_kind` breaks, by name.

    There are three profiles.  Records have a known kind and an object.  Runs of a known schema version have
    a known status and, unless they failed, a case and steps.  Rows from before there were versions have no
    attempt, but a case, a time, the digest of their campaign, and, unless they failed, steps as pairs of
    texts, verdicts, supplied inputs and a workspace.
    """
    read = F.col("kind") != "unreadable"
    record = F.coalesce(_text("$.record_kind").isNotNull(), F.lit(False))
    run = read & ~record & _type("$.schema_version").isNotNull()
    older = read & ~record & _type("$.schema_version").isNull()
    done = ~F.coalesce(_text("$.status") == "error", F.lit(False))
    steps = F.expr("try_variant_get(body, '$.steps', 'array<array<string>>')")
    pairs = F.coalesce(_type("$.steps").isin("ARRAY<VOID>", "ARRAY<ARRAY<STRING>>") & F.forall(steps, lambda p: F.size(p) == 2), F.lit(False))
    return {
        "unreadable": ~read,
        "unknown_record_kind": F.col("kind") == "unknown",
        "record_malformed": F.col("kind").isin(*RECORD_KINDS) & ~_is("$.record", "OBJECT"),
        "schema_version_unknown": run & ~F.coalesce(_text("$.schema_version").isin(*versions), F.lit(False)),
        "status_unknown": (run | older) & ~F.coalesce(_text("$.status").isin(*STATUSES), F.lit(False)),
        "case_id_missing": (run & done | older) & ~_is("$.case_id", "STRING"),
        "recorded_at_missing": older & ~_is("$.recorded_at", "STRING"),
        "recorded_at_malformed": (run | older) & ~F.coalesce(_text("$.recorded_at").rlike(RECORDED_AT), F.lit(True)),
        "campaign_digest": older & ~F.coalesce(_text("$.campaign_sha256").rlike(DIGEST), F.lit(False)),
        "attempt_before_versions": older & _type("$.attempt").isNotNull(),
        "steps_missing": run & done & ~_is("$.steps", "ARRAY"),
        "steps_malformed": older & done & ~pairs,
        "verdicts_missing": older & done & ~_is("$.verdicts", "ARRAY"),
        "supplied_inputs_missing": older & done & ~_is("$.supplied_inputs", "ARRAY"),
        "workspace_missing": older & done & ~_is("$.workspace", "STRING"),
    }


def validate_log_rows(log: DataFrame, versions: list[str], strict: bool = False) -> DataFrame:
    """``line, problem`` of the rows' envelopes, given the known schema versions of runs.

    ``strict`` raises if there is any, as a whole-log refusal.
    """
    found = violations(with_kind(log), ["line"], row_problems(versions))
    if strict and not found.isEmpty():
        raise ValueError("the log has rows that are not valid")
    return found


def read_run_reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nested reports (one JSON document a line) as tables of verdicts, admissions, findings, artifacts and steps."""
    reports = spark.read.schema(REPORT).json(path)
    heads = {"reports": reports.select("run_id", "case_id", "status")}
    return heads | {c: reports.select("run_id", F.inline(c)) for c in ("verdicts", "admissions", "findings", "artifacts", "steps")}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark spells it, and the path within."""
    scheme, _, rest = path.partition(":") if re.match(r"[a-z][a-z0-9+.-]*:/", path) else ("file", "", path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, inner = rest.lstrip("/").partition("/")
    system, start = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{authority}/")
    return system, f"{start.rstrip('/')}/{inner}"


def stream_digest(stream) -> str:
    """SHA-256 of what is left of a stream, CHUNK bytes at a time."""
    digest = hashlib.sha256()
    while piece := stream.read(CHUNK):
        digest.update(piece)
    return digest.hexdigest()


def _digest(path: str) -> str | None:
    system, inner = _opened(path)
    try:
        with system.open_input_stream(inner) as stream:
            return stream_digest(stream)
    except FileNotFoundError:
        return None


LISTED = T.StructType()
for _name, _kind in (("file", T.StringType()), ("path", T.StringType()), ("bytes", T.LongType()), ("mtime", T.LongType()), ("inode", T.LongType()), ("folder", T.BooleanType())):
    LISTED.add(_name, _kind)


def _children(file: str, path: str) -> list[tuple]:
    """Rows of LISTED for what lies in a folder; inodes are known of local files only, whose links to folders are not followed."""
    system, inner = _opened(file)
    local, out = isinstance(system, fs.LocalFileSystem), []
    for info in system.get_file_info(fs.FileSelector(inner)):
        folder = info.type == fs.FileType.Directory
        if info.type not in (fs.FileType.File, fs.FileType.Directory) or (folder and local and os.path.islink(info.path)):
            continue
        name = info.base_name
        inode = os.stat(info.path).st_ino if local else None
        out.append((f"{file.rstrip('/')}/{name}", f"{path}/{name}" if path else name, None if folder else info.size, info.mtime_ns, inode, folder))
    return out


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``file, path, bytes, mtime, inode`` of all files below a folder, empty and hidden ones too; none is opened.

    Folders of one depth are listed in tasks of their own and written; only whether there are more comes to the driver.
    """

    def step(batches):
        for batch in batches:
            found = [row for folder in zip(*(c.to_pylist() for c in batch.columns)) for row in _children(*folder)]
            columns = list(zip(*found)) or [()] * len(LISTED)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=LISTED.names)

    parts = Parts(spark, "tree", LISTED)
    folders = spark.createDataFrame([(root, "")], "file string, path string")
    while not folders.isEmpty():
        found = parts.add(folders.repartition("file").mapInArrow(step, LISTED))
        folders = found.filter("folder").select("file", "path")
    return parts.rows().filter("not folder").drop("folder")


def hash_files(listed: DataFrame) -> DataFrame:
    """``listed`` with ``sha256`` of each ``file``, read as a stream in memory of a CHUNK whatever its size; null for one that is gone.

    Files are dealt to tasks by name; a file is one task's, as its digest is one chain.
    """
    schema = T.StructType([*listed.schema, T.StructField("sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            places = batch.column(batch.schema.get_field_index("file")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(p) for p in places], pa.string())], names=schema.names)

    return listed.repartition("file").mapInArrow(run, schema)


def inventory_tree(spark: SparkSession, root: str, tree: str, cache: DataFrame | None = None) -> DataFrame:
    """``tree, path, sha256, bytes, mtime, inode, state`` of all files below a folder.

    Given an earlier inventory as ``cache``, files whose path, size, time and inode are as they were keep their digest as
    ``verified_cached`` and are not opened; the others are ``verified``.  A file that goes meanwhile is ``missing``.
    """
    listed = list_tree(spark, root)
    found = [F.lit(tree).alias("tree"), "path", "sha256", "bytes", "mtime", "inode"]
    verified = F.when(F.col("sha256").isNull(), "missing").otherwise("verified").alias("state")
    if cache is None:
        return hash_files(listed).select(*found, verified)
    known = cached_digest_join(listed, cache.filter("sha256 is not null"))
    fresh = hash_files(known.filter("state = 'to_hash'").drop("sha256", "state")).select(*found, verified)
    return known.filter("state = 'verified_cached'").select(*found, "state").unionByName(fresh)


def at_pointer(body: Column, pointer: Column) -> Column:
    """The text of what a JSON pointer, given row by row, leads to in a variant; null if nothing is there.

    A part of digits is a place in an array and a key of an object; the empty pointer is the whole document.
    """
    parts = F.split(pointer, "/", -1)
    names = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))

    def step(value: Column, name: Column) -> Column:
        place = F.when(name.rlike("^(0|[1-9][0-9]{0,8})$"), F.try_variant_get(value, F.concat(F.lit("$["), name, F.lit("]")), "variant"))
        plain = F.when(name.rlike(PLAIN_NAME), F.try_variant_get(value, F.concat(F.lit("$['"), name, F.lit("']")), "variant"))
        # Names that a path cannot spell are looked up among all keys.
        other = F.when(~name.rlike(PLAIN_NAME), F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), name))
        return F.coalesce(place, plain, other)

    return F.try_variant_get(F.aggregate(names, body, step), "$", "string")


def extract_claims(outputs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Claim fields of output documents, where the descriptor of each output says.

    ``outputs(output_id, descriptor_id, document)``; ``descriptors(descriptor_id, model, lower_at, upper_at,
    nominal_at, value_at, optional)``.  Pointers are data, each followed in its own row, so the plan is one for any number
    of them.  A missing value is a problem unless optional.
    """
    at = [f"{f}_at" for f in ("lower", "upper", "nominal", "value")]
    rows = outputs.withColumn("body", F.try_parse_json("document")).join(descriptors, "descriptor_id")
    rows = rows.withColumns({c.removesuffix("_at"): at_pointer(F.col("body"), F.col(c)) for c in at})
    lost = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c.removesuffix("_at")).isNull() & ~F.col("optional"), F.lit(f"absent:{c.removesuffix('_at')}")) for c in at]))
    problem = F.when(F.col("body").isNull(), "not_json").when(F.size(lost) > 0, F.array_join(lost, ","))
    return rows.select("output_id", "model", "lower", "upper", "nominal", "value", problem.alias("problem"))
