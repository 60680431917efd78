"""Problem 4: generated, minified, vendored and bulk-data files among source files.

Files that claim a third-party origin (a header that names a project's release or contributors, or a folder named after
such a project or its release) are the seeds. An inverted index over hashes of the seeds' lines, joined with the lines of
all files, gives the exact containment of each other file in each seed, counted over rare lines, that is lines under few
file names or often in seeds; edited copies without a claim come out by it, across repositories. The index is cut down
on the map side by a bit map of fixed size. To the other files rules on their composition apply: a generator's header
comment, the shape of compressed scripts and style sheets, rows of one shape, and encoded blobs. All rules look at the
whole text.

Defined results: null, empty and blank contents get no label; repeated rows of a file count once; null languages are read
off the path; sizes are those of the content, as size_bytes may disagree; other columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bits import bit_map, place

#: Share of a file's rare lines that must stand in one seed, and of that seed's rare lines.
CONTAINMENT = 0.6
#: A line is rare if at least this share of the files that hold it are seeds, or if it stands under few file names: this
#: share of all files, and not less than so many. Copies of a file bear its name, so their number does not matter.
SEED_SHARE, NAME_SHARE, FEW_NAMES = 0.2, 0.0003, 20
#: A claim may also stand in a comment between the first lines of code (a package clause, imports), this far.
NEAR_LINES = 12

# fixed values: what headers of generators and of third-party files say
_generated = re.compile(
    r"(?i)@generated\b|<auto-?generated\b|\b(?:automatically|auto)[ -]?generated (?:by|from|with|using|\d)|autogenerated\b"
    r"|\bcode generated (?:by|from)\b|\b(?:this file|file|code) (?:was|is|has been) (?:automatically |auto-?)?generated\b"
    r"|generated (?:by|from|with) .{0,80}(?:do not (?:edit|modify)|\d+\.\d+)|\bcreated from template .* edit the template"
    r"|\b(?:automatisch )?(?:erzeugt|generiert) (?:mit|von|aus|durch)\b|\b(?:fichier|code) (?:produit|généré|genere) (?:par|automatiquement)\b"
    r"|\b(?:archivo|código|codigo|fichero) (?:generado|producido) (?:por|automáticamente|automaticamente)\b"
    r"|any changes made here will be lost|changes to this file (?:will|may) be (?:lost|overwritten)"
)
_not_generated = re.compile(r"(?i)\b(?:no longer|not|never|used to be|formerly|nicht mehr|plus)\b.{0,20}(?:generated|erzeugt|produit)|maintained by hand|by hand since")
_claim = re.compile(
    r"(?i)\(c\) \d{4}(?:-\d{4})? the ([\w\-]+) (?:contributors|authors|project|developers)|\b([a-z][\w\-]+) v\d+\.\d+\.\d+ - https?://"
    r"|(?:copied|imported|taken|vendored)(?: verbatim)? from ([\w\-]+) (?:release|version|v)\s*\d|\bupstream: ([\w\-]+) (?:release|version|v)\s*\d"
)
_release = re.compile(r"(?:^|/)([A-Za-z][A-Za-z_]*(?:-[A-Za-z]+)*)-v?\d+\.\d+(?:\.\d+)*/")
# fixed values: folders that hold what others wrote
_THIRD_PARTY = "vendor vendors vendored third_party third-party thirdparty 3rdparty external externals extern deps dependencies contrib bundled".split()
_comment = re.compile(r"\s*(?://|#|--|/\*|\*|<!--|;|%|\"\"\"|''')")
#: Go's rule: a line of its own on any line.
_marker = re.compile(r"(?://|#) Code generated .* DO NOT EDIT\.")
_resource = re.compile(r"public static final int \w+\s*=\s*0x[0-9a-fA-F]{8};")
_shape_name = re.compile(r"\"[^\"]*\"|'[^']*'|[A-Za-z_]\w*")
_string = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`")
_pem = re.compile(r"-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----", re.S)
_blob = re.compile(r"[A-Za-z0-9+/]{60,}={0,2}|(?:\\x[0-9a-fA-F]{2}){20,}")
_lines = re.compile(r"\r\n|\n|\r")
SETTINGS = {"properties", "ini", "cfg", "toml", "env", "conf", "md", "rst", "txt"}


def head(lines: list[str]) -> Iterator[str]:
    """Comment lines before the first line of code, however many; lines inside an open block comment or docstring too."""
    closing = None
    for line in lines:
        text = line.strip()
        if closing:
            yield line
            if closing in text:
                closing = None
            continue
        if not text or text.startswith(("#!", "<?", "<!DOCTYPE", "<!doctype")) or text in ("'use strict';", '"use strict";'):
            continue
        if not _comment.match(line):
            return
        yield line
        for opening, end in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''")):
            if text.startswith(opening) and end not in text[len(opening) :]:
                closing = end


def header_claims(lines: list[str]) -> tuple[bool, str | None]:
    """Whether the head or a whole-line marker says that a tool wrote the file, and the project it is said to come from."""
    generated, project = any(_marker.fullmatch(line.rstrip()) for line in lines), None
    for line in (*head(lines), *(x for x in lines[:NEAR_LINES] if _comment.match(x))):
        if not _not_generated.search(line) and _generated.search(line) and "%s" not in line:
            generated = True
        if project is None and (found := _claim.search(line)):
            project = next(g for g in found.groups() if g).lower()
    return generated, project


def composition(path: str, content: str, lines: list[str]) -> str | None:
    """generated, minified or data by the make-up of the text alone."""
    full = [x for x in (line.strip() for line in lines) if x]
    if not full:
        return None
    name = path.rsplit("/", 1)[-1].lower()
    ending = name.rsplit(".", 1)[-1] if "." in name else ""
    size = len(content)
    if re.search(r"_pb2(?:_grpc)?\.py$|\.pb\.(?:go|cc|h|ts|js)$|\.g\.(?:dart|cs|ts)$|(?:^|/)zz_generated", name):
        return "generated"
    if ending == "java" and sum(bool(_resource.match(x)) for x in full) >= 0.6 * len(full):
        return "generated"
    if ending in ("json", "map") and re.match(r"\s*\{\s*\"version\"\s*:\s*3\b", content) and '"mappings"' in content:
        return "minified"
    code = full[3:] if re.match(r"/\*!", full[0]) and len(full) > 3 else full
    # one long literal, a query for instance, makes no compressed script
    bare = [_string.sub('""', x) if len(x) > 400 else x for x in code]
    long = sum(len(x) for x in bare if len(x) > 400)
    blank = sum(map(content.count, " \t\r\n"))
    if ending in ("js", "mjs", "cjs", "css", "ts", "html", "svg") or not ending:
        if size > 400 and long >= 0.8 * sum(map(len, bare)) and blank < 0.08 * size:
            return "minified"
    text = _pem.sub("", content) if "-----BEGIN" in content else content
    blobs = sum(map(len, _blob.findall(text)))
    if size > 1000 and blobs >= 0.6 * len(content):
        return "data"
    if ending not in SETTINGS and len(full) >= 15:
        shapes = Counter(_shape_name.sub("w", re.sub(r"-?\d[\d.eE+\-]*", "0", x)) for x in full)
        same = shapes.most_common(1)[0][1]
        if same >= 0.8 * len(full):
            if ending == "ts" and any(x.startswith(("export type", "export interface", "declare")) for x in full[:3]):
                return "generated"
            row = shapes.most_common(1)[0][0]
            # rows of values; import lists and lists of names are code
            if row.count("0") >= 2 or re.match(r"w w w w \(|[\[({].*0", row) or row.count("w") >= 3 and "," in row and ending in ("json", "sql", "csv", "yaml", "yml"):
                return "data"
    return None


def _facts(df: DataFrame) -> DataFrame:
    """One row per file: n, repo_id, relative_path, generated, project, shape, lines (hashes of its lines)."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for path, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = _lines.split(content)
                generated, project = header_claims(lines)
                hashed = {digest(x) for x in (line.strip() for line in lines) if len(x) >= 8}
                row = (generated, project, composition(path or "", content, lines))
                for column, value in zip(out, (*row, np.fromiter(hashed, np.uint64, len(hashed)).view(np.int64))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(out[0], pa.bool_()),
                    pa.array(out[1], pa.string()),
                    pa.array(out[2], pa.string()),
                    pa.array(out[3], pa.list_(pa.int64())),
                ],
                ["repo_id", "relative_path", "generated", "project", "shape", "lines"],
            )

    rows = df.select(*(F.col(c).cast("string").alias(c) for c in ("repo_id", "relative_path", "content")))
    rows = rows.where("length(trim(content)) > 0")
    found = rows.mapInArrow(
        facts, "repo_id string, relative_path string, generated boolean, project string, shape string, lines array<bigint>"
    )
    return materialize(found.withColumn("n", F.monotonically_increasing_id()), "facts")


def _seeds(facts: DataFrame) -> DataFrame:
    """n and project of files with a claim: in the header, by a folder that bears a release of a project, or by a folder of
    its name, within a repository where a header or a release names the project, or below a folder for third parties.

    A folder that only bears the name of some project of another repository is no claim.
    """
    slim = facts.select("n", "repo_id", "project", "relative_path")
    release = F.lower(F.regexp_extract("relative_path", _release.pattern, 1))
    named = slim.withColumn("release", release)
    names = (
        named.select("repo_id", F.explode(F.array("project", F.when(F.col("release") != "", F.col("release")))).alias("name"))
        .where("name IS NOT NULL").distinct()
    )
    plain = F.transform(F.split(F.lower("relative_path"), "/"), lambda x: F.regexp_replace(x, r"-v?\d+(\.\d+)+$", ""))
    folders = slim.where("project IS NULL").select("n", "repo_id", F.posexplode(plain).alias("at", "name"), plain.alias("all"))
    above = F.when(F.col("at") > 0, F.get("all", F.col("at") - 1))
    folders = folders.select("n", "repo_id", "name", F.coalesce(above.isin(_THIRD_PARTY), F.lit(False)).alias("apart"))
    # a project is named once here and once for all repositories
    inside = folders.where("not apart").join(names, ["repo_id", "name"])
    apart = folders.where("apart").join(names.select("name").distinct(), "name")
    by_folder = inside.select("n", "name").unionByName(apart.select("n", "name")).groupBy("n").agg(F.min("name").alias("project"))
    return slim.where("project IS NOT NULL").select("n", "project").unionByName(by_folder)


def label_files(df: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """repo_id, relative_path, label (generated, minified, data, vendored or null) and project of each file."""
    facts = _facts(df)
    spark = df.sparkSession
    name = F.regexp_extract("relative_path", r"[^/]*$", 0)
    seeds = materialize(
        _seeds(facts).join(facts.select("n", "relative_path", "lines"), "n").select(
            "n", F.concat_ws("/", "project", name).alias("origin"), "project", "lines"
        ).withColumn("text", F.xxhash64("origin", F.sort_array("lines"))),
        "seeds",
    )
    seed_lines = seeds.select("n", F.explode("lines").alias("hash"))
    shared = spark.sparkContext.broadcast(bit_map(seed_lines.select("hash")))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            hashes = batch.column(1)
            flat = hashes.flatten().to_numpy()
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(hashes.offsets.to_numpy()))
            kept = seen[place(flat)]
            names = np.repeat(batch.column(2).to_numpy(), np.diff(hashes.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[kept]), pa.array(flat[kept]), pa.array(names[kept])], ["n", "hash", "name"]
            )

    index = materialize(
        facts.select("n", "lines", F.xxhash64(name).alias("name")).mapInArrow(prune, "n bigint, hash bigint, name bigint"), "index"
    )
    few = max(FEW_NAMES, int(NAME_SHARE * facts.count()))
    held = index.groupBy("hash").agg(F.count("*").alias("files"), F.countDistinct("name").alias("names"))
    seeded = seed_lines.groupBy("hash").agg(F.countDistinct("n").alias("seeds"))
    rare = held.join(seeded, "hash").where((F.col("names") <= few) | (F.col("seeds") >= SEED_SHARE * F.col("files"))).select("hash")
    # seeds of equal lines count once
    texts = seeds.dropDuplicates(["text"]).select("text", "origin", F.explode("lines").alias("hash")).join(rare, "hash")
    text_size = texts.groupBy("text").agg(F.count("*").alias("text_lines"))
    origins = texts.select("hash", "origin").distinct()
    own = facts.select("n", F.size("lines").alias("own_lines"))
    # rare lines of a file are its lines less the frequent ones among those seeds have
    frequent = index.join(rare, "hash", "left_anti").join(seeded, "hash", "left_semi").groupBy("n").agg(F.count("*").alias("frequent"))
    # what all seeds of one project and name hold together bounds what one of them does
    candidates = (
        index.join(origins, "hash").groupBy("n", "origin").agg(F.count("*").alias("both")).join(own, "n").join(frequent, "n", "left")
        .withColumn("rare_lines", F.col("own_lines") - F.coalesce("frequent", F.lit(0)))
        .where((F.col("both") >= 3) & (F.col("both") >= containment * F.col("rare_lines")))
        .select("n", "origin", "rare_lines")
    )
    copies = (
        index.select("n", "hash").join(candidates, "n").join(texts, ["hash", "origin"])
        .groupBy("n", "text", "origin", "rare_lines").agg(F.count("*").alias("both")).join(text_size, "text")
        .where((F.col("both") >= 3) & (F.col("both") >= containment * F.col("rare_lines")) & (F.col("both") >= containment * 0.7 * F.col("text_lines")))
        .groupBy("n").agg(F.max(F.struct("both", "origin"))["origin"].alias("origin"))
    )
    vendored = (
        seeds.select("n", F.col("project").alias("claimed"))
        .join(copies.select("n", F.substring_index("origin", "/", 1).alias("copied")), "n", "full")
        .select("n", F.coalesce("claimed", "copied").alias("origin_project"))
    )
    return facts.join(vendored, "n", "left").select(
        "repo_id",
        "relative_path",
        F.when(F.col("generated"), "generated")
        .when(F.col("shape").isNotNull(), F.col("shape"))
        .when(F.col("origin_project").isNotNull(), "vendored")
        .alias("label"),
        F.col("origin_project").alias("project"),
    )


def not_hand_written(labels: DataFrame) -> DataFrame:
    return labels.where("label IS NOT NULL").select("repo_id", "relative_path").distinct()
