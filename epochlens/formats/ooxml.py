"""OOXML packages as tables of parts and relationships.

Reachability is a breadth-first search over all packages at once: each step is one join of the
frontier with the relationship table. The checks are joins and aggregates over reached rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.formats.zip import DEFLATE, ZipConfig, check_members, members, verdicts_of
from epochlens.functions import xmlparts
from epochlens.functions.paths import extension, posix_norm
from epochlens.session import cut_lineage

CONTENT_TYPES_PART = "[Content_Types].xml"
ROOT_RELS = "_rels/.rels"
# Main part and its content type per extension.
MAIN_PART = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
MAIN_TYPE = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml",
}
OFFICE_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
CONTROL = "[\\x00-\\x1F\\x7F]"


@dataclass(frozen=True)
class OoxmlConfig:
    orphans_allowed: bool = False


def bad_entry_name(name: Column) -> Column:
    """Names that deviate from plain relative part paths."""
    return (
        (name == "") | name.rlike(CONTROL) | name.contains("\\") | name.startswith("/")
        | name.contains("//") | F.concat(F.lit("/"), name, F.lit("/")).rlike("/\\.\\.?/")
    )


def target_problem(target: Column) -> Column:
    """Why a relationship target cannot be used, before it is resolved; else null."""
    low = F.lower(target)
    return (
        F.when(target == "", "empty_target")
        .when(target.rlike(CONTROL), "target_contains_control_characters")
        .when(target.contains("\\"), "target_contains_backslash")
        .when(target.contains("//"), "target_contains_double_slash")
        .when(low.contains("%2f") | low.contains("%5c"), "target_contains_percent_encoded_slash")
    )


def resolve_target(source: Column, target: Column) -> Column:
    """Target relative to the folder of its source part; one leading slash is ignored."""
    bare = F.regexp_replace(target, "^/", "")
    folder = F.regexp_extract(source, "^(.*)/[^/]*$", 1)
    return posix_norm(F.when(folder == "", bare).otherwise(F.concat(folder, F.lit("/"), bare)))


def resolved_problem(path: Column) -> Column:
    return (
        F.when(path.isin("", ".", "/"), "normalized_target_empty")
        .when(path.startswith("/"), "normalized_target_absolute")
        .when((path == "..") | path.startswith("../"), "normalized_target_escapes_package")
    )


def source_of_rels(part: Column) -> Column:
    """``word/_rels/document.xml.rels`` belongs to ``word/document.xml``; the root to nothing."""
    folder = F.regexp_extract(part, r"^(?:(.*)/)?_rels/[^/]*\.rels$", 1)
    base = F.regexp_extract(part, r"^(?:.*/)?_rels/([^/]*)\.rels$", 1)
    return F.when(folder == "", base).otherwise(F.concat(folder, F.lit("/"), base))


def valid_url(url: Column) -> Column:
    """Syntax gate for external targets: parseable, no white space, no control characters."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    brackets = authority.contains("[") != authority.contains("]")
    return ~url.rlike(r"[\s\x00-\x1F\x7F]") & (url != "") & ~brackets


def _xml_facts() -> Column:
    """What a member says as an XML part, parsed whole in one pass; only the facts leave the worker."""
    part = F.col("name").cast("string")
    kind = F.when(part.endswith(".rels"), "rels").when(part == CONTENT_TYPES_PART, "types")
    return xmlparts.part_facts(F.col("data"), F.col("method") == DEFLATE, kind)


def _problems(df: DataFrame, *checks: tuple[int, Column, Column | str]) -> DataFrame:
    """(file_path, o, reason) of the failed checks of every row; a check is its order, its failure
    condition and its wording. All checks of a table are made in one pass over it."""
    told = F.array(*[
        F.when(bad, F.struct(F.lit(o).alias("o"), (F.lit(why) if isinstance(why, str) else why).alias("reason")))
        for o, bad, why in checks
    ])
    return df.select("file_path", F.explode(F.filter(told, lambda p: p.isNotNull())).alias("p")).select("file_path", "p.*")


def reachable(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, part, depth): the empty root part and everything reached from it. Each round
    joins the frontier with the edges and keeps parts not seen before, until there are none."""
    seen = cut_lineage(files.select("file_path", F.lit("").alias("part"), F.lit(0).alias("depth")))
    frontier = seen
    links = cut_lineage(edges.select("file_path", F.col("source").alias("part"), "target").distinct())
    for depth in itertools.count(1):
        step = (
            frontier.select("file_path", "part").join(links, ["file_path", "part"])
            .select("file_path", F.col("target").alias("part")).distinct()
            .join(seen.select("file_path", "part"), ["file_path", "part"], "left_anti")
        )
        frontier = cut_lineage(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _text(*items) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in items])


def package_problems(parts: DataFrame, cfg: OoxmlConfig = OoxmlConfig()) -> DataFrame:
    """(file_path, o, reason): every failed check of every package, ``o`` giving the order in which
    a sequential validator would meet them."""
    col = F.col
    per_file = parts.groupBy("file_path").agg(
        F.count("*").alias("n"), F.count_distinct("part").alias("nd"),
        F.min(F.when(bad_entry_name(col("part")), col("part"))).alias("odd"),
        F.bool_or(col("part") == CONTENT_TYPES_PART).alias("has_ct"),
        F.bool_or(col("part") == ROOT_RELS).alias("has_rels"),
        F.bool_or((col("part") == CONTENT_TYPES_PART) & col("types").isNull()).alias("bad_ct"),
        F.bool_or((col("part") == ROOT_RELS) & col("rels").isNull()).alias("bad_rels"),
    )
    found = [_problems(
        per_file,
        (2, col("nd") < col("n"), "ooxml_duplicate_entry_names"),
        (3, col("odd").isNotNull(), _text("ooxml_path_suspicious:where=zip_entry,value=", col("odd"))),
        (4, ~col("has_ct"), "ooxml_missing_content_types"), (5, ~col("has_rels"), "ooxml_missing_root_rels"),
        (6, col("bad_ct"), "ooxml_ct_xml_parse_fail"), (7, col("bad_rels"), "ooxml_rels_xml_parse_fail"),
    )]

    rel = parts.filter(col("part").endswith(".rels")).select(
        "file_path", "part", source_of_rels(col("part")).alias("source"), F.explode("rels").alias("r")
    ).select("file_path", "part", "source", "r.*")
    # Read by most checks and by every search round, and slim: resolved once.
    edges = cut_lineage(rel.withColumn("why", target_problem(col("target"))).withColumn(
        "resolved", F.when(col("why").isNull(), resolve_target(col("source"), col("target")))
    ).withColumn("why", F.coalesce("why", resolved_problem(col("resolved")))))

    types = parts.filter(col("types").isNotNull()).select("file_path", F.explode("types").alias("t")).select("file_path", "t.*")
    override = types.filter("override").groupBy("file_path", col("name").alias("part")).agg(F.max("type").alias("o_type"))
    default = types.filter("NOT override").groupBy("file_path", col("name").alias("x")).agg(F.max("type").alias("d_type"))
    last_ext = F.when(col("part").contains("."), F.lower(F.substring_index("part", ".", -1))).otherwise("")
    typed = cut_lineage(
        parts.select("file_path", "part", "well_formed").dropDuplicates(["file_path", "part"])
        .withColumn("x", last_ext)
        .join(override, ["file_path", "part"], "left").join(default, ["file_path", "x"], "left")
        .select("file_path", "part", "well_formed", F.coalesce("o_type", "d_type").alias("ctype"))
    )
    names = typed.select("file_path", "part")

    facts = F.struct("external", "why", "resolved", "target")
    exact, alike = col("type") == OFFICE_DOCUMENT, col("type").endswith("/officeDocument")
    office = per_file.select("file_path").join(
        edges.filter(col("part") == ROOT_RELS).groupBy("file_path").agg(
            F.count_if(exact).alias("exact"), F.count_if(alike).alias("alike"),
            F.min(F.when(exact, facts)).alias("m1"), F.min(F.when(alike, facts)).alias("m2"),
        ), "file_path", "left",
    ).select(
        "file_path", extension(col("file_path")).alias("ext"),
        F.coalesce(F.when(col("exact") > 0, col("exact")).otherwise(col("alike")), F.lit(0)).alias("k"),
        F.coalesce("m1", "m2").alias("m"),
    ).select("file_path", "ext", "k", "m.*").withColumnRenamed("resolved", "part")
    main = office.join(typed, ["file_path", "part"], "left")
    wanted = F.create_map(*[F.lit(x) for kv in MAIN_PART.items() for x in kv])[col("ext")]
    wanted_type = F.create_map(*[F.lit(x) for kv in MAIN_TYPE.items() for x in kv])[col("ext")]
    one, inside = col("k") == 1, ~F.coalesce("external", F.lit(False))
    present = one & inside & col("why").isNull() & col("well_formed").isNotNull()
    intended = present & col("ext").isin(list(MAIN_PART))
    found.append(_problems(
        main,
        (8, ~one, _text("ooxml_rels_officeDocument_count:k=", col("k"))),
        (9, one & ~inside, "ooxml_officeDocument_external_target_forbidden"),
        (10, one & inside & col("why").isNotNull(),
         _text("ooxml_path_suspicious:where=rels_target,value=", col("target"), ",why=", col("why"))),
        (11, one & inside & col("why").isNull() & col("well_formed").isNull(), _text("ooxml_missing_main_part:target=/", col("part"))),
        (12, intended & (col("part") != wanted), _text("ooxml_type_mismatch:ext=", col("ext"), ",target=/", col("part"))),
        (13, intended & col("ctype").isNull(), _text("ooxml_ct_undetermined:part=/", col("part"))),
        (14, intended & (F.trim("ctype") != wanted_type),
         _text("ooxml_main_ct_mismatch:part=/", col("part"), ",ct=", col("ctype"))),
    ))
    found.append(_problems(
        override.join(names, ["file_path", "part"], "left_anti"),
        (15, F.lit(True), _text("ooxml_ct_override_missing_part:part=/", col("part"))),
    ))

    links = edges.filter("NOT external AND why IS NULL").select("file_path", "source", col("resolved").alias("target"))
    reach = cut_lineage(reachable(
        links.join(names.withColumnRenamed("part", "target"), ["file_path", "target"], "left_semi"), per_file
    ))
    live = edges.join(
        reach.select("file_path", col("part").alias("source")), ["file_path", "source"], "left_semi"
    ).join(names.select("file_path", col("part").alias("resolved"), F.lit(True).alias("there")), ["file_path", "resolved"], "left")
    found.append(_problems(
        live,
        (20, ~col("external") & col("why").isNotNull(),
         _text("ooxml_path_suspicious:where=rels_target,value=", col("target"), ",why=", col("why"))),
        (20, col("external") & ~valid_url(col("target")), _text("ooxml_url_invalid:value=", col("target"))),
        (20, ~col("external") & col("why").isNull() & col("there").isNull(),
         _text("ooxml_dangling_relationship:target=/", col("resolved"))),
    ))
    reached = typed.join(reach.filter("depth > 0").select("file_path", "part"), ["file_path", "part"], "left_semi")
    low = F.lower(F.trim("ctype"))
    is_xml = F.coalesce(low.endswith("+xml") | low.endswith("/xml"), F.lit(False))
    found.append(_problems(
        reached,
        (20, col("ctype").isNull(), _text("ooxml_ct_undetermined:part=/", col("part"))),
        (20, is_xml & ~F.coalesce("well_formed", F.lit(True)), _text("ooxml_xml_parse_fail:part=/", col("part"))),
    ))
    followed = parts.filter(col("part").endswith(".rels")).withColumn("source", source_of_rels(col("part"))).join(
        reach.select("file_path", col("part").alias("source")), ["file_path", "source"], "left_semi"
    ).groupBy("file_path").agg(
        F.min(F.when(col("rels").isNull(), col("part"))).alias("spoilt"),
    )
    found.append(_problems(
        followed, (20, col("spoilt").isNotNull(), _text("ooxml_rels_parse_fail:part=/", col("spoilt")))
    ))
    if not cfg.orphans_allowed:
        orphans = names.filter(~col("part").endswith(".rels") & (col("part") != CONTENT_TYPES_PART)).join(
            reached.select("file_path", "part"), ["file_path", "part"], "left_anti"
        ).groupBy("file_path").agg(F.count("*").alias("n"))
        found.append(_problems(orphans, (30, F.lit(True), _text("ooxml_orphan_parts:n=", col("n")))))
    return reduce(DataFrame.unionByName, found)


CHECKS_WHEN_CLEAN = 7


def ooxml_verdicts(files: DataFrame, cfg: OoxmlConfig = OoxmlConfig(), zcfg: ZipConfig = ZipConfig()) -> DataFrame:
    """Validator verdict per file: the container must pass first, then the package checks; the
    first failed check decides. Files are read once: their members are checked and parsed in the same pass."""
    checked = cut_lineage(check_members(members(files, zcfg).withColumn("x", _xml_facts()), zcfg))
    container = cut_lineage(verdicts_of(checked.drop("x"), zcfg, force_intent=True))
    sound = container.filter("verdict = 'benign'").select("file_path")
    parts = cut_lineage(checked.filter(F.col("idx") >= 0).join(sound, "file_path", "left_semi").select(
        "file_path", F.col("entry").alias("part"), "x.rels", "x.types", "x.well_formed"))
    first = package_problems(parts, cfg).groupBy("file_path").agg(
        F.min(F.struct("o", "reason")).alias("p")
    ).select("file_path", F.col("p.reason").alias("package"))
    intended = extension(F.col("file_path")).isin(list(MAIN_PART))
    j = container.join(first, "file_path", "left")
    kind = (
        F.when(F.col("verdict") == "not_evaluated", "skip")
        .when((F.col("verdict") != "benign") & intended, "container")
        .when(F.col("verdict") != "benign", "foreign")
        .when(F.col("package").isNotNull(), "package").otherwise("clean")
    )
    bad = F.col("kind").isin("container", "package")
    clean = F.col("kind") == "clean"
    count = F.when(bad, 1).when(clean, CHECKS_WHEN_CLEAN).otherwise(0).cast("bigint")
    return j.withColumn("kind", kind).select(
        "file_path", "file_size", count.alias("num_windows"),
        F.when(bad, 1).otherwise(0).cast("bigint").alias("num_suspicious_windows"),
        F.when(bad, 1).when(clean, 0).alias("min_score"), F.when(bad, 1).when(clean, 0).alias("max_score"),
        F.when(bad, "encrypted").when(clean, "benign").otherwise("not_evaluated").alias("verdict"),
        F.when(F.col("kind") == "skip", F.col("note"))
        .when(F.col("kind") == "container", F.concat(F.lit("ooxml_precondition_failed:zip_"), "note"))
        .when(F.col("kind") == "foreign", "not_ooxml_or_zip_precondition_failed")
        .when(F.col("kind") == "package", F.col("package")).otherwise("all_components_ok").alias("note"),
    )
