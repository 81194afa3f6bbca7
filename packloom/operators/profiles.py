"""Saved option profiles as tables: reading, checking, editing and resolving them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.fixed_values import DEFAULT_MAX_KIB, DEFAULT_PROFILE, NO_DESCRIPTION, PACK_SUFFIX, PROFILE_FILE
from packloom.functions.paths import normalized

# Field name to type, in the order they are shown.
FIELDS = {
    "description": "string", "output_path": "string", "no_ignore": "boolean", "include": "string",
    "exclude": "string", "tree_include": "string", "tree_exclude": "string", "no_tree": "boolean",
    "tree_no_ignore": "boolean", "max_size": "bigint", "no_blacklist": "boolean",
}
_DEFAULTS = {"no_ignore": False, "no_tree": False, "no_blacklist": False, "max_size": DEFAULT_MAX_KIB}


def profile_files(entries: DataFrame, name: str = PROFILE_FILE) -> DataFrame:
    """``(project, text)`` of the profile file, by ``name``, at each project's root."""
    return entries.where(F.col("rel_path") == name).select("project", F.col("content").alias("text"))


def _document(text: Column) -> Column:
    """The text as a variant, null unless it is exactly one JSON value."""
    # parse_json stops at the end of the first value; both wrappings together leave no room for a second.
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    same = F.try_parse_json(F.concat(F.lit('{"one":'), text, F.lit("}")))
    single = F.try_variant_get(one, "$[1]", "variant").isNull() & same.isNotNull()
    return F.when(single, F.try_variant_get(one, "$[0]", "variant"))


def _is_large(value: Column) -> Column:
    """A whole number of 64 bits without sign that a signed one cannot hold."""
    number = F.try_variant_get(value, "$", "decimal(20,0)")
    return F.schema_of_variant(value).isin("DECIMAL(19,0)", "DECIMAL(20,0)") & number.between(F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**64 - 1)).cast("decimal(20,0)"))


def _field(profile: Column, name: str, sql_type: str) -> Column:
    """A field's value; a size beyond the range of a long is the largest long, which limits nothing either."""
    value = F.try_variant_get(profile, f"$.{name}", sql_type)
    if sql_type != "bigint":
        return value
    return F.coalesce(value, F.when(_is_large(F.try_variant_get(profile, f"$.{name}", "variant")), F.lit(2**63 - 1)))


def _is_kind(value: Column, sql_type: str) -> Column:
    """The variant is absent, JSON null, or strictly of the type; no casting from other types."""
    kind = F.schema_of_variant(value)
    exact = kind == {"string": "STRING", "boolean": "BOOLEAN", "bigint": "BIGINT"}[sql_type]
    if sql_type == "bigint":
        exact = (exact & (F.try_variant_get(value, "$", "bigint") >= 0)) | _is_large(value)
    return F.coalesce(value.isNull() | (kind == "VOID") | exact, F.lit(False))


def _well_typed(profile: Column) -> Column:
    """An object whose known fields all have their types; unknown fields are allowed."""
    checks = F.schema_of_variant(profile).startswith("OBJECT")
    for name, sql_type in FIELDS.items():
        checks = checks & _is_kind(F.try_variant_get(profile, f"$.{name}", "variant"), sql_type)
    return F.coalesce(checks, F.lit(False))


def classify_configs(files: DataFrame) -> DataFrame:
    """Add ``status`` (ok, legacy, invalid) to ``(project, text)``; a bad file is a row, not a failure.

    legacy is the old flat form without named profiles.
    """
    parsed = files.withColumn("_doc", _document(F.col("text"))).withColumn(
        "_profiles", F.try_variant_get("_doc", "$.profiles", "map<string,variant>"))
    sound = F.col("_profiles").isNotNull() & F.forall(F.map_values("_profiles"), _well_typed)
    status = F.when(F.coalesce(sound, F.lit(False)), "ok").when(_well_typed(F.col("_doc")), "legacy").otherwise("invalid")
    return parsed.withColumn("status", status).drop("_doc", "_profiles")


def parse_profiles(files: DataFrame) -> DataFrame:
    """``project, name`` and the fields, one row per profile of every file in good order."""
    good = classify_configs(files).where("status = 'ok'")
    each = good.select("project", F.explode(
        F.try_variant_get(_document(F.col("text")), "$.profiles", "map<string,variant>")).alias("name", "_profile"))
    return each.select("project", "name", *[
        _field(F.col("_profile"), name, kind).alias(name) for name, kind in FIELDS.items()])


def valid_profile_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]+\z"), F.lit(False))


def list_profiles(profiles: DataFrame) -> DataFrame:
    """``project, name, description`` by name; rows stay distributed and sorted."""
    return profiles.select(
        "project", "name", F.coalesce("description", F.lit(NO_DESCRIPTION)).alias("description")
    ).orderBy("project", "name")


def resolve_configs(projects: DataFrame, profiles: DataFrame, statuses: DataFrame | None = None,
                    pack_suffix: str = PACK_SUFFIX) -> DataFrame:
    """One row of final options per project: own options, else the selected profile's, else defaults.

    ``projects`` has ``project, requested`` (profile name or null), any option fields set for this
    run, and, if wanted, ``no_config``: true for projects that do not look at their profile file.
    ``config_status``: ok; profile_not_found; file_not_found when a profile was asked
    for and there is no profile file; or the file's own bad status (see :func:`classify_configs`),
    when ``statuses`` (project, status) is given.
    """
    own = [c for c in FIELDS if c in projects.columns]
    looks = ~F.coalesce(F.col("no_config"), F.lit(False)) if "no_config" in projects.columns else F.lit(True)
    asked = projects.withColumn("_name", F.coalesce("requested", F.lit(DEFAULT_PROFILE))).withColumn("_looks", looks)
    saved = profiles.select(
        "project", F.col("name").alias("_name"), F.lit(True).alias("_found"),
        *[F.col(c).alias(f"_saved_{c}") for c in FIELDS])
    joined = asked.join(saved.withColumn("_looks", F.lit(True)), ["project", "_name", "_looks"], "left")
    if statuses is None:
        statuses = profiles.select("project").distinct().withColumn("status", F.lit("ok"))
    joined = joined.join(statuses.select("project", F.col("status").alias("_file")), "project", "left")

    def value(name: str) -> Column:
        sources = ([F.col(name)] if name in own else []) + [F.col(f"_saved_{name}")]
        if name in _DEFAULTS:
            sources.append(F.lit(_DEFAULTS[name]).cast(FIELDS[name]))
        if name == "output_path":
            sources.append(F.concat(F.col("project"), F.lit(pack_suffix)))
        return F.coalesce(*sources)

    missing = F.col("requested").isNotNull() & F.col("_found").isNull()
    status = (
        F.when(~F.col("_looks"), "ok").when(F.col("_file").isin("legacy", "invalid"), F.col("_file"))
        .when(missing & F.col("_file").isNull(), "file_not_found")
        .when(missing, "profile_not_found").otherwise("ok"))
    resolved = joined.select(
        "project", F.col("_name").alias("profile"), status.alias("config_status"),
        *[value(c).alias(c) for c in FIELDS if c != "description"])
    return resolved.withColumn("tree_no_ignore", F.coalesce("tree_no_ignore", "no_ignore"))


def upsert_profiles(existing: DataFrame, changes: DataFrame, replace: bool = False) -> DataFrame:
    """Merge changed profiles in: set fields win and unset fields stay, or whole rows with ``replace``.

    Both sides have ``project, name`` and the fields, unique by (project, name).
    """
    key = ["project", "name"]
    new = changes.select(*key, F.struct(*FIELDS).alias("_new"))
    old = existing.select(*key, F.struct(*FIELDS).alias("_old"))
    pick = lambda c: (
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) if replace
        else F.coalesce(f"_new.{c}", f"_old.{c}"))
    return old.join(new, key, "full_outer").select(*key, *[pick(c).alias(c) for c in FIELDS])


def current_outputs(resolved: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``project, rel_path`` of the packs that resolved options name inside their own project.

    ``roots`` (project, root) tells which absolute paths are inside; without it none is.
    """
    path = F.col("output_path")
    if roots is None:
        rows = resolved.select("project", path, F.lit(None).cast("string").alias("root"))
    else:
        rows = resolved.join(roots.select("project", "root").distinct(), "project", "left").select("project", path, "root")
    tidy = F.when(path.startswith("/"), F.concat(F.lit("/"), normalized(path))).otherwise(normalized(path))
    root = F.concat(F.rtrim("root", F.lit("/")), F.lit("/"))
    inside = F.when(~path.startswith("/"), tidy).when(F.startswith(tidy, root), F.substring(tidy, F.length(root) + 1, F.length(tidy)))
    return rows.select("project", inside.alias("rel_path")).where(
        F.col("rel_path").isNotNull() & (F.col("rel_path") != "") & ~F.col("rel_path").rlike(r"\A\.\.(?:/|\z)"))


# Edits that need the profile to exist already, and those that write fields.
_NEED_PROFILE = ["update", "replace", "delete", "rename"]
_MERGE, _WRITE_WHOLE = ["update", "save"], ["create", "replace", "save_whole"]


def edit_profiles(existing: DataFrame, edits: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """The edits with their ``status``; one edit per profile at a time.

    ``op`` is create (the name must be free), update and replace (merge into, or put in place of,
    an existing profile), save and save_whole (the same, but also for new names), delete, or
    rename (``new_name`` must be free).  Names must be valid.  With ``statuses`` (project,
    status) a file in bad order is never touched.  A name that several edits of one table would
    write or rename to is refused to all of them.  Status is ok, invalid_name, invalid_file,
    already_exists, not_found or claimed_twice; :func:`apply_edits` applies those that are ok.
    """
    names = existing.select("project", "name", F.lit(True).alias("_exists"))
    targets = existing.select("project", F.col("name").alias("new_name"), F.lit(True).alias("_taken"))
    checked = edits.join(names, ["project", "name"], "left").join(targets, ["project", "new_name"], "left")
    if statuses is None:
        checked = checked.withColumn("_bad_file", F.lit(False))
    else:
        files = statuses.select("project", (F.col("status") != "ok").alias("_bad_file"))
        checked = checked.join(files, "project", "left").fillna(False, "_bad_file")
    renames, exists = F.col("op") == "rename", F.col("_exists").isNotNull()
    status = (
        F.when(~valid_profile_name(F.col("name")) | (renames & ~valid_profile_name(F.col("new_name"))), "invalid_name")
        .when(F.col("_bad_file"), "invalid_file")
        .when((renames & F.col("_taken").isNotNull()) | ((F.col("op") == "create") & exists), "already_exists")
        .when(F.col("op").isin(_NEED_PROFILE) & ~exists, "not_found")
        .otherwise("ok"))
    judged = checked.withColumn("status", status).drop("_exists", "_taken", "_bad_file")
    # Edits of one profile, and renames that end at its name.
    claims = judged.where("status = 'ok'").select("project", F.explode(F.array_compact(F.array(
        "name", F.when(F.col("op") == "rename", F.col("new_name"))))).alias("_claim"))
    twice = claims.groupBy("project", "_claim").count().where("count > 1").select("project", "_claim", F.lit(True).alias("_twice"))
    for name in ("name", "new_name"):
        asked = F.col("op") == "rename" if name == "new_name" else F.lit(True)
        judged = judged.join(twice.withColumnRenamed("_claim", name), ["project", name], "left").withColumn(
            "status", F.when(F.col("_twice") & asked & (F.col("status") == "ok"), "claimed_twice").otherwise(F.col("status"))).drop("_twice")
    return judged.select(*edits.columns, "status")


def apply_edits(existing: DataFrame, edits: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Profiles after the edits that :func:`edit_profiles` accepts; refused edits change nothing."""
    key = ["project", "name"]
    accepted = edit_profiles(existing, edits, statuses).where("status = 'ok'").select(
        *key, "op", "new_name", F.struct(*FIELDS).alias("_new"))
    old = existing.select(*key, F.struct(*FIELDS).alias("_old"))
    both = old.join(accepted, key, "full_outer").where("op is null or op <> 'delete'")
    field = lambda c: (
        F.when(F.col("op").isin(_WRITE_WHOLE), F.col(f"_new.{c}"))
        .when(F.col("op").isin(_MERGE), F.coalesce(f"_new.{c}", f"_old.{c}")).otherwise(F.col(f"_old.{c}")))
    return both.select(
        "project", F.when(F.col("op") == "rename", F.col("new_name")).otherwise(F.col("name")).alias("name"),
        *[field(c).alias(c) for c in FIELDS])
