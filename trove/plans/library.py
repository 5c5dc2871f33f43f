"""Plans of moves: merging libraries, consolidating event folders, organizing, re-homing, transfers and decisions.

Every function gives a table of moves and touches no file; plans/actions.py carries a plan out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trove.functions.hashes import verdict
from trove.functions.paths import file_name, is_event_name, parent, parts, rebase, relative_to, split_event
from trove.functions.templates import description, destination, event_folder
from trove.operators.duplicates import confirmed_groups
from trove.plans.naming import base_name, claim_names, in_path_order
from trove.sources.storage import discard, stored


def _named(moves: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """moves (source, dir, name, seq, ...) with target: dir and a name that collides with none. A source is moved once."""
    claim = F.xxhash64("dir", base_name(F.col("name")))  # equal hashes of other names only let more through
    moves = stored(moves.dropDuplicates(["dir", "seq"]).withColumn("claim", claim), "moves")
    there = None if existing is None else existing.withColumn("claim", claim)
    all_claims = moves.select("claim") if there is None else moves.select("claim").unionByName(there.select("claim"))
    crowd = stored(all_claims.groupBy("claim").agg(F.count("*").alias("n")).filter("n > 1").select("claim"), "crowd")
    free = moves.join(crowd, "claim", "left_anti").withColumn("target", F.concat_ws("/", "dir", "name"))
    met = moves.join(crowd, "claim", "left_semi")
    given = claim_names(met, None if there is None else there.join(crowd, "claim", "left_semi")).select("dir", "seq", "given")
    dealt = met.join(given, ["dir", "seq"]).withColumn("target", F.concat_ws("/", "dir", "given")).drop("given")
    return free.unionByName(dealt).drop("claim")


def canonical_folders(files: DataFrame) -> DataFrame:
    """(year, mmdd, folder): of the event folders of one year and date the longest name, then the smallest. files: event (struct)."""
    rows = files.select("event.year", F.substring("event.event", 1, 5).alias("mmdd"), F.col("event.event").alias("name"))
    return rows.groupBy("year", "mmdd").agg(F.min_by("name", F.struct((-F.octet_length("name")).alias("l"), F.col("name").alias("n"))).alias("folder"))


def merge_plan(files: DataFrame, destination_root: str, purgatory: str) -> DataFrame:
    """source, target, action (keep or purge), group of libraries' files (tree, path, rel, content columns).

    Of each content group the keeper goes to the canonical folder of its year and date, the others to purgatory under
    their own relative path. Files above year/event/ are left out.
    """
    events = files.withColumn("event", split_event(F.col("rel"))).filter("event is not null")
    ranked = confirmed_groups(events)
    placed = ranked.withColumns({"year": F.col("event.year"), "mmdd": F.substring("event.event", 1, 5)}).join(canonical_folders(events), ["year", "mmdd"])
    keep = F.col("path") == F.col("keeper")
    target = F.when(keep, F.concat_ws("/", F.lit(destination_root), "year", "folder")).otherwise(F.concat_ws("/", F.lit(purgatory), parent(F.col("rel"))))
    moves = placed.select(F.col("path").alias("source"), target.alias("dir"), file_name(F.col("path")).alias("name"), F.when(keep, "keep").otherwise("purge").alias("action"), "group", F.col("keeper"), F.col("path"))
    moves = in_path_order(moves, "keeper").withColumn("seq", F.concat("seq", F.lit("\x02"), F.col("path")))
    return _named(moves).select("source", "target", "action", "group")


def consolidate_plan(files: DataFrame, folder: str, purgatory: str) -> DataFrame:
    """source, target, action (move or purge), keeper of one year folder's files: event folders of one MM-DD fold into the longest-named."""
    rel = relative_to(F.col("path"), F.lit(folder))
    inside = files.withColumn("event", F.get(parts(rel), F.lit(0))).filter(is_event_name(F.col("event")) & (F.size(parts(rel)) >= 2))
    inside = inside.withColumn("mmdd", F.substring("event", 1, 5))
    folders = inside.groupBy("mmdd").agg(F.count_distinct("event").alias("folders"), F.min_by("event", F.struct((-F.octet_length("event")).alias("l"), F.col("event").alias("n"))).alias("home")).filter("folders > 1")
    mine = inside.join(folders, "mmdd")
    # content is compared among the folders of one date only
    grouped = confirmed_groups(mine.withColumn("shallow", F.concat("shallow", F.lit("|"), "mmdd")))
    purge = F.col("path") != F.col("keeper")
    moves = grouped.filter(purge | (F.col("event") != F.col("home"))).select(
        F.col("path").alias("source"),
        F.when(purge, F.concat_ws("/", F.lit(purgatory), "event")).otherwise(F.concat_ws("/", F.lit(folder), "home")).alias("dir"),
        file_name(F.col("path")).alias("name"), F.when(purge, "purge").otherwise("move").alias("action"), F.col("home").alias("keeper"), F.col("path"),
    )
    there = grouped.filter("event = home").select(F.concat_ws("/", F.lit(folder), "home").alias("dir"), file_name(F.col("path")).alias("name"))
    return _named(in_path_order(moves), there).select("source", "target", "action", "keeper")


def _aimed(sources: DataFrame, root: str, template: str) -> DataFrame:
    """sources with dir and name of where their capture date puts them; the template is filled once a source."""
    goal = destination(F.col("path"), F.col("capture_date"), F.lit(root), F.lit(template))
    return sources.withColumn("goal", goal).withColumns({"dir": parent(F.col("goal")), "name": file_name(F.col("path"))})


def organize_rejects(sources: DataFrame, existing: DataFrame, root: str, template: str, aimed: DataFrame | None = None) -> DataFrame:
    """(source, existing): sources proven equal to the first file of their short hash in their own target folder.

    Only the folders that sources go to are looked at. sources: path, capture_date and content columns.
    """
    content = ("bytes_hash", "payload_hash", "pixel_hash", "video")
    aimed = (_aimed(sources, root, template) if aimed is None else aimed).filter("dir is not null")
    there = existing.withColumn("dir", parent(F.col("path")))
    first = there.groupBy("dir", "shallow").agg(F.min_by(F.struct("path", *content), parts(F.col("path"))).alias("a"))
    pairs = aimed.select("dir", "shallow", F.struct("path", *content).alias("b")).join(first, ["dir", "shallow"])
    return pairs.filter(verdict(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")) == "same").select(F.col("b.path").alias("source"), F.col("a.path").alias("existing"))


def organize_plan(sources: DataFrame, existing: DataFrame, root: str, template: str) -> DataFrame:
    """source, target, action (move, reject or undated) of every source."""
    aimed = stored(_aimed(sources, root, template).select("path", "shallow", "bytes_hash", "payload_hash", "pixel_hash", "video", "dir", "name"), "aimed")
    rejected = stored(organize_rejects(sources, existing, root, template, aimed), "rejected")
    moves = aimed.filter("dir is not null").select(F.col("path").alias("source"), "dir", "name").join(rejected, "source", "left_anti")
    there = existing.select(parent(F.col("path")).alias("dir"), file_name(F.col("path")).alias("name"))
    there = there.join(moves.select("dir").distinct(), "dir", "left_semi")
    moved = _named(in_path_order(moves, "source"), there).select("source", "target", F.lit("move").alias("action"))
    stay = rejected.select("source", F.col("existing").alias("target"), F.lit("reject").alias("action"))
    return moved.unionByName(stay).unionByName(aimed.filter("dir is null").select(F.col("path").alias("source"), F.lit(None).cast("string").alias("target"), F.lit("undated").alias("action")))


def event_plan(files: DataFrame, root: str, event: Column) -> DataFrame:
    """source, target of (path, capture_date): root/YYYY/MM-DD-event, or root/unknown."""
    moves = files.select(F.col("path").alias("source"), event_folder(F.col("capture_date"), F.lit(root), event).alias("dir"), file_name(F.col("path")).alias("name"))
    return _named(in_path_order(moves, "source")).select("source", "target")


def transfer_plan(dated: DataFrame, root: str, template: str, existing: DataFrame | None = None) -> DataFrame:
    """source, target of (path, capture_date) by template; undated files are left out."""
    goal = destination(F.col("path"), F.col("capture_date"), F.lit(root), F.lit(template))
    moves = dated.select(F.col("path").alias("source"), parent(goal).alias("dir"), file_name(F.col("path")).alias("name")).filter("dir is not null")
    return _named(in_path_order(moves, "source"), existing).select("source", "target")


def flat_plan(files: DataFrame, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """source, target: all files into one folder."""
    moves = files.select(F.col("path").alias("source"), F.lit(folder).alias("dir"), file_name(F.col("path")).alias("name"))
    return _named(in_path_order(moves, "source"), existing).select("source", "target")


def relocate_plan(files: DataFrame, root: str, new_root: str) -> DataFrame:
    """source, target: the same tree under another root."""
    return files.select(F.col("path").alias("source"), rebase(F.col("path"), F.lit(root), F.lit(new_root)).alias("target"))


def rehome_plan(verified: DataFrame, root: str, template: str) -> DataFrame:
    """source, target, days_off of the mismatches of operators/verify.py: where their capture date puts them."""
    wrong = stored(verified.filter("status = 'mismatch'").select("path", parent(F.col("path")).alias("folder"), "exif_date", "days_off"), "mismatches")
    # a folder's description is parsed once, its target found once a date, however many files
    folders = stored(wrong.select("folder").distinct().withColumn("about", description(F.element_at(parts(F.col("folder")), -1))), "folders")
    goal = destination(F.concat("folder", F.lit("/file")), F.col("exif_date"), F.lit(root), F.lit(template), F.col("about"))
    aims = stored(wrong.select("folder", "exif_date").distinct().join(folders, "folder").select("folder", "exif_date", parent(goal).alias("dir")), "aims").filter("dir is not null")
    moves = wrong.join(aims, ["folder", "exif_date"]).select(F.col("path").alias("source"), "dir", file_name(F.col("path")).alias("name"), "days_off")
    named = _named(in_path_order(moves, "source")).select("source", "target", "days_off")
    discard(wrong, folders)
    return named


def purgatory_plan(files: DataFrame, root: str, purgatory: str) -> DataFrame:
    """source, target under purgatory; a file outside root has no target: that is a failure."""
    rel = relative_to(F.col("path"), F.lit(root))
    return files.select(F.col("path").alias("source"), F.when(rel.isNotNull(), F.concat_ws("/", F.lit(purgatory), rel)).alias("target"))


def swap_plan(matches: DataFrame, a_root: str, purgatory: str) -> DataFrame:
    """step 1: a to purgatory; step 2: b to a's place, for matches whose b is better."""
    better = matches.filter("b_is_better")
    one = better.select(F.lit(1).alias("step"), F.col("a").alias("source"), rebase(F.col("a"), F.lit(a_root), F.lit(purgatory)).alias("target"))
    return one.unionByName(better.select(F.lit(2).alias("step"), F.col("b").alias("source"), F.concat_ws("/", parent(F.col("a")), file_name(F.col("b"))).alias("target")))


def decision_plan(rows: DataFrame, a_root: str, b_root: str, purgatory: str, template: str) -> DataFrame:
    """a, b, step, source, target of decided pairs (a, b, decision, a_size, b_size, b_date).

    keep_both: b goes to its dated place in a's tree (no target without a date: a failure); purgatory_both: both go;
    take_bigger: the smaller goes, and if that is a, b takes its place.
    """
    gone = lambda c, root: rebase(F.col(c), F.lit(root), F.lit(purgatory))
    step = lambda n, source, target: F.struct(F.lit(n).alias("step"), F.col(source).alias("source"), target.alias("target"))
    dated = destination(F.col("b"), F.col("b_date"), F.lit(a_root), F.lit(template))
    both = F.array(step(1, "a", gone("a", a_root)), step(2, "b", gone("b", b_root)))
    swap = F.array(step(1, "a", gone("a", a_root)), step(2, "b", F.concat_ws("/", parent(F.col("a")), file_name(F.col("b")))))
    moves = F.when(F.col("decision") == "keep_both", F.array(step(1, "b", dated))).when(F.col("decision") == "purgatory_both", both).when((F.col("decision") == "take_bigger") & (F.col("b_size") > F.col("a_size")), swap).when(F.col("decision") == "take_bigger", F.array(step(1, "b", gone("b", b_root))))
    return rows.select("a", "b", "decision", F.explode(moves).alias("m")).select("a", "b", "decision", "m.step", "m.source", "m.target")


def outcome_counts(outcome: DataFrame) -> DataFrame:
    """planned, moved, renamed, failed of carried-out moves (source, target, moved, error)."""
    renamed = F.col("moved") & (file_name(F.col("source")) != file_name(F.col("target")))
    return outcome.agg(F.count("*").alias("planned"), F.count_if(F.col("moved")).alias("moved"), F.count_if(renamed).alias("renamed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
