"""Changes as functions from tables to tables. What publishes them together is sources/snapshots.py.

An operation that must hit a row raises Conflict if it does not; checks run before anything is written.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a patch may set, states and their cycle.
PATCHABLE = ("title", "authors", "year", "venue", "doi", "keywords", "link", "summary", "notes", "category_id", "status", "starred", "pdf_path", "pdf_size", "fulltext")
BIBLIOGRAPHIC = ("title", "authors", "year", "venue", "doi", "keywords", "link", "summary", "category_id", "fulltext")
INPUT = ("title", "authors", "year", "venue", "doi", "keywords", "link", "summary", "notes", "category_id", "read", "starred")
STATES = ("unread", "reading", "read")


class Conflict(ValueError):
    """The rows are not in the state that the change was made for."""


def _hit(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise Conflict(what)


def _once(rows: DataFrame) -> None:
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("an id comes twice")


def state(x: Column) -> Column:
    """A state, unread for anything else."""
    return F.when(x.isin(*STATES), x).otherwise(STATES[0])


def next_state(x: Column) -> Column:
    """unread, reading, read and again unread."""
    cycle = F.create_map(*(F.lit(v) for a, b in zip(STATES, STATES[1:] + STATES[:1], strict=True) for v in (a, b)))
    return F.coalesce(F.try_element_at(cycle, x), F.lit(STATES[0]))


def inserted(papers: DataFrame, new: DataFrame, now: str, keep_ids: bool = False) -> DataFrame:
    """papers and new rows (without id, or with theirs): ids follow the greatest, texts are trimmed but for notes, missing ones are ''."""
    last = papers.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
    at = F.lit(now).cast(papers.schema["created_at"].dataType)
    have = set(new.columns)

    def value(name: str, kind: str):
        if name == "status":
            return state(F.col("status")) if "status" in have else F.lit(STATES[0])
        if name in ("created_at", "updated_at"):
            return at
        if name == "notes_updated_at":
            return F.when(F.coalesce(F.col("notes"), F.lit("")) != "", at) if "notes" in have else F.lit(None).cast(kind)
        if name not in have:
            return F.lit("" if kind == "string" else False if kind == "boolean" else 0 if name in ("year", "pdf_size") else None).cast(kind)
        c = F.coalesce(F.col(name), F.lit("")) if kind == "string" else F.col(name).cast(kind)
        return F.trim(c) if kind == "string" and name != "notes" else c

    # ids need only be new and distinct: partitions count for themselves, so nothing is gathered in one task
    rows = new.withColumn("_n", F.monotonically_increasing_id())
    cols = [(F.col("id") if keep_ids else F.col("_n") + last + 1).alias("id") if n == "id" else value(n, t).alias(n) for n, t in papers.dtypes]
    out = rows.select(*cols)
    if "read" in papers.columns:
        out = out.withColumn("read", F.col("status") == "read")
    return papers.unionByName(out)


def patched(papers: DataFrame, patch: DataFrame, now: str, expected_notes: bool = False) -> DataFrame:
    """papers with the columns of patch (id, set columns [, expected_notes]) written; null leaves a value as it is.

    Unknown columns are an error, an id that is not there a conflict, as are notes other than expected. The time of notes moves only
    if they change. category_id 0 clears the category; read follows status.
    """
    sets = [c for c in patch.columns if c not in ("id", "expected_notes")]
    if unknown := [c for c in sets if c not in PATCHABLE]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    _once(patch)
    missing = patch.join(papers, "id", "left_anti")
    if not missing.isEmpty():
        raise Conflict("no such row")
    if expected_notes and not patch.join(papers.select("id", F.col("notes").alias("_notes")), "id").where(~F.col("expected_notes").eqNullSafe(F.col("_notes"))).isEmpty():
        raise Conflict("the notes were changed meanwhile")
    p = patch.select(F.col("id"), *(F.col(c).alias(f"_{c}") for c in sets), F.lit(True).alias("_hit"))
    j = papers.join(p, "id", "left")
    at = F.lit(now).cast(papers.schema["updated_at"].dataType)
    out: dict[str, Column] = {}
    for c in sets:
        new = state(F.col("_status")) if c == "status" else F.nullif(F.col("_category_id"), F.lit(0)) if c == "category_id" else F.col(f"_{c}")
        out[c] = F.when(F.col(f"_{c}").isNotNull(), new).otherwise(F.col(c))
    if "notes" in sets:
        changed = F.col("_notes").isNotNull() & ~F.col("_notes").eqNullSafe(F.col("notes"))
        out["notes_updated_at"] = F.when(changed, at).otherwise(F.col("notes_updated_at"))
    if "status" in sets:
        out["read"] = F.when(F.col("_status").isNotNull(), state(F.col("_status")) == "read").otherwise(F.col("read"))
    out["updated_at"] = F.when(F.col("_hit"), at).otherwise(F.col("updated_at"))
    return j.select(*(out[c].alias(c) if c in out else F.col(c) for c in papers.columns))


def updated(papers: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """papers with whole rows of new (id, seen_notes_at, columns) written: texts are trimmed but for notes, missing columns and nulls are '' or 0, status falls to unread.

    Guard: the notes must be those that the writer saw, by their time (seen_notes_at) or by their text; else nothing is written and Conflict is raised,
    as for an id that is not there. An id that comes twice is an error. The time of notes moves only if they change; created_at and deleted_at stay.
    """
    _once(new)
    have = set(new.columns)
    own = papers.select("id", F.col("notes").alias("_notes"), F.col("notes_updated_at").alias("_notes_at"))
    seen = new.join(own, "id")
    if not new.join(papers, "id", "left_anti").isEmpty():
        raise Conflict("no such row")
    same_text = (F.coalesce(F.col("notes"), F.lit("")) if "notes" in have else F.lit("")) == F.coalesce("_notes", F.lit(""))
    same_time = F.col("seen_notes_at").cast(papers.schema["notes_updated_at"].dataType).eqNullSafe(F.col("_notes_at")) if "seen_notes_at" in have else F.lit(False)
    if not seen.where(~(same_text | same_time)).isEmpty():
        raise Conflict("the notes were changed meanwhile")
    kinds = dict(papers.dtypes)
    at = F.lit(now).cast(papers.schema["updated_at"].dataType)

    def value(c: str) -> Column:
        kind = kinds[c]
        if c not in have:
            return F.lit("" if kind == "string" else 0 if c in ("year", "pdf_size") else False if kind == "boolean" else None).cast(kind)
        text = F.coalesce(F.col(c), F.lit(""))
        return text if c == "notes" else F.trim(text) if kind == "string" else F.coalesce(F.col(c).cast(kind), F.lit(0 if c in ("year", "pdf_size") else False if kind == "boolean" else None).cast(kind))

    rows = new.select("id", *((state(F.col("status")) if "status" in have else F.lit(STATES[0])).alias("_status") if c == "status" else value(c).alias(f"_{c}") for c in PATCHABLE), F.lit(True).alias("_hit"))
    out = {c: F.col(f"_{c}") for c in PATCHABLE}
    out |= {"updated_at": at, "read": F.col("_status") == "read", "notes_updated_at": F.when(F.col("_notes").eqNullSafe(F.coalesce("notes", F.lit(""))), F.col("notes_updated_at")).otherwise(at)}
    j = papers.join(rows, "id", "left")
    return j.select(*(F.when(F.col("_hit"), out[c]).otherwise(F.col(c)).alias(c) if c in out else F.col(c) for c in papers.columns))


def metadata_updated(papers: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """papers with what was read from files or catalogues (id and any of BIBLIOGRAPHIC). Notes, status and stars are never touched, so a slow reader cannot undo them."""
    if unknown := [c for c in found.columns if c != "id" and c not in BIBLIOGRAPHIC]:
        raise ValueError(f"not bibliographic: {', '.join(unknown)}")
    return patched(papers, found, now)


def input_of(papers: DataFrame) -> DataFrame:
    """(id, the columns of a request, tags, collections): what a client would send to write the (hydrated) papers as they are; relations as lists of ids."""
    ids = [F.transform(c, lambda x: x["id"]).alias(c) for c in ("tags", "collections") if c in papers.columns]
    return papers.select("id", *INPUT, *ids)


def paper_of(requests: DataFrame) -> DataFrame:
    """(key, columns of a paper) from requests (key, body), a JSON object each: texts are trimmed but for notes, what is missing or of another type is '', 0, false or null.

    Names in the body are in camel case as clients send them. status counts only where it is given, else it follows read. A body that is no object gives blank columns.
    """
    kinds = {"year": "int", "categoryId": "bigint", "read": "boolean", "starred": "boolean"}
    body = F.try_parse_json("body")
    get = lambda k: F.try_variant_get(body, f"$.{k}", kinds.get(k, "string"))
    texts = ("title", "authors", "venue", "doi", "keywords", "link", "summary")
    read = F.coalesce(get("read"), F.lit(False))
    status = F.coalesce(get("status"), F.lit(""))
    return requests.select(
        "key", *(F.trim(F.coalesce(get(c), F.lit(""))).alias(c) for c in texts), F.coalesce(get("year"), F.lit(0)).alias("year"), F.coalesce(get("notes"), F.lit("")).alias("notes"), get("categoryId").alias("category_id"),
        F.when(status != "", state(status)).otherwise(F.when(read, "read").otherwise(STATES[0])).alias("status"), F.coalesce(get("starred"), F.lit(False)).alias("starred"),
    )


def saved(tables: Mapping[str, DataFrame], rows: DataFrame, tags: DataFrame, collections: DataFrame, now: str, create: bool = False) -> dict[str, DataFrame]:
    """The tables papers, paper_tags and paper_collections after rows are written with exactly these relations (id, tag_id) and (id, collection_id), as one unit.

    tables also holds tags and collections: a relation to what is not there is an error, and then, as after a conflict, nothing is changed. What comes back is to be published
    together (Snapshots.publish), which makes it atomic. create: rows are new and bring ids beyond the greatest, so that rows and relations agree.
    """
    out: dict[str, DataFrame] = {}
    if create:
        _once(rows)
        last = tables["papers"].agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
        if not rows.where(F.col("id") <= last).isEmpty():
            raise Conflict("an id that is taken")
        out["papers"] = inserted(tables["papers"], rows, now, keep_ids=True)
    else:
        out["papers"] = updated(tables["papers"], rows, now)
    for name, dims, key, new in (("paper_tags", "tags", "tag_id", tags), ("paper_collections", "collections", "collection_id", collections)):
        if not new.join(tables[dims], new[key] == tables[dims]["id"], "left_anti").isEmpty():
            raise ValueError(f"unknown {key}")
        if not new.join(rows, "id", "left_anti").isEmpty():
            raise ValueError("relations of a paper that is not written")
        written = rows.select(F.col("id").alias("paper_id"))
        kept = tables[name].join(written, "paper_id", "left_anti").select("paper_id", key)
        out[name] = kept.unionByName(new.select(F.col("id").alias("paper_id"), key).distinct())
    return out


def patch_of(request: Mapping[str, object]) -> dict[str, object]:
    """The columns that a request sets: only keys that are there; status goes before read, an empty category name clears the category."""
    out = {k: v for k, v in request.items() if k in PATCHABLE and v is not None}
    if "status" not in out and request.get("read") is not None:
        out["status"] = "read" if request["read"] else "unread"
    if request.get("category_name") == "":
        out["category_id"] = 0
    return out


def soft_deleted(papers: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """The papers of ids (id) in the trash. An id that is not live is a conflict."""
    if not ids.join(papers.where(F.col("deleted_at").isNull()), "id", "left_anti").isEmpty():
        raise Conflict("not a live paper")
    j = papers.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    at = F.lit(now).cast(papers.schema["deleted_at"].dataType)
    return j.select(*(F.when(F.col("_hit"), at).otherwise(F.col(c)).alias(c) if c == "deleted_at" else F.col(c) for c in papers.columns))


def restored(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """The papers of ids out of the trash. An id that is not in it is a conflict."""
    if not ids.join(papers.where(F.col("deleted_at").isNotNull()), "id", "left_anti").isEmpty():
        raise Conflict("not in the trash")
    j = papers.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return j.select(*(F.when(~F.coalesce(F.col("_hit"), F.lit(False)), F.col(c)).alias(c) if c == "deleted_at" else F.col(c) for c in papers.columns))


def purged(papers: DataFrame, children: Mapping[str, DataFrame], ids: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(papers left, children left by name, files to delete) after trashed papers, all or those of ids, are gone with what hangs on them."""
    gone = papers.where(F.col("deleted_at").isNotNull())
    if ids is not None:
        if not ids.join(gone, "id", "left_anti").isEmpty():
            raise Conflict("not in the trash")
        gone = gone.join(ids, "id", "left_semi")
    key = gone.select("id")
    left = {n: c.join(key, c["paper_id"] == key["id"], "left_anti") for n, c in children.items()}
    return papers.join(key, "id", "left_anti"), left, gone.where(F.col("pdf_path") != "").select("pdf_path")


def related_set(links: DataFrame, paper_id: int, key: str, ids: list[int], dims: DataFrame | None = None) -> DataFrame:
    """links with exactly these ids for a paper. With dims, an id that is not there is an error."""
    new = links.sparkSession.createDataFrame([(paper_id, i) for i in dict.fromkeys(ids)], f"paper_id long, {key} long")
    if dims is not None and not new.join(dims, new[key] == dims["id"], "left_anti").isEmpty():
        raise ValueError(f"unknown {key}")
    return links.where(F.col("paper_id") != paper_id).unionByName(new)


def related_added(links: DataFrame, new: DataFrame) -> DataFrame:
    """links and new pairs, each pair once."""
    return links.unionByName(new.select(*links.columns)).distinct()


def related_removed(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select(*links.columns), links.columns, "left_anti")


def ensured_with_counts(dims: DataFrame, names: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(id, name, paper_count) of the names after those that are new were added: 0 for these, else the papers that have them."""
    asked = names.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    n = links.dropDuplicates(["paper_id", key]).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    return ensured(dims, names).join(asked, "name", "left_semi").join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("paper_count"))


def ensured(dims: DataFrame, names: DataFrame) -> DataFrame:
    """dims (id, name) and the names (name) that are new, trimmed and not blank."""
    new = names.select(F.trim("name").alias("name")).where("name <> ''").distinct().join(dims, "name", "left_anti")
    last = dims.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
    rows = new.select((F.monotonically_increasing_id() + last + 1).alias("id"), "name")
    return dims.unionByName(rows, allowMissingColumns=True)


def renamed(dims: DataFrame, id: int, name: str) -> DataFrame:
    _hit(dims.where(F.col("id") == id), "no such row")
    if not name.strip():
        raise ValueError("a name is needed")
    if not dims.where((F.col("name") == name.strip()) & (F.col("id") != id)).isEmpty():
        raise Conflict("the name is taken")
    return dims.withColumn("name", F.when(F.col("id") == id, F.lit(name.strip())).otherwise(F.col("name")))


def category_deleted(categories: DataFrame, papers: DataFrame, id: int) -> tuple[DataFrame, DataFrame]:
    """(categories, papers): its papers have none."""
    _hit(categories.where(F.col("id") == id), "no such row")
    return categories.where(F.col("id") != id), papers.withColumn("category_id", F.when(~F.col("category_id").eqNullSafe(F.lit(id)), F.col("category_id")))


def dimension_deleted(dims: DataFrame, links: DataFrame, key: str, id: int) -> tuple[DataFrame, DataFrame]:
    """(dims, links) without a tag or collection and what refers to it."""
    _hit(dims.where(F.col("id") == id), "no such row")
    return dims.where(F.col("id") != id), links.where(F.col(key) != id)


def upserted(settings: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value, updated_at) with the latest value of each key."""
    return settings.unionByName(new).groupBy("key").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))


def annotations_added(annotations: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """annotations and new rows; a highlight needs valid rectangles, a note a page and a place on it."""
    from folialis.functions import rects as R

    on_page = (F.col("page") >= 1) & F.col("x").between(0, 1) & F.col("y").between(0, 1)
    rows = new.withColumn("kind", R.kind(F.col("kind"))).withColumn("color", R.colour(F.col("color")))
    good = F.when(F.col("kind") == "note", on_page).otherwise(R.valid(F.col("rects")))
    if not rows.where(~F.coalesce(good, F.lit(False))).isEmpty():
        raise ValueError("rectangles or a place that no page has")
    last = annotations.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
    rows = rows.withColumn("id", F.monotonically_increasing_id() + last + 1).withColumn("created_at", F.lit(now).cast(annotations.schema["created_at"].dataType))
    return annotations.unionByName(rows.select(*annotations.columns))


def annotation_patched(annotations: DataFrame, id: int, note: str | None = None, color: str | None = None, x: float | None = None, y: float | None = None) -> DataFrame:
    """One annotation changed; x and y go together."""
    from folialis.functions import rects as R

    _hit(annotations.where(F.col("id") == id), "no such annotation")
    if (x is None) != (y is None) or x is not None and not (0 <= x <= 1 and 0 <= y <= 1):
        raise ValueError("x and y go together and lie on the page")
    new = {"note": note, "x": x, "y": y}
    out = annotations
    for c, v in new.items():
        if v is not None:
            out = out.withColumn(c, F.when(F.col("id") == id, F.lit(v)).otherwise(F.col(c)))
    if color is not None:
        out = out.withColumn("color", F.when(F.col("id") == id, R.colour(F.lit(color))).otherwise(F.col("color")))
    return out


def annotation_deleted(annotations: DataFrame, id: int) -> DataFrame:
    _hit(annotations.where(F.col("id") == id), "no such annotation")
    return annotations.where(F.col("id") != id)
