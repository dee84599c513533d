"""A question bank's upkeep: saving by natural key, exam sheets, packages, portable references, attempts, crawls."""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions.text import SPACE, subject_code
from papyra.operators.ordered import numbered
from papyra.sources.scratch import stored


def saved(base: DataFrame, incoming: DataFrame, keys: list[str], key: str = "id", keep: list[str] = ()) -> DataFrame:
    """Base with incoming rows replaced or added by natural key; new rows get dense ids behind the largest one, in key order.

    The last of repeated incoming keys counts (order: their column seq). Columns in keep hold the old value where the new one is null. Columns are base's.
    A key with a null part is like no other: base's rows of it stay, and incoming ones of it are one new row.
    """
    rest = [c for c in base.columns if c not in (key, *keys)]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("papyra_new"))
    both = base.join(last, keys, "full")
    value = lambda c: F.when(F.col("papyra_new").isNull(), F.col(c)).otherwise(F.coalesce(F.col("papyra_new")[c], F.col(c)) if c in keep else F.col("papyra_new")[c])
    merged = stored(both.select(key, *keys, *[value(c).alias(c) for c in rest]))
    top = base.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]  # one number
    known, new = merged.where(F.col(key).isNotNull()), merged.where(F.col(key).isNull())
    if not new.limit(1).count():
        return known.select(*base.columns)
    named = numbered(new.drop(key), keys, key, top + 1)
    return known.select(*base.columns).unionByName(named.select(*base.columns))


def registered(dims: DataFrame, names: DataFrame, name: str, code: str) -> DataFrame:
    """Dims (code, name) with a made code for each name that they lack."""
    new = names.select(name).where(F.col(name).isNotNull()).distinct().join(dims.select(name), name, "left_anti")
    return dims.select(code, name).unionByName(new.select(subject_code(F.col(name)).alias(code), name))


def exam_sheet(questions: DataFrame, exam: str, section: str, order: list[str], group: str, passage: str) -> DataFrame:
    """Each exam's questions numbered from 1 across its sections in order, and the passage where it is printed: before the first question of each run of a group in a section."""
    w = Window.partitionBy(exam).orderBy(section, *order)
    numbered = questions.withColumn("display_number", F.row_number().over(w).cast("long"))
    before = F.lag(F.struct(section, group)).over(w)
    first = F.col(group).isNotNull() & ~before.eqNullSafe(F.struct(section, group))
    return numbered.withColumn("printed", F.when(first, F.col(passage)))


def package(rows: DataFrame, files: DataFrame, reference: str, path: str, digest: str) -> dict[str, DataFrame]:
    """The files that rows refer to, each content once under its digest, the mapping of references to them, and the references that no file has."""
    wanted = rows.where(F.coalesce(F.col(reference), F.lit("")) != "").select(F.col(reference).alias(path)).distinct()
    found = wanted.join(files.select(path, digest), path)
    named = found.select(path, F.concat(F.substring(digest, 1, 20), F.lit("."), F.lower(F.element_at(F.split(path, r"\."), -1))).alias("stored_as"), digest)
    return {"mapping": named.select(path, "stored_as"), "contents": named.groupBy(digest).agg(F.min(path).alias(path), F.min("stored_as").alias("stored_as")), "missing": wanted.join(files.select(path), path, "left_anti")}


def portable(rows: DataFrame, column: str, mapping: DataFrame, path: str, stored_as: str) -> DataFrame:
    """Rows with mapped references; those that have no mapping stay. References inside a JSON payload's image_path values are read by portable_payloads()."""
    names = mapping.select(F.col(path).alias(column), F.col(stored_as).alias("papyra_ref"))
    return rows.join(names, column, "left").withColumn(column, F.coalesce("papyra_ref", column)).drop("papyra_ref").select(*rows.columns)


def portable_payloads(rows: DataFrame, key: str, payload: str, mapping: DataFrame, path: str, stored_as: str) -> DataFrame:
    """Rows whose payloads' image_path values are mapped, however the JSON is spaced; a payload's own text stays otherwise.

    Values are exploded as JSON strings, joined by path, and put back by place, behind a control sign that JSON has no other use for.
    """
    pattern = r'("image_path"\s*:\s*")((?:[^"\\]++|\\.)*+)'
    decoded = F.get(F.from_json(F.concat(F.lit('["'), "papyra_raw", F.lit('"]')), "array<string>"), F.lit(0))
    encoded = F.regexp_extract(F.to_json(F.array("to")), r'(?s)^\["(.*)"\]$', 1)
    refs = rows.select(key, F.posexplode(F.regexp_extract_all(payload, F.lit(pattern), F.lit(2))).alias("place", "papyra_raw")).withColumn(path, decoded)
    refs = refs.join(mapping.select(path, F.col(stored_as).alias("to")), path, "left").withColumn("to", F.when(F.col("to").isNotNull(), encoded).otherwise(F.col("papyra_raw")))
    per = refs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "to"))), lambda x: x["to"]).alias("papyra_to"))
    pieces = F.split(F.regexp_replace(payload, pattern, "$1\x01"), "\x01", -1)
    rebuilt = F.array_join(F.zip_with(pieces, F.concat("papyra_to", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return rows.join(per, key, "left").withColumn(payload, F.when(F.size(pieces) == F.size("papyra_to") + 1, rebuilt).otherwise(F.col(payload))).drop("papyra_to").select(*rows.columns)


def attempts(answers: DataFrame, key: DataFrame, attempt: str, question: str, subject: str, all_correct: int = -1) -> DataFrame:
    """Per attempt and subject total, answered, correct and score of one place. A question all of whose choices are right counts if it was answered."""
    both = answers.join(key.select(question, subject, "right"), question)
    good = F.col("given").isNotNull() & ((F.col("given") == F.col("right")) | (F.col("right") == all_correct))
    per = both.groupBy(attempt, subject).agg(F.count("*").alias("total"), F.count("given").alias("answered"), F.count_if(good).alias("correct"))
    return per.withColumn("score", F.round(F.col("correct") * 100.0 / F.col("total"), 1))


def snapshot(rows: DataFrame, key: str, columns: list[str], name: str = "snapshot") -> DataFrame:
    """(key, JSON of the columns)."""
    return rows.select(key, F.to_json(F.struct(*columns)).alias(name))


def crawled(start: DataFrame, links: DataFrame, page: str, target: str, most_pages: int, allowed=None) -> DataFrame:
    """(page, depth) in breadth-first order from the start pages over links (page, target), `most_pages` at most, a page once.

    A loop over depths, each a join of the newest pages with the links; it ends where a depth adds no page. The limit is the crawl's feature: within a depth pages come by name.
    """
    newest = stored(start.select(F.col(page), F.lit(0).alias("depth")).distinct().orderBy(page).limit(most_pages))
    seen, depth, count = newest, 0, newest.count()
    while count < most_pages:
        depth += 1
        found = newest.join(links.select(page, target), page).select(F.col(target).alias(page)).distinct()
        found = found if allowed is None else found.where(allowed(F.col(page)))
        fresh = stored(found.join(seen.select(page), page, "left_anti").select(page, F.lit(depth).alias("depth")).orderBy(page).limit(most_pages - count))
        n = fresh.count()
        if not n:
            break
        seen, newest, count = seen.unionByName(fresh), fresh, count + n  # each depth is stored once
    return seen


def paginated(links: DataFrame, page: str, href: str, pattern: str) -> DataFrame:
    """(page, number, href) of pagination links, each number once, with the last of its links (order: the column place; links of one place by href)."""
    number = F.regexp_extract(href, pattern, 1).try_cast("int")
    return links.withColumn("number", number).where("number >= 1").groupBy(page, "number").agg(F.max_by(href, F.struct("place", href)).alias(href))


def manifest_with(path: str, mounts: list[dict]) -> None:
    """A manifest's mounts written anew, whole or not at all; repeated ids are refused."""
    if len({m["id"] for m in mounts}) != len(mounts):
        raise ValueError("the manifest repeats a mount id")
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as out:
        json.dump({"version": 1, "mounts": mounts}, out, ensure_ascii=False, indent=2)
    os.replace(part, path)


def renamed_mount(path: str, mount: str, label: str) -> None:
    """A mount's label changed in its manifest."""
    with open(path, encoding="utf-8") as text:
        mounts = json.load(text)["mounts"]
    if mount not in [m["id"] for m in mounts]:
        raise ValueError(f"no mount {mount}")
    manifest_with(path, [m | {"label": label} if m["id"] == mount else m for m in mounts])


def attached(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> None:
    """Tables as temporary views name_table, for SQL across several banks."""
    for table, df in tables.items():
        df.createOrReplaceTempView(f"{name}_{table}")


def bundled_pages(files: DataFrame) -> DataFrame:
    """(path, page, text, images) of ZIP bundles (path, content): numbered .txt members are pages, in the order of their numbers; a manifest.json may name images by page.

    Bundles that can't be read give one row with page null. Members pass through Python, one bundle at a time.
    """

    def run(batches):
        import io
        import re
        import zipfile

        import pandas as pd

        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                        names = bundle.namelist()
                        manifest = json.loads(bundle.read("manifest.json")) if "manifest.json" in names else {}
                        numbered = sorted((int(m.group(1)), n) for n in names if (m := re.search(r"(\d+)\.txt$", n)))
                        images = {str(p.get("page_number", p.get("page"))): bool(p.get("image") or p.get("has_visual_content")) for p in manifest.get("pages", [])}
                        rows += [(path, k, bundle.read(n).decode("utf-8", "replace"), images.get(str(k), False)) for k, n in numbered]
                except (zipfile.BadZipFile, ValueError, KeyError):
                    rows.append((path, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "images"]).astype({"page": "Int64", "images": "boolean"})

    return files.select("path", "content").mapInPandas(run, "path string, page long, text string, images boolean")


def exact_sources(registry: DataFrame, confidence: str = "confidence") -> DataFrame:
    """The repairs of a registry that an exact source backs."""
    return registry.where(F.col(confidence) == "exact_source")


def repaired_mounts(mounts: dict[str, tuple[DataFrame, DataFrame]], key: str, column: str) -> dict[str, DataFrame]:
    """Each mount's rows with its repairs (key, before, after) applied, or an error that names the first mount where one doesn't fit, before any is returned."""
    from papyra.operators.relational import swapped

    out = {}
    for name, (rows, repairs) in mounts.items():
        made = stored(swapped(rows, repairs, key, column))
        if repairs.limit(1).count() and not made.where("applied").limit(1).count():
            raise ValueError(f"{name}: a repair does not fit")
        out[name] = made.drop("applied")
    return out


def all_mounts(mounts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all mounts with their mount, for nesting by (mount, id)."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("mount", F.lit(m)) for m, df in sorted(mounts.items())])


def tag_line(tags: str) -> F.Column:
    """Tags split at commas, trimmed, each once in order, joined by commas."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(tags), F.lit("")), ","), lambda t: F.regexp_replace(t, f"^[{SPACE}]+|[{SPACE}]+$", "")), lambda t: t != "")
    return F.array_join(F.array_distinct(parts), ",")


def without_fragments(questions: DataFrame, groups: DataFrame, exam: str) -> tuple[DataFrame, DataFrame]:
    """questions (exam, number, text, choices) that have a text or a choice, and groups (exam, group, children) with their children among these; childless groups go."""
    kept = questions.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.coalesce(F.size("choices"), F.lit(0)) > 0))
    members = groups.select(exam, "group", F.posexplode("children").alias("place", "number")).join(kept.select(exam, "number").distinct(), [exam, "number"], "left_semi")
    children = members.groupBy(exam, "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "number"))), lambda x: x["number"]).alias("children"))
    return kept, groups.drop("children").join(children, [exam, "group"])


def migrated(rows: DataFrame, key: str, columns: list[str], change) -> tuple[DataFrame, DataFrame]:
    """Rows as change(rows) makes them, and (key, column) of the values that differ where they must not: all columns but those named."""
    after = change(rows)
    fixed = [c for c in rows.columns if c not in (key, *columns)]
    both = rows.select(key, F.struct(*fixed).alias("before"), F.lit(True).alias("was")).join(after.select(key, F.struct(*fixed).alias("after"), F.lit(True).alias("is")), key, "full")
    lost = F.when(F.col("was").isNull() | F.col("is").isNull(), F.array(F.lit("row")))
    differ = F.array_compact(F.array(*[F.when(~F.col("before")[c].eqNullSafe(F.col("after")[c]), F.lit(c)) for c in fixed]))
    return after, both.select(key, F.explode(F.coalesce(lost, differ)).alias("column"))


def boards(links: DataFrame, page: str, pattern: str) -> DataFrame:
    """(board, document, text) of document links, the first link of each document in page order."""
    found = links.withColumn("board", F.regexp_extract("href", pattern, 1)).withColumn("document", F.regexp_extract("href", pattern, 2)).where("document <> ''")
    return found.groupBy("board", "document").agg(F.min(F.struct(page, "place", "text")).alias("f")).select("board", "document", "f.text")


def route(mounts: list[dict], mount: str | None = None, domain: str | None = None) -> str:
    """The mount that a change goes to: a known row's own; for a new one user_workspace, else the domain's "user", else the sole writable one; an error if none fits.

    read_only keeps new rows out; a known row's mount takes its change whatever the flag, as the flag is one of reading.
    """
    if mount is not None:
        if mount not in [m["id"] for m in mounts]:
            raise ValueError(f"no mount {mount}")
        return mount
    writable = [m for m in mounts if not m.get("read_only")]
    for wanted in (lambda m: m["id"] == "user_workspace", lambda m: m.get("domain") == (domain or "user")):
        found = [m["id"] for m in writable if wanted(m)]
        if found:
            return found[0]
    if len(writable) != 1:
        raise ValueError("no mount takes new rows")
    return writable[0]["id"]
