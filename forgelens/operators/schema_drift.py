"""Reading records whose schema drifts from file to file, and reporting each change.

A catalogue of column lifespans is built from what every file holds: fields are exploded per producer,
file and type, and ``lag`` over the producer's files cuts each field's appearances into islands. Where
an island starts a field was added, where it ends it was removed, where the type differs from the file
before it changed. An end and a start at the same file are a rename when the same values go on under
the new name: records are matched by their key, and their agreement must exceed what the values' own
frequencies would give by chance, so a field of two values needs the same proof as one of a thousand. An
alias table, a parameter, maps the names met to canonical ones, with the cast of each; for renames it only
speaks where values cannot (no record in both files, or a value that never differs).

One pass counts types per file; values are read in a second pass, and only of the fields that end or start
where both happens.

Defined cases: unreadable and null payloads, and payloads that are no object, give no fields; files
without a readable record are no file; records of one text in a file count once; nulls have no type, a field with
nulls only is there but without a type, which is no change of type; of types equally common the first
in alphabetical order is taken; empty tables give no row.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.session import cut

# canonical name: (cast, other names of the field)
ALIASES: dict[str, tuple[str, tuple[str, ...]]] = {
    "full_name": ("string", ()),
    "stars": ("long", ("stargazers", "star_count", "stargazers_count")),
    "contributor_count": ("long", ("contributors", "n_contributors")),
    "topics": ("list", ("tags", "keywords")),
    "description": ("string", ("desc", "tagline", "about", "summary")),
    "default_branch": ("string", ("branch", "head_branch", "main_branch")),
    "created_at": ("timestamp", ("first_seen", "created", "Created_At", "creation_date", "createdAt")),
    "has_github_actions": ("boolean", ("ci_actions", "gh_actions", "uses_github_actions", "githubActions")),
    "open_issues": ("long", ()),
    "archived": ("boolean", ()),
    "license": ("string", ()),
    "fork_of": ("string", ()),
    "size_kb": ("long", ()),
    "homepage": ("string", ()),
    "has_pre_commit": ("boolean", ()),
    "has_dockerfile": ("boolean", ()),
    "watchers": ("long", ()),
    "pushed_at": ("timestamp", ()),
}
KEY_FIELD = "full_name"
SAME_SHARE = 0.8  # share of equal values of the same key that makes a rename
BEYOND_CHANCE = 0.6  # of the agreement that chance leaves open (kappa), so that fields of few values can be told apart
LEAST_PROOF = 4.0  # disagreements that chance alone would have made, at least

_TRUE, _FALSE = frozenset(("true", "yes", "y", "on")), frozenset(("false", "no", "n", "off"))
_ISO = re.compile(r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)? ?(?:Z|UTC|[+-]\d{2}:?\d{2})?$")
_DMY = re.compile(r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?$")
_NUMBER = re.compile(r"^[+-]?(?:\d{1,3}(?:[,' ]\d{3})+|\d+)(?:\.\d+)?$")


def kind_of(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "decimal"
    if isinstance(v, str):
        return "string"
    return "list" if isinstance(v, list) else "object"


def as_time(v: object) -> dt.datetime | None:
    """ISO and day-first texts, and epoch seconds or milliseconds."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        s = v / 1000 if abs(v) > 1e11 else v
        return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(s)) if 0 <= s < 4e9 else None
    s = str(v).strip()
    m = _ISO.match(s)
    parts = m.groups() if m else None
    if not m:
        m = _DMY.match(s)
        parts = (m[3], m[2], m[1], m[4], m[5], m[6]) if m else None
    if not parts:
        return as_time(int(s)) if s.isdigit() and len(s) in (10, 13) else None
    try:
        return dt.datetime(*(int(x or 0) for x in parts))
    except ValueError:
        return None


def comparable(v: object) -> str:
    """One notation for a value, whatever its type: used only to see whether values go on."""
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, dict):
        inner = [x for x in v.values() if isinstance(x, (str, int, float)) and x is not None]
        return comparable(v.get("text", v.get("value", v.get("name", inner[0] if inner else ""))))
    if isinstance(v, list):
        return comparable(v[0]) if len(v) == 1 else ",".join(sorted(comparable(x) for x in v if x is not None))
    if isinstance(v, (int, float)):
        if 1e9 < abs(v) < 4e9 or 1e12 < abs(v) < 4e12:
            return as_time(v).strftime("%Y-%m-%d") if v > 0 else str(v)
        return str(int(v)) if float(v).is_integer() else repr(float(v))
    s = str(v).strip()
    low = s.lower()
    if low in _TRUE or low in _FALSE:
        return "1" if low in _TRUE else "0"
    if _NUMBER.match(s):
        x = float(re.sub(r"[,' ]", "", s))
        return comparable(int(x) if x.is_integer() else x)
    t = as_time(s)
    if t:
        return t.strftime("%Y-%m-%d")
    return ",".join(sorted(x.strip() for x in low.split(","))) if "," in low else low


Aliases = dict[str, tuple[str, tuple[str, ...]]]


def _record(payload: str | None) -> dict | None:
    try:
        record = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records by file, field and type, summed per batch; a row without field stands for the records themselves."""
    for pdf in batches:
        n: Counter = Counter()
        for stream, file, no, payload in zip(pdf["stream_name"], pdf["batch_file"], pdf["batch_no"], pdf["payload"]):
            record = _record(payload)
            if record is not None:
                where = (stream, file, None if pd.isna(no) else int(no))
                n[*where, None, None] += 1
                n.update((*where, k, kind_of(v)) for k, v in record.items())
        yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["stream_name", "batch_file", "batch_no", "field", "kind", "n"]).astype({"batch_no": "Int64"})


def records(snapshots: DataFrame) -> DataFrame:
    """(stream_name, batch_file, batch_no, payload), each text once a file."""
    chosen = snapshots.select("stream_name", "batch_file", F.col("batch_no").cast("long").alias("batch_no"), "payload").where("payload is not null")
    return chosen.dropDuplicates(["stream_name", "batch_file", "payload"])


def observed(snapshots: DataFrame) -> DataFrame:
    """(stream_name, batch_file, batch_no, field, kind, n): records of every file by field and type.

    A row without field counts the records, so that files holding empty objects are files.
    """
    return _observed(records(snapshots))


def _observed(once: DataFrame) -> DataFrame:
    parts = once.mapInPandas(_counted, "stream_name string, batch_file string, batch_no long, field string, kind string, n long")
    return parts.groupBy("stream_name", "batch_file", "field", "kind").agg(F.min("batch_no").alias("batch_no"), F.sum("n").alias("n"))


def catalogue(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of each producer in order, and the fields of each file with their type.

    files: (stream_name, batch_file, seq, last); fields: (stream_name, batch_file, seq, field, kind).
    """
    per_file = seen.groupBy("stream_name", "batch_file").agg(F.min("batch_no").alias("no"))
    order = Window.partitionBy("stream_name").orderBy("no", "batch_file")
    files = per_file.select("stream_name", "batch_file", F.row_number().over(order).alias("seq"), F.count("*").over(Window.partitionBy("stream_name")).alias("last"))
    major = seen.where("field is not null").groupBy("stream_name", "batch_file", "field").agg(
        F.min(F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("kind").alias("kind"))))["kind"].alias("kind")
    )
    return files, major.join(files, ["stream_name", "batch_file"]).select("stream_name", "batch_file", "seq", "last", "field", "kind")


def lifespans(fields: DataFrame) -> DataFrame:
    """(stream_name, field, kind, first_seq, last_seq, files, last): islands of files in a row that hold a field with one type."""
    by = Window.partitionBy("stream_name", "field").orderBy("seq")
    starts = (F.lag("seq").over(by).isNull() | (F.col("seq") - F.lag("seq").over(by) > 1) | ~F.col("kind").eqNullSafe(F.lag("kind").over(by))).cast("int")
    marked = fields.withColumn("start", starts).withColumn("island", F.sum("start").over(by))
    return marked.groupBy("stream_name", "field", "island").agg(F.first("kind").alias("kind"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("files"), F.first("last").alias("last")).drop("island")


def _goes_on(old: Column, new: Column) -> Column:
    """Whether two sets of values share one, or hold numbers of 10 or more that differ by 1 or 2 percent at most: counts grow."""
    def near(a: Column, b: Column) -> Column:
        x, y = a.try_cast("double"), b.try_cast("double")
        most = F.greatest(F.abs(x), F.abs(y))
        return F.coalesce((most >= 10) & (F.abs(x - y) <= F.greatest(F.lit(1.0), 0.02 * most)), F.lit(False))

    return F.arrays_overlap(old, new) | F.exists(old, lambda a: F.exists(new, lambda b: near(a, b)))


def _canonical(name: Column, aliases: Aliases) -> Column:
    pairs = [x for canon, (_, names) in aliases.items() for n in (canon, *names) for x in (F.lit(n), F.lit(canon))]
    return F.create_map(*pairs)[name] if pairs else F.lit(None).cast("string")


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The values that records have in the wanted fields of their file."""
    for pdf in batches:
        rows = []
        for stream, payload, wanted in zip(pdf["stream_name"], pdf["payload"], pdf["wanted"]):
            record = _record(payload) or {}
            key = record.get(KEY_FIELD)
            if key is None:
                continue
            key = str(key).strip().lower()
            for w in wanted:
                v = record.get(w["field"])
                if v is not None:
                    c = comparable(v)
                    rows.append((stream, int(w["at"]), bool(w["is_new"]), w["field"], key, c if len(c) <= 40 else hashlib.md5(c.encode("utf-8", "surrogatepass")).hexdigest()))
        yield pd.DataFrame(rows, columns=["stream_name", "seq", "is_new", "field", "key", "value"])


def _agreement(once: DataFrame, files: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(stream_name, seq, old_name, new_name, share, chance, compared) of fields that end and start at a file, over records of one key in both files."""
    place = lambda df, name, at, is_new: df.select("stream_name", at.cast("int").alias("f"), F.col("seq").alias("at"), F.lit(is_new).alias("is_new"), F.col(name).alias("field"))
    wanted = place(old, "old_name", F.col("seq") - 1, False).union(place(new, "new_name", F.col("seq"), True))
    by_file = wanted.groupBy("stream_name", "f").agg(F.collect_list(F.struct("at", "is_new", "field")).alias("wanted"))  # at most the fields of a file
    by_file = by_file.join(files.select("stream_name", "batch_file", F.col("seq").alias("f")), ["stream_name", "f"]).drop("f")
    placed = once.join(by_file, ["stream_name", "batch_file"]).select("stream_name", "payload", "wanted").mapInPandas(_placed, "stream_name string, seq int, is_new boolean, field string, key string, value string")
    values = placed.groupBy("stream_name", "seq", "is_new", "field", "key").agg(F.collect_set("value").alias("values"))
    a = values.where("not is_new").select("stream_name", "seq", "key", F.col("field").alias("old_name"), F.col("values").alias("v_old"))
    b = values.where("is_new").select("stream_name", "seq", "key", F.col("field").alias("new_name"), F.col("values").alias("v_new"))
    pair = ["stream_name", "seq", "old_name", "new_name"]
    met = a.join(b, ["stream_name", "seq", "key"]).groupBy(*pair, "v_old", "v_new").agg(F.count("*").alias("n"))
    olds, news, every = Window.partitionBy(*pair, "v_old"), Window.partitionBy(*pair, "v_new"), Window.partitionBy(*pair)
    freq = met.select(*pair, "n", _goes_on(F.col("v_old"), F.col("v_new")).alias("same"), F.sum("n").over(olds).alias("n_old"), F.sum("n").over(news).alias("n_new"), F.sum("n").over(every).alias("all_"))
    return freq.groupBy(*pair).agg(
        (F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.sum("n").alias("compared"),
        F.sum(F.when(F.col("same"), F.col("n_old") / F.col("all_") * F.col("n_new") / F.col("all_")).otherwise(0.0)).alias("chance"),
    )


def changes(snapshots: DataFrame, aliases: Aliases = ALIASES) -> DataFrame:
    """(stream_name, batch_file, field_name, change_kind, old_name, old_kind, new_kind) of every change between files."""
    once = cut(records(snapshots))
    files, fields = catalogue(cut(_observed(once)))
    files, fields = cut(files), cut(fields)
    by = Window.partitionBy("stream_name", "field").orderBy("seq")
    lagged = fields.select("stream_name", "seq", "last", "field", "kind", F.lag("seq").over(by).alias("before"), F.lead("seq").over(by).alias("after"), F.lag("kind").over(by).alias("old_kind"))
    lagged = cut(lagged)
    added = lagged.where("seq > 1 and (before is null or seq - before > 1)").select("stream_name", "seq", "field", "kind")
    removed = lagged.where("seq < last and (after is null or after - seq > 1)").select("stream_name", (F.col("seq") + 1).alias("seq"), "field", "kind")
    typed = lagged.where("before = seq - 1 and kind <> old_kind").select("stream_name", "seq", F.col("field").alias("field_name"), F.lit("type_changed").alias("change_kind"), F.lit(None).cast("string").alias("old_name"), "old_kind", F.col("kind").alias("new_kind"))

    both = removed.select("stream_name", "seq").distinct().join(added.select("stream_name", "seq").distinct(), ["stream_name", "seq"], "left_semi")
    old = removed.join(both, ["stream_name", "seq"], "left_semi").select("stream_name", "seq", F.col("field").alias("old_name"), F.col("kind").alias("old_kind"))
    new = added.join(both, ["stream_name", "seq"], "left_semi").select("stream_name", "seq", F.col("field").alias("new_name"), F.col("kind").alias("new_kind"))
    options = old.join(new, ["stream_name", "seq"]).join(_agreement(once, files, old, new), ["stream_name", "seq", "old_name", "new_name"], "left")
    alias = _canonical(F.col("old_name"), aliases).eqNullSafe(_canonical(F.col("new_name"), aliases)) & _canonical(F.col("new_name"), aliases).isNotNull()
    open_ = 1 - F.col("chance")
    proven = (F.col("share") >= SAME_SHARE) & (F.col("share") - F.col("chance") >= BEYOND_CHANCE * open_) & (F.col("compared") * open_ >= LEAST_PROOF)
    unproven = F.col("share").isNull() | (F.col("compared") * open_ < LEAST_PROOF) & (F.col("share") >= SAME_SHARE)
    options = options.withColumn("alias", alias).withColumn("kappa", F.when(open_ > 0, (F.col("share") - F.col("chance")) / open_)).where(proven | (F.col("alias") & (unproven | (F.col("share") >= SAME_SHARE / 2))))
    rank = [F.col("alias").desc(), F.coalesce("share", F.lit(0.0)).desc(), F.coalesce("kappa", F.lit(0.0)).desc(), F.coalesce("compared", F.lit(0)).desc()]
    best = options.withColumn("ro", F.row_number().over(Window.partitionBy("stream_name", "seq", "old_name").orderBy(*rank, "new_name"))).withColumn("rn", F.row_number().over(Window.partitionBy("stream_name", "seq", "new_name").orderBy(*rank, "old_name"))).where("ro = 1 and rn = 1")
    renamed = cut(best.select("stream_name", "seq", F.col("new_name").alias("field_name"), F.lit("renamed").alias("change_kind"), "old_name", "old_kind", "new_kind"))
    retyped = renamed.where("old_kind <> new_kind").withColumn("change_kind", F.lit("type_changed"))
    gone = renamed.select("stream_name", "seq", F.col("old_name").alias("field"))
    come = renamed.select("stream_name", "seq", F.col("field_name").alias("field"))
    none = F.lit(None).cast("string")
    starts = added.join(come, ["stream_name", "seq", "field"], "left_anti").select("stream_name", "seq", F.col("field").alias("field_name"), F.lit("added").alias("change_kind"), none.alias("old_name"), none.alias("old_kind"), F.col("kind").alias("new_kind"))
    ends = removed.join(gone, ["stream_name", "seq", "field"], "left_anti").select("stream_name", "seq", F.col("field").alias("field_name"), F.lit("removed").alias("change_kind"), none.alias("old_name"), F.col("kind").alias("old_kind"), none.alias("new_kind"))
    every = typed.unionByName(renamed).unionByName(retyped).unionByName(starts).unionByName(ends)
    return every.join(files.select("stream_name", "seq", "batch_file"), ["stream_name", "seq"]).select("stream_name", "batch_file", "field_name", "change_kind", "old_name", "old_kind", "new_kind")


def _cast(v: object, cast: str) -> object:
    if v is None:
        return None
    if isinstance(v, dict):
        v = v.get("text", v.get("value", next(iter(v.values()), None)))
    if cast == "list":
        if isinstance(v, str):
            v = v.split(",")
        return [str(x).strip() for x in (v if isinstance(v, list) else [v]) if x is not None]
    if isinstance(v, list):
        v = v[0] if len(v) == 1 else ", ".join(str(x) for x in v)
    if cast == "string":
        return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)
    if cast == "timestamp":
        return as_time(v)
    c = comparable(v)
    if cast == "boolean":
        return {"1": True, "0": False}.get(c)
    try:
        x = int(float(re.sub(r"[,' ]", "", str(v)) if isinstance(v, str) else v))
        return x if abs(x) < 2 ** 63 else None
    except (ValueError, OverflowError):
        return None


def consistent(snapshots: DataFrame, aliases: Aliases = ALIASES) -> DataFrame:
    """One row per readable record with the canonical columns, cast as the alias table says.

    Of several names of one field in a record the first non-null, in the alias table's order, is taken;
    fields unknown to the table stay, as JSON text, in ``other``.
    """
    kinds = {"string": "string", "long": "bigint", "boolean": "boolean", "timestamp": "timestamp_ntz", "list": "array<string>"}
    schema = "record_id long, stream_name string, batch_file string, " + ", ".join(f"{c} {kinds[k]}" for c, (k, _) in aliases.items()) + ", other string"
    known = {n for c, (_, names) in aliases.items() for n in (c, *names)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, stream, file, payload in zip(pdf["record_id"], pdf["stream_name"], pdf["batch_file"], pdf["payload"]):
                record = _record(payload)
                if record is None:
                    continue
                values = [next((_cast(record[n], cast) for n in (c, *names) if record.get(n) is not None), None) for c, (cast, names) in aliases.items()]
                rest = {k: v for k, v in record.items() if k not in known}
                out.append((rid, stream, file, *values, json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None))
            frame = pd.DataFrame(out, columns=["record_id", "stream_name", "batch_file", *aliases, "other"])
            for c, (cast, _) in aliases.items():
                frame[c] = frame[c].astype({"long": "Int64", "boolean": "boolean", "timestamp": "datetime64[us]"}.get(cast, "object"))
            yield frame

    return snapshots.select("record_id", "stream_name", "batch_file", "payload").where("payload is not null").mapInPandas(rows, schema)
