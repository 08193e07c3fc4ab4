"""Generated, minified, vendored and data files among source files.

One pass over the files collects evidence: generation and library notices in the file header, found
by a multi-pattern automaton; path rules; shape of the text (minified, a block of data, names that a
machine numbered). Files without such evidence are compared with those of other projects: copies and
near copies (five-word shingles, Jaccard similarity 0.8 or more) are libraries that someone carried in.

Near copies are found with MinHash bands. Files with equal shingles form a class first, so a group of
copies of any size costs one row afterwards. Within a band bucket every class is first compared with the
bucket's most copied class and with its first and last by project, of which one is of another project;
classes that this leaves unjudged are compared with all classes of other projects in their buckets. The
similarity of candidates is computed exactly from the texts.

Defined cases: null content gives no evidence; files whose path does not end in .py or .js are never
flagged; repeated rows are each flagged; a null project is a project of its own.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm.splits import canonical_name
from forgelens.session import cut

SIMILARITY = 0.8
WORDS = 5
BANDS, ROWS = 16, 4
LEAST_SHINGLES = 30  # shorter files are alike because everyone writes them alike

# Header phrases, without accents and in lower case.
MADE = (
    "code generated by", "@generated", "auto-generated", "autogenerated", "automatically generated", "generated automatically",
    "automatically created by", "produced automatically", "automatically produced", "machine written", "machine generated",
    "written by machine", "generated file", "generated from", "generated code", "file generated", "do not edit", "do not modify",
    "regenerate instead of", "regenerate with", "changes will be lost", "edits will be lost", "hand changes are not kept",
    "local edits disappear", "manual edits are overwritten", "changes will be overwritten", "automatisch erzeugt", "automatisch generiert",
    "maschinell erzeugt", "nicht bearbeiten", "nicht von hand", "otomatik olusturul", "otomatik olarak", "elle degistirmeyin",
    "archivo creado por", "archivo generado", "generado automaticamente", "creado automaticamente", "no modificar", "no editar",
    "genere automatiquement", "ne pas modifier", "сгенерирован", "не редактир", "自動生成", "自动生成", "请勿编辑", "編集しないで",
)
BY_HAND = (
    "rewritten by hand", "then rewritten", "edit it here", "first generated", "originally generated", "generated files", "files are never edited",
    "written by hand", "no longer generated", "not generated", "was generated once", "von hand", "elle yazil", "escrito a mano",
)
LIBRARY = ("upstream:", "released under the", "vendored from", "copied from", "bundled copy of", "all rights reserved")
AUTHORS = re.compile(r"copyright \(c\) [\d, -]+ the [\w .-]+ authors")

STRONG_DIRS = frozenset("node_modules bower_components site-packages third_party thirdparty third-party 3rdparty _vendor vendored ext_libs extern externals external bundled deps".split())
WEAK_DIRS = frozenset(["vendor", "vendors"])
VERSIONED = re.compile(r"^[A-Za-z][\w.]*-\d+(?:\.\d+)+$")
MINIFIED_PATH = re.compile(r"(?:[.-]min|\.bundle|\.pack|\.[0-9a-f]{8})\.js$|-lock\.json$|\.lock$")

TOKEN = re.compile(r"[^\W\d]\w*|\$[\w$]*|\d[\w.]*")
STRINGS = re.compile(r"'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`")
COMMENTS = re.compile(r"#[^\n]*")
JS_COMMENTS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")
KEYWORDS = frozenset(
    "if in is or as and not for def let var new try del int len str elif else from pass with self True None False import return class while yield lambda "
    "const function typeof void this null true false break continue switch case default throw catch finally delete".split()
)
NUMBERED = re.compile(r"\b[A-Za-z_$][\w$]*?_(\d+)\b")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for role, phrases in (("made", MADE), ("by_hand", BY_HAND), ("library", LIBRARY)):
        for p in phrases:
            a.add_word(p, role)
    a.make_automaton()
    return a


def header(text: str) -> str:
    """The comments and docstring before the first statement, without accents, in lower case."""
    out: list[str] = []
    closing = ""
    for line in text.split("\n"):
        s = line.strip()
        if closing:
            out.append(s)
            if closing in s:
                closing = ""
        elif not s:
            continue
        elif s.startswith(("'''", '"""', "/*")):
            closing = "*/" if s.startswith("/*") else s[:3]
            out.append(s)
            if closing in s[2 if closing == "*/" else 3:]:
                closing = ""
                if s.startswith("/*") and not s.endswith("*/"):
                    break
            elif s[:2] != "/*" and any(x.startswith(("'''", '"""')) for x in out[:-1]):
                break
        elif s.startswith(("#", "//")):
            out.append(s)
        else:
            break
    t = unicodedata.normalize("NFKD", "\n".join(out).lower().replace("ı", "i"))
    return "".join(c for c in t if not unicodedata.combining(c))


def notices(text: str) -> tuple[bool, bool]:
    """(made by a program, copy of a library), as the header says."""
    h = header(text)
    if not h:
        return False, False
    roles = {role for _, role in automaton().iter(h)}
    return "made" in roles and "by_hand" not in roles, "library" in roles and bool(AUTHORS.search(h))


def path_rule(path: str) -> str | None:
    """'vendored' | 'weak' | 'minified' from the path alone."""
    parts = path.replace("\\", "/").split("/")
    dirs = parts[:-1]
    if any(d.lower() in STRONG_DIRS for d in dirs) or any(VERSIONED.match(d) for d in dirs):
        return "vendored"
    if MINIFIED_PATH.search(parts[-1]):
        return "minified"
    return "weak" if any(d.lower() in WEAK_DIRS for d in dirs) else None


def shape(text: str, js: bool) -> str | None:
    """'minified' | 'data' | 'numbered' from the text alone."""
    size = len(text)
    if size < 200:
        return None
    literal = 0
    starts: list[str] = []

    def blank(m: re.Match) -> str:
        nonlocal literal
        s = m.group()
        before = text[max(0, m.start() - 1):m.start()]
        if not (s.startswith(("'''", '"""')) and (m.start() == 0 or before in "\n \t" and text[:m.start()].rstrip(" \t").endswith("\n"))):
            literal += len(s) - s.count(" ") - s.count("\n")
        return "''"

    bare = STRINGS.sub(blank, text)
    comments = (JS_COMMENTS if js else COMMENTS).findall(bare)
    bare = (JS_COMMENTS if js else COMMENTS).sub("", bare)
    tight = len(re.sub(r"\s+", "", bare))
    names = [w for w in TOKEN.findall(bare) if not w[0].isdigit()]
    if not names:
        return "data" if size > 400 else None
    plain = [w for w in names if w not in KEYWORDS]
    short = sum(len(w) <= 2 for w in plain) / max(1, len(plain))
    spaces = 1 - tight / max(1, len(bare))
    if short > 0.45 and spaces < 0.16:
        return "minified"
    data = literal + sum(map(len, re.findall(r"(?<![\w$])[-+]?(?:0x[0-9a-fA-F]+|\d[\d_.eE+-]*)\b|[,\[\](){}:]", bare)))
    if data / max(1, tight + literal) > 0.85 and len(comments) < 0.3 * text.count("\n") + 1 and tight + literal > 400:
        return "data"
    lines = [x for x in bare.split("\n") if x.strip()]
    marked = [x for x in lines if NUMBERED.search(x)]
    if len(marked) >= 0.3 * len(lines):
        seen = {int(x) for x in NUMBERED.findall(bare) if len(x) < 9}
        run = 0
        while run in seen:
            run += 1
        if run >= 5 or len(seen) >= 6 and run + 1 >= len(seen):
            return "numbered"
    return None


WORD = re.compile(r"\w+")


class _Codes(dict):
    """Word hashes, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return code


_codes = _Codes()
_mult = (np.random.default_rng(7).integers(1, 2 ** 63 - 1, size=BANDS * ROWS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_add = np.random.default_rng(8).integers(1, 2 ** 63 - 1, size=BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text without its library header."""
    code = np.array(list(map(_codes.__getitem__, WORD.findall(text))), dtype=np.uint64)
    if len(code) < WORDS:
        return np.empty(0, np.uint64)
    h = np.zeros(len(code) - WORDS + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WORDS):
            h = (h ^ code[i:len(code) - WORDS + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def without_banner(text: str) -> str:
    """The text after its leading comment lines, which copies of a library may lack or change."""
    lines = text.replace("\r", "").split("\n")
    i = 0
    while i < len(lines) and (not lines[i].strip() or lines[i].lstrip().startswith(("#", "//"))):
        i += 1
    return "\n".join(lines[i:])


def signature(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = h[:, None] * _mult[None, :] + _add[None, :]
    return mixed.min(axis=0)


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, entity, path, text in zip(pdf["file_id"], pdf["entity"], pdf["file_path"], pdf["content_"]):
            js = path.lower().endswith(".js")
            made, library = notices(text)
            rule = path_rule(path)
            kind = "notice" if made else "library" if library else shape(text, js)
            h = shingles(without_banner(text)) if kind in (None, "library") else np.empty(0, np.uint64)
            bands: list[int] = []
            digest = None
            if len(h) >= LEAST_SHINGLES:
                digest = int(np.bitwise_xor.reduce(h * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.int64)) ^ len(h)
                sig = signature(h).reshape(BANDS, ROWS)
                with np.errstate(over="ignore"):
                    key = sig[:, 0].copy()
                    for r in range(1, ROWS):
                        key = (key ^ (sig[:, r] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
                    key += np.arange(BANDS, dtype=np.uint64)
                bands = key.astype(np.int64).tolist()
            rows.append((file_id, entity, kind, rule, digest, len(h), bands))
        yield pd.DataFrame(rows, columns=["file_id", "entity", "kind", "rule", "digest", "size", "bands"]).astype({"digest": "Int64"})


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
            x, y = shingles(without_banner(ta)), shingles(without_banner(tb))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= SIMILARITY * (len(x) + len(y) - both):
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def evidence(files: DataFrame) -> DataFrame:
    """(file_id, entity, kind, rule, digest, size, bands): what one pass over a file's header, path and text tells."""
    chosen = files.select(
        "file_id", F.coalesce(canonical_name(F.col("project_name")), F.lit("<null>")).alias("entity"), "file_path", F.col("content").alias("content_")
    ).where("lower(file_path) rlike '[.](py|js)$' and content_ is not null")
    return chosen.mapInPandas(_evidence, "file_id long, entity string, kind string, rule string, digest long, size long, bands array<long>")


def _candidates(asked: DataFrame) -> DataFrame:
    """(da, db, a, b) of the distinct pairs of a class and its ``o`` that would flag it, by digest and file; sizes too far apart cannot be alike."""
    mine = F.col("digest") < F.col("o.digest")
    return asked.where(
        f"o.digest <> digest and (o.library = 1 or o.e0 <> e0 or o.e1 <> e1) and least(size, o.size) >= {SIMILARITY}D * greatest(size, o.size)"
    ).select(
        F.least("digest", "o.digest").alias("da"), F.greatest("digest", "o.digest").alias("db"), F.when(mine, F.col("rep")).otherwise(F.col("o.rep")).alias("a"), F.when(mine, F.col("o.rep")).otherwise(F.col("rep")).alias("b")
    ).distinct()


def _verified(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidate pairs whose texts are alike."""
    ids = pairs.select(F.col("a").alias("file_id")).union(pairs.select(F.col("b").alias("file_id"))).distinct()
    texts = files.select("file_id", F.col("content").alias("t")).join(ids, "file_id", "left_semi")
    checked = (
        pairs.join(texts.select(F.col("file_id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("file_id").alias("b"), F.col("t").alias("tb")), "b")
        .select("a", "b", "ta", "tb").mapInPandas(_similar, "a long, b long")
    )
    return checked.join(pairs, ["a", "b"]).select("da", "db")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("da").alias("digest")).union(pairs.select(F.col("db").alias("digest"))).distinct()


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, reason) of files that are generated, minified, vendored or data; one row a file."""
    seen = cut(evidence(files))
    own = seen.where("kind is not null or rule = 'vendored'").select("file_id", F.coalesce("kind", "rule").alias("reason"))
    comparable = seen.where("digest is not null")
    classes = cut(
        comparable.groupBy("digest").agg(
            F.min("entity").alias("e0"), F.max("entity").alias("e1"), F.count("*").alias("copies"), F.min("file_id").alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size"),
            F.max(F.coalesce((F.col("kind") == "library") | (F.col("rule") == "vendored"), F.lit(False)).cast("int")).alias("library"),
        )
    )
    one = F.struct("digest", "rep", "e0", "e1", "size", "library")
    buckets = classes.select("digest", "rep", "copies", "e0", "e1", "size", "library", F.explode("bands").alias("band"))
    lead = buckets.groupBy("band").agg(
        F.max_by(one, F.struct("library", "copies", "digest")).alias("top"), F.min_by(one, F.struct("e0", "digest")).alias("first"), F.max_by(one, F.struct("e1", "digest")).alias("last"), F.count("*").alias("n")
    ).where("n > 1 and (first.e0 <> last.e1 or top.library = 1)")
    mixed = cut(buckets.join(lead.drop("n"), "band"))  # buckets in which a pair could tell something
    asking = mixed.where("e0 = e1 and library = 0")
    leaders = cut(_candidates(asking.withColumn("o", F.explode(F.array("top", "first", "last")))))
    alike = _verified(files, leaders)
    settled = cut(_ends(alike))
    left = asking.join(settled, "digest", "left_anti").drop("top", "first", "last")
    rest = cut(_candidates(left.join(mixed.select("band", one.alias("o")), "band")).join(leaders, ["da", "db"], "left_anti"))
    shared = settled.union(_ends(_verified(files, rest))).union(classes.where("e0 <> e1 or library = 1").select("digest")).distinct()
    copied = comparable.join(shared, "digest", "left_semi").select("file_id", F.lit("copy").alias("reason"))
    return own.union(copied).groupBy("file_id").agg(F.min("reason").alias("reason"))
